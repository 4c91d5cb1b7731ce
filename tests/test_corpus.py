"""The corpus settings, their files on disk, and whole runs from a configuration."""

import glob
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from repoweave.functions import records as rec
from repoweave.operators.ordering import shuffle_in_repo
from repoweave.plans import corpus as plan
from repoweave.plans.corpus import corpus, stored_or_built_graph, with_positions
from repoweave.plans.prepare import CorpusConfig, prepare
from repoweave.sinks.corpus import to_jsonl, write_corpus
from repoweave.sinks.graph import load_graph, save_graph
from repoweave.sources.tables import read_corpus

FILES = [
    # repo_ord, repo_name, rel_path, content, selected
    (0, "z", "main.py", "import util\nimport base", True),
    (0, "z", "util.py", "import base", True),
    (0, "z", "pkg/base.py", "", True),
    (0, "z", "notes.md", "", True),
    (0, "z", "Skip.java", "", False),
    (1, "a", "x.py", "import y", True),
    (1, "a", "y.py", "import x", True),
    (1, "a", "w.py", "import x", True),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(o, r, p, f"repos/{r}/{p}", c, s) for o, r, p, c, s in FILES]
    return spark.createDataFrame(
        rows, "repo_ord int, repo_name string, rel_path string, file_path string, content string, selected boolean"
    ).repartition(4)


def ordered(records):
    return [(r.repo_name, r.rel_path) for r in records.orderBy("order_group", "order_key").collect()]


@pytest.mark.parametrize("local_edges", [200_000, 0])
def test_dependency_order(spark, files, local_edges):
    # Imported files first; x and y import each other, so only w -> x counts; files outside the graph come last.
    assert ordered(corpus(files, 3, local_edges=local_edges)) == [
        ("z", "pkg/base.py"),
        ("z", "util.py"),
        ("z", "main.py"),
        ("z", "notes.md"),
        ("a", "x.py"),
        ("a", "w.py"),
        ("a", "y.py"),
    ]


def test_walk_order(spark, files):
    assert ordered(corpus(files, 3, order="walk"))[:4] == [
        ("z", "main.py"), ("z", "notes.md"), ("z", "util.py"), ("z", "pkg/base.py"),
    ]


@pytest.mark.parametrize("setting", [1, 2, 3])
def test_settings_are_permutations_and_repeatable(spark, files, setting):
    first = ordered(corpus(files, setting, seed=4))
    assert first == ordered(corpus(files.repartition(1), setting, seed=4))
    assert sorted(first) == sorted((r, p) for _, r, p, _, s in FILES if s)
    if setting != 1:
        assert [r for r, _ in first] == ["z"] * 4 + ["a"] * 3


def test_seeds_differ(spark):
    files = spark.range(200).select(F.lit("r").alias("repo_name"), F.concat(F.lit("f"), "id").alias("file_path"))
    orders = [
        [r.file_path for r in shuffle_in_repo(files, seed).orderBy("pos").collect()] for seed in (1, 2)
    ]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_coin_is_fair_and_unrelated_to_the_shuffle(spark):
    path = F.concat(F.lit("f"), "id")
    df = spark.range(4000).select(rec.coin(1, path).alias("named"), rec.shuffle_key(1, path).alias("draw"))
    rows = [r.named for r in df.orderBy("draw").collect()]
    assert 1800 < sum(rows) < 2200
    assert 850 < sum(rows[:2000]) < 1150


def test_positions(spark, files):
    rows = with_positions(corpus(files, 3), 3).collect()
    assert {(r.repo_name, r.rel_path): r.pos for r in rows}[("z", "notes.md")] == 3
    assert sorted(r.pos for r in with_positions(corpus(files, 1), 1).collect()) == list(range(7))


def test_unknown_setting(files):
    with pytest.raises(ValueError):
        corpus(files, 4)
    with pytest.raises(ValueError):
        corpus(files, 3, order="random")


def lines_of(path):
    parts = sorted(glob.glob(os.path.join(path, "part-*")))
    return [json.loads(line) for part in parts for line in open(part, encoding="utf-8")]


def test_written_in_order_and_guarded(spark, files, tmp_path):
    path = str(tmp_path / "corpus")
    records = corpus(files, 2, seed=9)
    write_corpus(records, path, partitions=3)
    written = lines_of(path)
    expected = records.orderBy("order_group", "order_key").collect()
    assert [(w["repo_name"], w["file_path"], w["content"]) for w in written] == [
        (r.repo_name, r.file_path, r.content) for r in expected
    ]
    assert list(written[0]) == ["repo_name", "file_path", "language", "content"]
    with pytest.raises(AnalysisException):
        write_corpus(records, path)
    write_corpus(records, path, mode="overwrite")
    assert len(lines_of(path)) == 7


def test_jsonl_cut_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("r", None, "py", "αβγδε<|endoftext|>")], "repo_name string, file_path string, language string, content string")
    to_jsonl(df, str(tmp_path / "a"), 4)
    assert lines_of(str(tmp_path / "a")) == [{"repo_name": "r", "file_path": None, "language": "py", "content": "αβγδ"}]
    to_jsonl(df, str(tmp_path / "b"), 15, keep_terminator=True)
    assert lines_of(str(tmp_path / "b"))[0]["content"] == "αβ<|endoftext|>"
    to_jsonl(df, str(tmp_path / "c"), 100_000_000_000)
    assert read_corpus(spark, str(tmp_path / "c")).first().content == "αβγδε<|endoftext|>"


def test_stored_graph_is_used(spark, files, tmp_path):
    nodes = files.filter("rel_path like '%.py'").select("repo_name", "rel_path")
    edges = spark.createDataFrame([("z", "util.py", "main.py")], "repo_name string, src string, dst string")
    save_graph(nodes, edges, str(tmp_path / "g"))
    assert load_graph(spark, str(tmp_path / "g"), ["a"])[0].count() == 3
    got = ordered(corpus(files, 3, graph=load_graph(spark, str(tmp_path / "g"))))
    assert got[:4] == [("z", "main.py"), ("z", "pkg/base.py"), ("z", "util.py"), ("z", "notes.md")]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_graph_store_fills_up(spark, files, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(plan, "BROADCAST_REPOS", broadcast)
    path = str(tmp_path / "store")
    one = files.filter("repo_name = 'a'")
    nodes, edges = stored_or_built_graph(one, path)
    assert nodes.count() == 3 and edges.count() == 3
    # A known repository is not parsed again; the other one is added.
    changed = files.withColumn("content", F.when(F.col("repo_name") == "a", "").otherwise(F.col("content")))
    nodes, edges = stored_or_built_graph(changed, path)
    assert sorted(r.repo_name for r in edges.collect()) == ["a"] * 3 + ["z"] * 3
    assert nodes.count() == 7
    assert stored_or_built_graph(changed, path)[1].count() == 6


@pytest.fixture
def checkout(tmp_path):
    for path, text in {
        "one/src/b.py": "import a\n",
        "one/src/a.py": "x = 1\r\n",
        "one/other/c.py": "no",
        "two/lib/__init__.py": "",
        "two/T.java": "class T {}",
    }.items():
        full = tmp_path / "repos" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(text.encode())
    return tmp_path


def config(root, **options):
    repos = [
        {"two": {"url": "u", "name": "two", "path": "two", "extensions": [".py"]}},
        {"one": {"url": "u", "name": "one", "path": "one/src", "extensions": [".py"]}},
        {"two": {"url": "u", "name": "two", "path": "two", "extensions": [".py"]}},
    ]
    base = {"repos": repos, "repos_dir": str(root / "repos"), "data_file": str(root / "out" / "data.json"), "num_workers": 8}
    return CorpusConfig.from_dict({**base, **options})


@pytest.mark.parametrize("dedupe", [False, True])
def test_preset_run(spark, checkout, dedupe):
    cfg = config(checkout, setting=3, dedupe=dedupe, output_file=str(checkout / "out" / "copy"))
    assert prepare(spark, cfg).count() == (3 if dedupe else 4)
    names = [os.path.relpath(r["file_path"], checkout / "repos") for r in lines_of(cfg.data_file)]
    assert names == ["two/lib/__init__.py", "one/src/a.py", "one/src/b.py"] + ([] if dedupe else ["two/lib/__init__.py"])
    assert lines_of(cfg.output_file) == lines_of(cfg.data_file)
    with pytest.raises(AnalysisException):
        prepare(spark, cfg)
    cached = prepare(spark, CorpusConfig.from_dict({"use_cache": True, "data_file": cfg.data_file}))
    assert cached.count() == (3 if dedupe else 4)


def test_entries_of_one_name_are_told_apart(spark, checkout):
    entry = {"url": "u", "name": "one", "extensions": [".py"]}
    repos = [{"x": {**entry, "path": "one/src"}}, {"y": {**entry, "path": "one/other"}}, {"z": {**entry, "path": "one/src"}}]
    cfg = config(checkout, setting=3, repos=repos)
    prepare(spark, cfg)
    names = [os.path.relpath(r["file_path"], checkout / "repos") for r in lines_of(cfg.data_file)]
    assert names == ["one/src/a.py", "one/src/b.py", "one/other/c.py", "one/src/a.py", "one/src/b.py"]


def test_ranked_runs(spark, checkout):
    item = {"html_url": "u", "has_issues": True, "size": 200_000, "description": "fine"}
    pages = checkout / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"items": [{**item, "name": "two", "stargazers_count": 5}, {**item, "name": "one", "stargazers_count": 9}]}))
    (pages / "2.json").write_text(json.dumps({"items": [{**item, "name": "far", "stargazers_count": 99}]}))
    cfg = config(
        checkout, setting=3, ignore_preset_repos=True, search_pages=str(pages), top_k=2,
        graph_store=str(checkout / "graphs"),
    )
    prepare(spark, cfg)
    names = [os.path.relpath(r["file_path"], checkout / "repos") for r in lines_of(cfg.data_file)]
    # Nobody imports c and b, so they come last, by path.
    assert names == ["two/lib/__init__.py", "one/src/a.py", "one/other/c.py", "one/src/b.py"]

    (checkout / "top.json").write_text(json.dumps({"rows": [{"project": "one", "download_count": 1}, {"project": "two", "download_count": 3}]}))
    spark.createDataFrame([("two", '<div class="card file__card"><a href="u">x</a></div>')], "project string, html string").write.parquet(
        str(checkout / "html")
    )
    cfg = config(
        checkout, setting=2, ignore_preset_repos=True, get_repos_from="pypi", top_k=1, overwrite=True,
        package_ranking=str(checkout / "top.json"), package_pages=str(checkout / "html"),
    )
    prepare(spark, cfg)
    assert [os.path.relpath(r["file_path"], checkout / "repos") for r in lines_of(cfg.data_file)] == ["two/lib/__init__.py"]
    with pytest.raises(ValueError):
        prepare(spark, config(checkout, ignore_preset_repos=True, get_repos_from="elsewhere"))


def test_run_from_ranked_archives(spark, checkout):
    """Ranking, package pages, archives, records in dependency order; every archive that fails is a reject."""
    import io
    import tarfile

    def pack(name, members):
        with tarfile.open(checkout / "dist" / f"{name}.tar.gz", "w:gz") as archive:
            for path, text in members:
                member = tarfile.TarInfo(path)
                member.size = len(text)
                archive.addfile(member, io.BytesIO(text.encode()))

    (checkout / "dist").mkdir()
    pack("alpha-1.0", [("alpha-1.0/m.py", "old"), ("alpha-1.0/b.py", "import m"), ("alpha-1.0/m.py", "x = 1\r\n"), ("alpha-1.0/data.bin", "z"),
                       ("beside.py", "no"), ("alpha-1.0/../../up.py", "no"), ("alpha-1.0/J.java", "class J {}")])
    pack("unasked-2", [("unasked-2/u.py", "no")])
    (checkout / "dist" / "broken-3.tar.gz").write_bytes(b"not an archive")
    names = ["alpha", "broken", "gone", "linkless"]
    (checkout / "top.json").write_text(json.dumps({"rows": [{"project": n, "download_count": 9 - i} for i, n in enumerate(names)]}))
    link = '<div class="card file__card"><a href="https://files/x/{}.tar.gz">x</a></div>'
    pages = [("alpha", link.format("alpha-1.0")), ("broken", link.format("broken-3")), ("gone", link.format("gone-1")), ("linkless", "<p>")]
    spark.createDataFrame(pages, "project string, html string").write.parquet(str(checkout / "html"))
    cfg = config(
        checkout, setting=3, ignore_preset_repos=True, get_repos_from="pypi", top_k=4, overwrite=True, archives=str(checkout / "dist"),
        package_ranking=str(checkout / "top.json"), package_pages=str(checkout / "html"), rejects_file=str(checkout / "rejects"),
    )
    prepare(spark, cfg)
    records = lines_of(cfg.data_file)
    assert [os.path.basename(r["file_path"]) for r in records] == ["m.py", "b.py"]
    assert records[0]["content"].endswith("x = 1\n<|endoftext|>") and {r["repo_name"] for r in records} == {"alpha"}
    found = {(r["repo_name"], r["rel_path"], r["stage"]) for r in lines_of(cfg.rejects_file)}
    assert found >= {("alpha", "alpha-1.0/../../up.py", "unpack"), ("broken", None, "unpack"), ("gone", None, "download"), ("linkless", None, "download")}


def test_rejects_are_listed(spark, checkout):
    os.symlink(checkout / "gone", checkout / "repos" / "one" / "src" / "gone.py")
    cfg = config(checkout, setting=3, rejects_file=str(checkout / "rejects"))
    cfg.repos[0]["two"]["url"] = None
    prepare(spark, cfg)
    found = {(r["repo_name"], r["rel_path"], r["stage"]) for r in lines_of(cfg.rejects_file)}
    assert found == {("two", None, "download"), ("one", "gone.py", "read")}


def test_cleaned_run(spark, checkout):
    """Copies and benchmark passages leave the corpus but not the import graph; personal data is marked."""
    passage = " ".join(f"word{i}" for i in range(20))
    text = "import b\n" + " ".join(f"t{i}" for i in range(60))
    tree = checkout / "repos"
    (tree / "one" / "src" / "near.py").write_text(text + " t60")
    (tree / "one" / "src" / "nearly.py").write_text(text + " t61")
    (tree / "one" / "src" / "copy.py").write_text((tree / "one" / "src" / "a.py").read_text())
    (tree / "two" / "lib" / "quiz.py").write_text(f"x = 1\n# {passage.upper()}")
    (tree / "two" / "lib" / "mail.py").write_text("# write to some.one@host.example or 10.1.2.3")
    spark.createDataFrame([(1, passage)], "item_id int, text string").write.parquet(str(checkout / "benchmark"))
    for how, gone in (("exact", {"copy.py"}), ("near", {"copy.py", "nearly.py"})):
        cfg = config(
            checkout, setting=3, deduplicate=how, decontaminate=str(checkout / "benchmark"), redact=True, overwrite=True,
            dedupe=True, rejects_file=str(checkout / f"rejects-{how}"),
        )
        prepare(spark, cfg)
        records = lines_of(cfg.data_file)
        names = [os.path.basename(r["file_path"]) for r in records]
        listed = {os.path.basename(f) for f in glob.glob(f"{tree}/*/*/*.py")} - {"c.py"}
        assert sorted(names) == sorted(listed - gone - {"quiz.py"})
        assert names.index("b.py") < names.index("near.py")
        mail = [r["content"] for r in records if r["file_path"].endswith("mail.py")]
        assert "# write to <EMAIL> or <IP>" in mail[0]
        reasons = {(r["rel_path"].split("/")[-1], r["reason"]) for r in lines_of(cfg.rejects_file) if r["stage"] == "clean"}
        assert reasons == {(g, f"{how} copy of another file") for g in gone} | {("quiz.py", "holds a benchmark passage")}
    with pytest.raises(ValueError):
        prepare(spark, config(checkout, deduplicate="other", overwrite=True))


def test_tokenized_run(spark, checkout):
    cfg = config(checkout, setting=3, tokenize=True, max_length=12, output_tokenized=str(checkout / "ids"))
    prepare(spark, cfg)
    texts = [r["content"].encode() for r in lines_of(cfg.data_file)]
    rows = spark.read.parquet(cfg.output_tokenized).orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, 12, 24, 36]
    assert [r.input_ids for r in rows] == [([*t[: -len(b"<|endoftext|>")], 256] + [256] * 12)[:12] for t in texts]
    again = config(checkout, use_cache=True, tokenize=True, max_length=12, output_tokenized=str(checkout / "again"))
    prepare(spark, again)
    cached = spark.read.parquet(again.output_tokenized).orderBy("offset").collect()
    assert [r.input_ids for r in cached] == [r.input_ids for r in rows]
    with pytest.raises(ValueError):
        prepare(spark, config(checkout, overwrite=True, tokenize=True, tokenizer="other", output_tokenized="x"))


def test_cached_array(spark, tmp_path):
    """A stored corpus may be one JSON array over several lines, as well as lines."""
    records = [{"repo_name": "r", "file_path": f"r/{i}.py", "language": "py", "content": c} for i, c in enumerate(["b", "a\nc", ""])]
    (tmp_path / "data.json").write_text(json.dumps(records, indent=4))
    cfg = CorpusConfig.from_dict(
        {
            "use_cache": True, "cached_array": True, "data_file": str(tmp_path / "data.json"), "tokenize": True, "max_length": 4,
            "output_tokenized": str(tmp_path / "ids"),
        }
    )
    assert sorted((r.file_path, r.content) for r in prepare(spark, cfg).collect()) == [(r["file_path"], r["content"]) for r in records]
    ids = [r.input_ids for r in spark.read.parquet(str(tmp_path / "ids")).orderBy("offset").collect()]
    assert ids == [[98, 256, 256, 256], [97, 10, 99, 256], [256] * 4]


def test_a_scan_opens_each_file_once(spark, checkout):
    """After the scan the tree may go: order and text come from the staged rows, in every setting."""
    import shutil

    from repoweave.sources.tree import scan_repos

    root = str(checkout / "repos" / "one")
    files = scan_repos(spark.createDataFrame([(0, "one", root, [".py"])], "repo_ord int, repo_name string, path string, extensions array<string>"))
    shutil.rmtree(root)
    assert [p for _, p in ordered(corpus(files, 3))] == ["src/a.py", "other/c.py", "src/b.py"]
    assert files.filter("content <> ''").count() == 3
    plan_text = files.select("rel_path")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan_text and "content" not in plan_text


def test_command_line(spark, checkout, monkeypatch):
    import yaml

    from repoweave import __main__ as cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    cfg = config(checkout, setting=2)
    path = checkout / "c.yaml"
    path.write_text(yaml.safe_dump({"repos": cfg.repos, "repos_dir": cfg.repos_dir, "data_file": cfg.data_file, "setting": 2}))
    cli.main(["prepare", "--config", str(path)])
    with pytest.raises(AnalysisException):
        cli.main(["prepare", "--config", str(path)])
    cli.main(["prepare", "--config", str(path), "-y"])
    cli.main(["jsonl", cfg.data_file, str(checkout / "cut"), "--length", "5"])
    assert {len(r["content"]) for r in lines_of(str(checkout / "cut"))} == {5}


def test_config_from_yaml(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text('tokenizer: "gpt2"\nsetting: 3\ntop_k: 7\nrepos:\n  - a:\n      url: "u"\n      name: "a"\n      path: "a"\n      extensions: [".py"]\n')
    cfg = CorpusConfig.from_yaml(str(path))
    assert (cfg.setting, cfg.top_k, cfg.repos[0]["a"]["extensions"]) == (3, 7, [".py"])


def test_stored_graph_is_pruned_by_a_table_of_names(spark, tmp_path):
    names = [f"r{i}" for i in range(40)]
    nodes = spark.createDataFrame([(n, f"{n}/a.py") for n in names], "repo_name string, file_path string")
    edges = spark.createDataFrame([(n, f"{n}/a.py", f"{n}/b.py") for n in names], "repo_name string, src string, dst string")
    save_graph(nodes, edges, str(tmp_path / "g"))
    spark.createDataFrame([("r3",), ("r7",), ("r7",), (None,), ("absent",)], "repo_name string").write.parquet(str(tmp_path / "w"))
    got = load_graph(spark, str(tmp_path / "g"), spark.read.parquet(str(tmp_path / "w")))
    for stored, whole in zip(got, (nodes, edges), strict=True):
        assert sorted(map(tuple, stored.select(*whole.columns).collect())) == sorted(
            map(tuple, whole.filter("repo_name in ('r3', 'r7')").collect())
        )
        assert "dynamicpruning" in stored._jdf.queryExecution().executedPlan().toString()
    nobody = load_graph(spark, str(tmp_path / "g"), nodes.limit(0))
    assert [df.count() for df in nobody] == [0, 0]
