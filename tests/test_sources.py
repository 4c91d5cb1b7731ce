"""Tree scan, archives, presets and stored corpora on temporary folders."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from repoweave.functions.text import decode_text, language_of
from repoweave.sources import archives, presets, tables, tree, web

MANIFEST = "repo_ord int, repo_name string, path string, extensions array<string>"


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(data)


@pytest.fixture
def repo(tmp_path):
    root = str(tmp_path / "repos" / "r1")
    write(f"{root}/main.py", b"import os\r\nprint(1)\rprint(2)\n")
    write(f"{root}/pkg/__init__.py", b"")
    write(f"{root}/pkg/_priv.py", b"caf\xc3\xa9 \xff\xfe ok \xe4\xb8")
    write(f"{root}/.hid/h.py", b"# hidden")
    write(f"{root}/readme.md", b"# text")
    write(f"{root}/Main.java", b"class Main {}")
    write(f"{root}/notes.txt", b"no")
    write(f"{root}/.py", b"bare")
    os.symlink(f"{root}/pkg", f"{root}/link")
    os.symlink(f"{root}/main.py", f"{root}/alias.py")
    os.symlink(f"{root}/gone.py", f"{root}/broken.py")
    return root


@pytest.mark.parametrize("max_entries", [1, 3, 20_000])
def test_scan_finds_what_a_walk_finds(spark, repo, max_entries):
    manifest = spark.createDataFrame([(0, "r1", repo + "/", [".py", ".md"]), (1, "none", repo + "/missing", [".py"])], MANIFEST)
    rows = tree.scan_repos(manifest, max_entries=max_entries).collect()
    found = {r.rel_path: r for r in rows}
    assert len(rows) == len(found)
    walked = {
        os.path.relpath(os.path.join(folder, name), repo)
        for folder, _, names in os.walk(repo)
        for name in names
        if name.endswith((".py", ".md", ".java"))
    }
    assert set(found) == walked
    for path, row in found.items():
        assert row.file_path == os.path.join(repo, path)
        assert row.selected == path.endswith((".py", ".md"))
        if path == "broken.py":
            assert row.content == "" and row.read_error.startswith("FileNotFoundError")
        else:
            with open(row.file_path, encoding="utf-8", errors="ignore") as file:
                assert row.content == file.read()
            assert row.read_error is None
    rejected = tree.read_rejects(spark.createDataFrame(rows)).collect()
    assert [(r.repo_name, r.rel_path, r.stage) for r in rejected] == [("r1", "broken.py", "read")]


def test_decode_text(spark):
    samples = [b"plain\r\nx\ry", b"\xff\xc3\xa9\xc3", "é中".encode(), b"", b"a\xf0\x9f\x98", b"\xef\xbb\xbfbom", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, raw binary")
    got = {r.i: r.text for r in df.select("i", decode_text(F.col("raw")).alias("text")).collect()}
    for i, sample in enumerate(samples):
        expected = None
        if sample is not None:
            expected = io.TextIOWrapper(io.BytesIO(sample), encoding="utf-8", errors="ignore").read()
        assert got[i] == expected


def test_language_of(spark):
    df = spark.createDataFrame([("a/b.py",), ("a.b/c",), ("none",), ("x.tar.gz",), ("dot.",)], "p string")
    assert [r[0] for r in df.select(language_of(F.col("p"))).collect()] == [p.split(".")[-1] for (p,) in df.collect()]


def archive(members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if isinstance(data, str):
                info.type, info.linkname = tarfile.SYMTYPE, data
                tar.addfile(info)
            elif data is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    data = archive(
        [
            ("demo-1.0", None),
            ("demo-1.0/setup.py", b"old"),
            ("demo-1.0/setup.py", b"new"),
            ("demo-1.0/demo/__init__.py", b"\xffx\r\n"),
            ("demo-1.0/alias.py", "setup.py"),
            ("demo-1.0/dangling.py", "nothing.py"),
            ("other/beside.py", b"no"),
            ("demo-1.0/../../evil.py", b"no"),
            ("/abs.py", b"no"),
        ]
    )
    write(str(tmp_path / "in" / "demo-1.0.tar.gz"), data)
    write(str(tmp_path / "in" / "bad-2.tar.gz"), b"not an archive")
    stored = archives.read_archives(spark, str(tmp_path / "in")).withColumn(
        "repo_name", F.when(F.col("archive") == "demo-1.0", "demo").otherwise("bad")
    )
    files = {(r.repo_name, r.rel_path): (r.file_path, r.content) for r in archives.archive_files(stored).collect()}
    assert files == {
        ("demo", "setup.py"): ("repos/demo/setup.py", "new"),
        ("demo", "demo/__init__.py"): ("repos/demo/demo/__init__.py", "x\n"),
        ("demo", "alias.py"): ("repos/demo/alias.py", "new"),
    }
    rejects = {(r.repo_name, r.rel_path) for r in archives.archive_rejects(stored).collect()}
    assert rejects == {("demo", "demo-1.0/../../evil.py"), ("demo", "/abs.py"), ("bad", None)}


def test_preset_manifest_keeps_repeats_and_order(spark):
    repos = [
        {"b": {"url": "u/b", "name": "b", "path": "b/src", "extensions": [".py"]}},
        {"a": {"url": "u/a", "name": "a ", "path": "a", "extensions": [".py", ".pyi"]}},
        {"b": {"url": "u/b", "name": "b", "path": "b/src", "extensions": [".py"]}},
    ]
    rows = presets.preset_manifest(spark, repos, "repos").orderBy("repo_ord").collect()
    assert [(r.repo_name, r.path, r.extensions) for r in rows] == [
        ("b", "repos/b/src", [".py"]),
        ("a ", "repos/a", [".py", ".pyi"]),
        ("b", "repos/b/src", [".py"]),
    ]


@pytest.mark.parametrize("form", ["lines", "array", "compact"])
def test_read_corpus_forms(spark, tmp_path, form):
    records = [
        {"repo_name": "r", "file_path": f"r/{i}.py", "language": "py", "content": f'line\n"{i}" é 机<|endoftext|>'} for i in range(3)
    ]
    text = "\n".join(map(json.dumps, records)) if form == "lines" else json.dumps(records, indent=4 if form == "array" else None)
    path = str(tmp_path / "data.json")
    write(path, text.encode())
    expected = sorted((r["repo_name"], r["file_path"], r["language"], r["content"]) for r in records)
    assert sorted(tables.read_corpus(spark, path, multiline=form != "lines").collect()) == expected


def test_read_corpus_raises_on_what_does_not_parse(spark, tmp_path):
    write(str(tmp_path / "broken.json"), b'{"repo_name": "r", "file_path": "f", "language": "py", "content": "c"}\n{"repo_name": "r", \n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        tables.read_corpus(spark, str(tmp_path / "broken.json")).collect()


def test_read_corpus_of_a_mixed_folder(spark, tmp_path):
    row = {"repo_name": "r", "file_path": "f", "language": "py", "content": "c"}
    write(str(tmp_path / "a.array.json"), ("\n" + json.dumps([row] * 30, indent=1)).encode())
    write(str(tmp_path / "b.jsonl"), "\n".join([json.dumps(row)] * 5).encode())
    arrays = tables.read_corpus(spark, str(tmp_path), multiline=True, glob="*.array.json")
    assert arrays.unionByName(tables.read_corpus(spark, str(tmp_path), glob="*.jsonl")).count() == 35


def test_stored_rankings(spark, tmp_path):
    write(str(tmp_path / "top.json"), json.dumps({"last_update": "x", "rows": [{"project": "b", "download_count": 5}, {"project": "a", "download_count": 5}]}).encode())
    rows = tables.read_package_ranking(spark, str(tmp_path / "top.json")).orderBy("row_ord").collect()
    assert [tuple(r) for r in rows] == [(0, "b", 5), (1, "a", 5)]
    item = {"name": "n", "html_url": "u", "stargazers_count": 3, "has_issues": True, "size": 7, "description": None, "forks": 1}
    for page, n in ((1, 2), (2, 1)):
        write(str(tmp_path / "pages" / f"search-2024-p{page}.json"), json.dumps({"items": [item] * n}).encode())
    rows = tables.read_search_pages(spark, str(tmp_path / "pages")).orderBy("page", "at").collect()
    assert [(r.page, r.at, r.name, r.size) for r in rows] == [(1, 0, "n", 7), (1, 1, "n", 7), (2, 0, "n", 7)]


PAGES = {
    '<div class="card file__card"><p><a href="x">1</a></p><a href="y">2</a></div>': "x",
    '<div class="card"><a href="no">n</a></div><div class="card file__card"><div>a</div><br><a href="in">n</a></div>': "in",
    '<div class="card file__card"><div>a</div></div><a href="after">n</a>': None,
    '<div class="card file__card"><div>a</div></div><div class="card file__card"><a href="second">n</a></div>': None,
    '<div class="card file__card extra"><a href="other">n</a></div>': None,
    '<!-- <div class="card file__card"> --><a href="no">n</a>': None,
    '<div class="card file__card"><span>open<a href="a&amp;b">n</a>': "a&b",
    '<section><div class="card file__card"><b></section><a href="out">n</a>': None,
    '<div class="card file__card"><a>no href</a><a href="later">n</a></div>': None,
    "<p>nothing</p>": None,
}


def test_first_link(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")
    got = {r.i: r.link for r in df.select("i", web.first_link(F.col("html")).alias("link")).collect()}
    assert got == dict(enumerate(PAGES.values()))


