"""Import extraction against Python's own regular expressions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from repoweave.operators import dependencies as dep

# The import patterns, as Python reads them.
PYTHON = re.compile(r"^\s*(?:import\s+([\w\.]+)|from\s+([\w\.]+)\s+import)", re.MULTILINE)
JAVA = re.compile(r"^import\s+([\w\.]+);", re.MULTILINE)

FRAGMENTS = [
    "import ", "from ", " import ", "os", "a.b", ".", "..x", "\n", "\n\n", " ", "\t", "\x0b", "\x0c", "\x1c", "\x85",
    "\xa0", " ", " ", "　", "é", "名", "_x1", "²", "٣", "x́", "__future__", "#", "'''", ",", "as", ";",
    "import java.util.A;", "static", "public class", "interface", "from\nx\nimport\ny", "﻿",
]


def python_modules(text):
    return {a or b for a, b in PYTHON.findall(text)} - {"__future__"}


def java_modules(text):
    lines = text.split("\n")
    header = "\n".join(lines[:100])
    return set(JAVA.findall(header.split("public class")[0].split("interface")[0]))


def extracted(spark, texts, suffix, language):
    files = spark.createDataFrame(
        [("r", f"f{i}{suffix}", text) for i, text in enumerate(texts)], "repo_name string, rel_path string, content string"
    )
    rows = dep.extract_imports(files, [language]).collect()
    assert len(rows) == len({(r.rel_path, r.module) for r in rows})
    found = [set() for _ in texts]
    for row in rows:
        found[int(row.rel_path[1 : -len(suffix)])].add(row.module)
    return found


def test_python_imports_match_python_regex(spark):
    batches = []

    @settings(max_examples=400, deadline=None, derandomize=True)
    @given(st.lists(st.sampled_from(FRAGMENTS), max_size=14).map("".join))
    def gather(text):
        batches.append(text)

    gather()
    assert extracted(spark, batches, ".py", "python") == [python_modules(t) for t in batches]
    assert extracted(spark, batches, ".java", "java") == [java_modules(t) for t in batches]


def test_python_statements(spark):
    text = (
        "import os, sys\nfrom a.b import c\n  import indented\nfrom . import here\nfrom .rel import x\n"
        "from __future__ import annotations\nimport os\nx = 'import no'\n# import no2\n'''\nimport docstring\n'''\n"
        "from x\nimport y\n"
    )
    (found,) = extracted(spark, [text], ".py", "python")
    assert found == {"os", "a.b", "indented", ".", ".rel", "docstring", "x"}


def test_java_statements(spark):
    header = "package p;\nimport a.B;\nimport static c.D.e;\nimport f.*;\n import g.H;\nimport\tk;\n"
    late = "// c\n" * 100 + "import late;\n"
    found = extracted(
        spark,
        [header + "public class X {\nimport no;\n", header + "interface Y\nimport no;", late, "\n" * 99 + "import last;"],
        ".java",
        "java",
    )
    assert found == [{"a.B", "k"}, {"a.B", "k"}, set(), {"last"}]


def files_of(spark, rows):
    return spark.createDataFrame(
        [(repo, path, f"{repo}/{path}", text) for repo, path, text in rows],
        "repo_name string, rel_path string, file_path string, content string",
    )


def test_first_file_in_walk_order_wins(spark):
    files = files_of(
        spark,
        [
            ("r", "b/util.py", ""),
            ("r", "a/z/util.py", ""),
            ("r", "a/util.py", ""),
            ("r", "a-b/util.py", ""),
            ("r", "main.py", "import util\nimport a.util\nimport missing\nimport main"),
            ("s", "util.py", ""),
            ("s", "deep/util.py", ""),
            ("s", "x.py", "import util"),
            ("s", "util.java", ""),
        ],
    )
    edges = {tuple(r) for r in dep.dependency_edges(files).collect()}
    assert edges == {("r", "main.py", "a/util.py"), ("r", "main.py", "main.py"), ("s", "x.py", "util.py")}


def test_languages_do_not_mix(spark):
    files = files_of(
        spark,
        [("r", "A.java", "import B;\nimport c;"), ("r", "B.java", ""), ("r", "c.py", "import B"), ("r", "B.txt", "import c")],
    )
    assert [tuple(r) for r in dep.dependency_edges(files).collect()] == [("r", "A.java", "B.java")]
    assert {r.rel_path for r in dep.graph_nodes(files).collect()} == {"A.java", "B.java", "c.py"}


def test_cached_imports_are_taken_as_they_are(spark):
    files = files_of(spark, [("r", "a.py", "import x"), ("r", "b.py", "import y"), ("r", "c.py", "")])
    cached = files.filter("rel_path = 'a.py'").select(
        dep.path_key(files.file_path).alias("path_key"), dep.F.array(dep.F.lit("old")).alias("modules")
    )
    rows = {(r.rel_path, tuple(r.modules), r.from_cache) for r in dep.incremental_imports(files, cached).collect()}
    assert rows == {("a.py", ("old",), True), ("b.py", ("y",), False), ("c.py", (), False)}


def test_registered_language(spark):
    from pyspark.sql import functions as F

    from repoweave.functions import imports

    imports.register_language("go", ".go", lambda c: F.regexp_extract_all(c, F.lit('(?m)^import "(\\w+)"'), F.lit(1)))
    try:
        files = files_of(spark, [("r", "a.go", 'import "b"'), ("r", "b.go", "")])
        assert [tuple(r) for r in dep.dependency_edges(files, ["go"]).collect()] == [("r", "a.go", "b.go")]
    finally:
        imports._LANGUAGES.pop("go")


def test_import_store_grows_and_is_compacted(spark, tmp_path):
    """The second run parses only what is new; entries of two runs at a time count once; nothing stored is an empty store."""
    from repoweave.sinks import imports as store

    def table(*names):
        rows = [("r", n, f"r/{n}", f"import {n[0]}\nimport os") for n in names]
        return spark.createDataFrame(rows, "repo_name string, rel_path string, file_path string, content string")

    path = str(tmp_path / "store")
    assert store.load_imports(spark, path).collect() == []
    first = store.stored_imports(table("a.py", "b.py"), path).collect()
    assert {(r.rel_path, r.from_cache) for r in first} == {("a.py", False), ("b.py", False)}
    second = store.stored_imports(table("a.py", "c.py"), path).collect()
    assert {(r.rel_path, r.from_cache, tuple(sorted(r.modules))) for r in second} == {("a.py", True, ("a", "os")), ("c.py", False, ("c", "os"))}
    store.save_imports(store.load_imports(spark, path), path)
    assert spark.read.parquet(path).count() == 6 and store.load_imports(spark, path).count() == 3
    store.compact_imports(spark, path, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3
    assert store.stored_imports(table("a.py", "b.py", "c.py"), path).filter("not from_cache").count() == 0
