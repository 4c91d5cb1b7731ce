"""One query per operator over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.functions import records as rec
from repoweave.functions import text as txt
from repoweave.operators import decontaminate as decon
from repoweave.operators import dedup
from repoweave.operators import dependencies as dep
from repoweave.operators import graph as gr
from repoweave.operators import ordering as order
from repoweave.operators import selection as sel
from repoweave.operators import stats, tokens
from repoweave.operators.redact import redact as redact_text
from repoweave.plans import corpus as plan
from repoweave.registry import fixtures as fx
from repoweave.session import checkpoint_folder, shared_checkpoint
from repoweave.sinks.corpus import to_jsonl, write_corpus
from repoweave.sinks.graph import save_graph
from repoweave.sinks.imports import compact_imports, load_imports, stored_imports
from repoweave.sinks.tokens import write_tokens
from repoweave.sources.archives import archive_files
from repoweave.sources.tables import items_per_page, package_rows, read_corpus, read_search_lines, write_search_pages
from repoweave.sources.tree import scan_repos
from repoweave.sources.web import page_links

SEED = 7
CUT = 500
VOCAB = 2000
ROW_LENGTH = 1024
TOP = 100
SAMPLE = 50
PAGE_ITEMS = 30
RANKING_ROWS = 500
PRESENT = 12
ARRAY_RECORDS = 100

Query = Callable[[SparkSession, str], DataFrame]


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, fx.CODE_FILES)


def _numbered_code(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf).withColumn("repo_ord", F.substring("repo_name", 4, 10).cast("int"))


def _java(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, fx.JAVA_FILES)


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf).unionByName(_java(spark, sf))


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, fx.NESTED_FILES)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, fx.SEARCH_ITEMS)


def _packages(spark: SparkSession, sf: str) -> DataFrame:
    return fx.view(spark, sf, fx.PACKAGES)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))


def _folder(spark: SparkSession) -> str:
    """A new folder for a write-and-read query, where the cluster keeps its checkpoints."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4()}"


def _ids_as_text(ids: str):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


# ---- files and records ----------------------------------------------------------------------------------------


def language_of(spark, sf):
    return _both(spark, sf).select("file_path", txt.language_of(F.col("file_path")).alias("language"))


def rel_path(spark, sf):
    root = F.concat(F.lit("repos/"), F.col("repo_name"))
    return _both(spark, sf).select("file_path", txt.rel_path(F.col("file_path"), root).alias("rel_path"))


def source_files(spark, sf):
    return dep.source_files(_both(spark, sf), ["java"]).select("repo_name", "rel_path", "source_language")


def extension_filter(spark, sf):
    wanted = F.array(F.lit("3.py"), F.lit(".java"))
    return _both(spark, sf).filter(txt.has_extension(F.col("rel_path"), wanted)).select("repo_name", "rel_path")


def format_context(spark, sf):
    formatted = rec.format_context(F.col("repo_name"), F.col("file_path"), F.col("content"), SEED)
    return _code(spark, sf).select("repo_name", "file_path", formatted.alias("content"))


def truncate_content(spark, sf):
    return _texts(spark, sf).select("doc_id", txt.truncate_content(F.col("content"), CUT).alias("content"))


def truncate_record(spark, sf):
    record = F.concat("content", F.lit(rec.END_MARK))
    return _texts(spark, sf).select(
        "doc_id",
        rec.truncate_record(record, CUT).alias("cut"),
        rec.truncate_record(record, CUT, keep_terminator=True).alias("cut_with_mark"),
    )


def decode_text(spark, sf):
    """Every third document gets stray bytes and Windows line ends, then is decoded."""
    raw = F.when(
        F.col("doc_id") % 3 == 0,
        F.concat(
            F.unhex(F.lit("FF")),
            F.encode(F.regexp_replace("content", "\n", "\r\n"), "UTF-8"),
            F.unhex(F.lit("C3")),
        ),
    ).otherwise(F.encode("content", "UTF-8"))
    return _texts(spark, sf).select("doc_id", txt.decode_text(raw).alias("content"))


def repo_stats(spark, sf):
    return stats.repo_stats(_both(spark, sf))


def language_stats(spark, sf):
    return stats.language_stats(_both(spark, sf))


# ---- import graph ---------------------------------------------------------------------------------------------


def extract_imports_py(spark, sf):
    return dep.extract_imports(_code(spark, sf), ["python"]).select("repo_name", "rel_path", "module")


def extract_imports_java(spark, sf):
    return dep.extract_imports(_java(spark, sf), ["java"]).select("repo_name", "rel_path", "module")


def future_imports_dropped(spark, sf):
    return dep.extract_imports(_nested(spark, sf)).select("repo_name", "rel_path", "module")


def import_counts(spark, sf):
    return stats.import_counts(dep.import_sets(_both(spark, sf)))


def module_index(spark, sf):
    return dep.module_index(_nested(spark, sf))


def resolve_imports(spark, sf):
    files = _nested(spark, sf)
    resolved = dep.resolve_imports(dep.extract_imports(files), files.select("repo_name", "rel_path"))
    return resolved.select("repo_name", "rel_path", "module", "target")


def dependency_edges(spark, sf):
    return dep.dependency_edges(_both(spark, sf))


def drop_self_loops(spark, sf):
    return dep.drop_self_loops(dep.dependency_edges(_code(spark, sf)))


def compose_graphs(spark, sf):
    python = dep.dependency_edges(_code(spark, sf), ["python"])
    java = dep.dependency_edges(_java(spark, sf), ["java"])
    return dep.compose_graphs(python, java)


def graph_nodes(spark, sf):
    return dep.compose_graphs(
        dep.graph_nodes(_code(spark, sf), ["python"]), dep.graph_nodes(_java(spark, sf), ["java"])
    )


def _graph(spark, sf):
    files = _code(spark, sf)
    return dep.graph_nodes(files), dep.dependency_edges(files)


def components(spark, sf):
    return gr.components(_graph(spark, sf)[1])


def break_cycles(spark, sf):
    return gr.break_cycles(_graph(spark, sf)[1])


def topo_levels(spark, sf):
    return gr.topo_levels(*_graph(spark, sf))


def components_large_repos(spark, sf):
    """The way of repositories too large for one task, applied to all."""
    return gr.components(_graph(spark, sf)[1], local_edges=0)


def break_cycles_large_repos(spark, sf):
    return gr.break_cycles(_graph(spark, sf)[1], local_edges=0)


def topo_levels_large_repos(spark, sf):
    return gr.topo_levels(*_graph(spark, sf), local_edges=0)


def graph_stats(spark, sf):
    nodes, edges = _graph(spark, sf)
    edges = shared_checkpoint(edges)
    return stats.graph_stats(nodes, edges, gr.components(edges), gr.break_cycles(edges))


def stored_graph(spark, sf):
    """Save the Python graphs, then ask for both languages: known repositories come from the store as they are."""
    path = _folder(spark)
    save_graph(*_graph(spark, sf), path)
    nodes, edges = plan.stored_or_built_graph(_both(spark, sf), path)
    return nodes.select("repo_name", F.col("rel_path").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(
        edges
    )


def incremental_imports(spark, sf):
    """Half of the files are in the cache, with an entry that tells hits from parsed rows."""
    files = _code(spark, sf)
    cached = files.filter(F.substring(F.md5("file_path"), 1, 1) <= "7").select(
        dep.path_key(F.col("file_path")).alias("path_key"), F.array(F.lit("cached")).alias("modules")
    )
    found = dep.incremental_imports(files, cached)
    return found.select(
        "repo_name", "rel_path", "path_key", F.array_join(F.array_sort("modules"), " ").alias("modules"), "from_cache"
    )


def import_store(spark, sf):
    """A run over half of the files fills a store, a second one over all of them parses the rest; then the store is compacted."""
    path = _folder(spark)
    files = _code(spark, sf)
    stored_imports(files.filter(F.substring(F.md5("file_path"), 1, 1) <= "7"), path)
    found = stored_imports(files, path)
    compact_imports(spark, path, f"{path}-compact")
    kept = load_imports(spark, f"{path}-compact").select("path_key", F.size("modules").cast("long").alias("n_stored"))
    return found.join(kept, "path_key", "left").select(
        "repo_name", "rel_path", F.array_join(F.array_sort("modules"), " ").alias("modules"), "from_cache", "n_stored"
    )


# ---- order ----------------------------------------------------------------------------------------------------


def order_files(spark, sf):
    nodes, edges = _graph(spark, sf)
    return order.order_files(nodes, gr.topo_levels(nodes, edges))


def order_by_walk(spark, sf):
    return order.order_by_walk(_nested(spark, sf))


def shuffle_in_repo(spark, sf):
    return order.shuffle_in_repo(_code(spark, sf), SEED)


def shuffle_global(spark, sf):
    return order.shuffle_global(_code(spark, sf), SEED)


def sample_rows(spark, sf):
    return order.sample_rows(_texts(spark, sf), "doc_id", SAMPLE, SEED)


RECORD = ["repo_ord", "repo_name", "file_path", "language", "content", "pos"]


def _corpus(setting: int, **options) -> Query:
    def query(spark, sf):
        records = plan.corpus(_numbered_code(spark, sf), setting, seed=SEED, **options)
        return plan.with_positions(records, setting).select(*RECORD)

    return query


corpus_setting1 = _corpus(1)
corpus_setting2 = _corpus(2)
corpus_setting3 = _corpus(3)
corpus_walk_order = _corpus(3, order="walk")


# ---- selection ------------------------------------------------------------------------------------------------


def invalid_description(spark, sf):
    return _items(spark, sf).select("name", sel.invalid_description(F.col("description")).alias("invalid"))


def repo_candidates(spark, sf):
    return sel.repo_candidates(_items(spark, sf))


def top_repos(spark, sf):
    """From stored pages, written by one query and read back from their files."""
    return sel.top_repos(_stored_pages(spark, sf), TOP).select("page", "name", "html_url")


def top_packages(spark, sf):
    return sel.top_packages(_packages(spark, sf), TOP)


def selection_manifest(spark, sf):
    ranked = _items(spark, sf).select(F.col("row_ord").alias("rank"), "name", F.col("html_url").alias("url"))
    return sel.selection_manifest(ranked, "repos", "java").withColumn("extensions", F.array_join("extensions", " "))


def _search_pages(spark, sf):
    item = F.struct("row_ord", "name", "html_url", F.col("stars").alias("stargazers_count"), "has_issues", "size", "description")
    page = F.floor(F.col("row_ord") / PAGE_ITEMS).alias("page")
    return (
        _items(spark, sf)
        .groupBy(page)
        .agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("json"))
    )


def _stored_pages(spark, sf):
    """Items of stored pages, many pages to a file."""
    path = _folder(spark)
    write_search_pages(_search_pages(spark, sf), path)
    return read_search_lines(spark, path)


def search_page_items(spark, sf):
    return _stored_pages(spark, sf).withColumn("at", F.col("at").cast("long"))


def search_page_sizes(spark, sf):
    return items_per_page(_search_pages(spark, sf))


def package_ranking_rows(spark, sf):
    row = F.struct("row_ord", "project", "download_count")
    part = F.floor(F.col("row_ord") / RANKING_ROWS)
    documents = (
        _packages(spark, sf)
        .groupBy(part.alias("part"))
        .agg(
            F.min("row_ord").alias("first_row"),
            F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("rows"))).alias("json"),
        )
    )
    return package_rows(documents)


def _manifest(spark, sf):
    """Every source once, every third again later, and every fourth name with a trailing blank."""
    number = F.substring("repo_name", 4, 10).cast("int")
    once = (
        fx.table(spark, sf, "documents")
        .select(F.col("source").alias("repo_name"))
        .distinct()
        .withColumns({"number": number, "path": F.concat(F.lit("repos/"), "repo_name")})
    )
    again = once.filter("number % 3 = 0").withColumns(
        {"number": F.col("number") + 1000, "path": F.concat("path", F.lit("/again"))}
    )
    listed = once.unionByName(again)
    name = F.when((F.col("number") % 4 == 0) & (F.col("number") < 1000), F.concat("repo_name", F.lit(" ")))
    return listed.select(
        F.col("number").alias("repo_ord"), F.coalesce(name, "repo_name").alias("repo_name"), "path"
    )


def manifest_as_written(spark, sf):
    return sel.clean_manifest(_manifest(spark, sf))


def manifest_deduped(spark, sf):
    return sel.clean_manifest(_manifest(spark, sf), dedupe=True, trim=True)


def missing_repos(spark, sf):
    listed = fx.table(spark, sf, "documents").select(F.col("source").alias("repo_name")).distinct()
    present = listed.filter(F.substring("repo_name", 4, 10).cast("int") < PRESENT)
    return sel.missing_repos(sel.clean_manifest(_manifest(spark, sf), trim=True), present)


def first_link(spark, sf):
    return page_links(fx.view(spark, sf, fx.PACKAGE_PAGES))


def package_links(spark, sf):
    links = page_links(fx.view(spark, sf, fx.PACKAGE_PAGES))
    return sel.package_links(_packages(spark, sf), links)


def rejects(spark, sf):
    linked = package_links(spark, sf).withColumnRenamed("project", "repo_name")
    return sel.unreachable(linked)


def archive_name(spark, sf):
    url = F.concat("url", F.lit("/files/v"), "page_id", F.lit(".1.tar.gz"))
    return fx.table(spark, sf, "pages").select("page_id", txt.archive_name(url).alias("archive"))


# ---- stored corpora -------------------------------------------------------------------------------------------


def _tar_gz(batches):
    """Pack each document into a small archive of its own: the file below the top folder, and one beside it."""
    import io
    import tarfile

    import pandas as pd

    for batch in batches:
        packed = []
        for doc_id, content in zip(batch["doc_id"], batch["content"]):
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as archive:
                for name in (f"pkg-{doc_id}/src/main.py", "beside.py"):
                    data = content.encode("utf-8")
                    member = tarfile.TarInfo(name)
                    member.size = len(data)
                    archive.addfile(member, io.BytesIO(data))
            packed.append(buffer.getvalue())
        yield pd.DataFrame(
            {
                "repo_name": [f"p{d}" for d in batch["doc_id"]],
                "archive": [f"pkg-{d}" for d in batch["doc_id"]],
                "content": packed,
            }
        )


def _write_files(root: str):
    """Write each row's text below ``root``; a retried task writes the same bytes again."""

    def run(batches):
        import os

        for batch in batches:
            for path, content in zip(batch["file_path"], batch["content"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as file:
                    file.write(content)
            yield batch[["file_path"]]

    return run


def scanned_repos(spark, sf):
    """Write every file of the corpus into a tree, then scan the tree. Needs a mounted checkpoint folder."""
    location = urlparse(_folder(spark))
    if location.scheme not in ("", "file"):
        raise ValueError("this query writes a file tree and needs spark.checkpoint.dir on a mounted file system")
    files = _both(spark, sf)
    files.select("file_path", "content").mapInPandas(_write_files(location.path), "file_path string").count()
    manifest = files.select("repo_name").distinct().select(
        F.substring("repo_name", 4, 10).cast("int").alias("repo_ord"),
        "repo_name",
        F.concat(F.lit(f"{location.path}/repos/"), "repo_name").alias("path"),
        F.array(F.lit(".py")).alias("extensions"),
    )
    return scan_repos(manifest).select("repo_ord", "repo_name", "rel_path", "selected", "content", "read_error")


def archive_members(spark, sf):
    archives = _texts(spark, sf).mapInPandas(_tar_gz, "repo_name string, archive string, content binary")
    return archive_files(archives)


def jsonl_round_trip(spark, sf):
    """Write a corpus in order, cut it into JSON Lines, read it back."""
    path = _folder(spark)
    records = plan.corpus(_numbered_code(spark, sf), 2, seed=SEED)
    write_corpus(records, f"{path}/corpus")
    to_jsonl(read_corpus(spark, f"{path}/corpus"), f"{path}/cut", CUT)
    return read_corpus(spark, f"{path}/cut")


def mixed_corpus(spark, sf):
    """One folder with arrays (Java, several lines each) and JSON Lines (Python), each read by its own names."""
    path = _folder(spark)
    records = plan.corpus(_both(spark, sf).withColumn("repo_ord", F.substring("repo_name", 4, 10).cast("int")), 2, seed=SEED)
    write_corpus(records.filter("language = 'py'"), f"{path}/all")
    # A bounded number of records to an array, one array to a file.
    java = plan.with_positions(records.filter("language = 'java'"), 2)
    row = F.struct("repo_name", "file_path", "language", "content")
    arrays = java.groupBy("repo_name", F.floor(F.col("pos") / ARRAY_RECORDS).alias("part")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    text = arrays.select(F.concat(F.lit("\n\n"), F.to_json("rows", {"pretty": "true"})))
    text.write.mode("append").option("maxRecordsPerFile", 1).text(f"{path}/all")
    stored = read_corpus(spark, f"{path}/all", multiline=True, glob="*.txt")
    return read_corpus(spark, f"{path}/all", glob="*.json").unionByName(stored)


# ---- copies, leaks, personal data ------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents")


def exact_dedup(spark, sf):
    return dedup.drop_exact(_documents(spark, sf), "doc_id", "text").select("doc_id", "lang", "source", "n_chars")


def exact_copies(spark, sf):
    return dedup.exact_groups(_documents(spark, sf), "doc_id", "text")


def near_dedup(spark, sf):
    """Every document with the first one of its component of near copies."""
    return dedup.near_components(_documents(spark, sf), "doc_id", "text").select(
        F.col("key").alias("doc_id"), "n_shingles", "component"
    )


def decontamination_report(spark, sf):
    benchmark = fx.table(spark, sf, "benchmark")
    return decon.shared_grams(_documents(spark, sf), "doc_id", "text", benchmark, "item_id", "text")


def decontaminate(spark, sf):
    benchmark = fx.table(spark, sf, "benchmark")
    return decon.without_benchmark(_documents(spark, sf), "doc_id", "text", benchmark, "text").select("doc_id", "n_chars")


def redact(spark, sf):
    return redact_text(_documents(spark, sf), "text").drop("lang", "source", "n_chars")


# ---- tokens ---------------------------------------------------------------------------------------------------


def _records(spark, sf):
    """Corpus records of all files, by path."""
    records = plan.corpus(_numbered_code(spark, sf), 2, seed=SEED)
    return records.select(F.col("file_path").alias("doc_id"), "content")


def _word_ids(spark, sf, order_by=()):
    texts = _records(spark, sf)
    return tokens.tokenize(texts, tokens.word_tokenizer(tokens.vocabulary(texts, VOCAB)), order_by=order_by)


def vocabulary(spark, sf):
    return tokens.vocabulary(_records(spark, sf), VOCAB)


def tokenize_words(spark, sf):
    return _word_ids(spark, sf).select("doc_id", _ids_as_text("input_ids").alias("ids"))


def tokenize_bytes(spark, sf):
    tokenized = tokens.tokenize(_records(spark, sf), tokens.byte_tokenizer)
    return tokenized.select("doc_id", _ids_as_text("input_ids").alias("ids"))


def training_rows(spark, sf):
    rows = tokens.training_rows(_word_ids(spark, sf), ROW_LENGTH)
    return rows.select(
        "doc_id", *[_ids_as_text(c).alias(c) for c in ("input_ids", "attention_mask", "labels")]
    )


def token_offsets(spark, sf):
    return tokens.token_offsets(_word_ids(spark, sf), ["doc_id"])


def flatten_tokens(spark, sf):
    return tokens.flatten_tokens(_word_ids(spark, sf, ["doc_id"]), ["doc_id"])


def token_stats(spark, sf):
    return stats.token_stats(_word_ids(spark, sf))


def distinct_tokens(spark, sf):
    return stats.distinct_tokens(_word_ids(spark, sf))


def merged_token_sketches(spark, sf):
    """Sketches of single files, stored, then merged: whether the estimate is within 3 % of the exact number."""
    path = _folder(spark)
    ids = _word_ids(spark, sf)
    stats.token_sketches(ids, ["doc_id"]).write.parquet(path)
    merged = stats.merged_distinct_tokens(spark.read.parquet(path)).withColumnRenamed("n_distinct_tokens", "estimate")
    both = stats.distinct_tokens(ids).unionByName(merged, allowMissingColumns=True)
    both = both.agg(F.max("n_distinct_tokens").alias("n_distinct_tokens"), F.max("estimate").alias("estimate"))
    off = F.abs(F.col("estimate") - F.col("n_distinct_tokens"))
    return both.select("n_distinct_tokens", (off <= 0.03 * F.col("n_distinct_tokens")).alias("close"))


def token_preview(spark, sf):
    texts = _records(spark, sf)
    vocab = tokens.vocabulary(texts, VOCAB)
    shown = tokens.token_preview(texts, vocab, "doc_id", SAMPLE, SEED)
    return shown.select("doc_id", _ids_as_text("input_ids").alias("ids"), "decoded")


def stored_tokens(spark, sf):
    path = _folder(spark)
    write_tokens(_word_ids(spark, sf, ["doc_id"]), path, ["doc_id"])
    stored = spark.read.parquet(path)
    return stored.select("doc_id", "offset", "n_tokens", _ids_as_text("input_ids").alias("ids"))


ALL = [
    language_of, rel_path, source_files, extension_filter, format_context, truncate_content, truncate_record,
    decode_text, repo_stats, language_stats,
    extract_imports_py, extract_imports_java, future_imports_dropped, import_counts, module_index, resolve_imports,
    dependency_edges, drop_self_loops, compose_graphs, graph_nodes,
    components, break_cycles, topo_levels, components_large_repos, break_cycles_large_repos, topo_levels_large_repos,
    graph_stats, stored_graph, incremental_imports, import_store,
    order_files, order_by_walk, shuffle_in_repo, shuffle_global, sample_rows,
    invalid_description, repo_candidates, top_repos, top_packages, selection_manifest, search_page_items,
    search_page_sizes, package_ranking_rows, manifest_as_written, manifest_deduped, missing_repos, first_link,
    package_links, rejects, archive_name,
    scanned_repos, archive_members, jsonl_round_trip, mixed_corpus,
    exact_dedup, exact_copies, near_dedup, decontamination_report, decontaminate, redact,
    vocabulary, tokenize_words, tokenize_bytes, training_rows, token_offsets, flatten_tokens, token_stats,
    distinct_tokens, merged_token_sketches, token_preview, stored_tokens,
]

QUERIES: dict[str, Query] = {
    **{query.__name__: query for query in ALL},
    "corpus_setting1": corpus_setting1,
    "corpus_setting2": corpus_setting2,
    "corpus_setting3": corpus_setting3,
    "corpus_walk_order": corpus_walk_order,
}
