"""A whole run from a configuration: select, scan, order, write."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoweave.operators.selection import (
    ENTRY,
    clean_manifest,
    distinct_entries,
    package_links,
    selection_manifest,
    top_packages,
    top_repos,
    unreachable,
    without_files,
)
from repoweave.operators.joins import salted_join
from repoweave.operators.tokens import pad_truncate, tokenize, tokenizer
from repoweave.plans.clean import clean_files, cleaning_rejects, rejected_files
from repoweave.plans.corpus import CORPUS_ORDER, DEPENDENCY_ORDER, GLOBAL_SHUFFLE, corpus, stored_or_built_graph
from repoweave.session import shared_checkpoint, shared_table
from repoweave.sinks.corpus import write_corpus, write_jsonl
from repoweave.sinks.tokens import write_tokens
from repoweave.sources.archives import read_archives, scan_archives
from repoweave.sources.presets import preset_manifest
from repoweave.sources.tables import read_corpus, read_package_ranking, read_search_pages
from repoweave.sources.tree import read_rejects, scan_repos
from repoweave.sources.web import page_links

# Largest number of repeated manifest entries that is broadcast.
BROADCAST_ENTRIES = 100_000


@dataclass(frozen=True)
class CorpusConfig:
    """Settings of a run. Files that a crawler stored stand in for live requests."""

    setting: int = 2
    data_file: str = "data/corpus"
    output_file: str | None = None
    use_cache: bool = False
    cached_array: bool = False  # the stored corpus is JSON arrays, not lines
    repos_dir: str = "repos"
    ignore_preset_repos: bool = False
    get_repos_from: str = "github"
    top_k: int = 100
    repos: list[dict] = field(default_factory=list)
    language: str = "python"
    seed: int = 0
    dedupe: bool = False
    graph_store: str | None = None
    search_pages: str | None = None
    package_ranking: str | None = None
    package_pages: str | None = None
    archives: str | None = None  # folder of downloaded archives, read instead of a tree
    rejects_file: str | None = None
    overwrite: bool = False
    tokenize: bool = False
    tokenizer: str = "bytes"
    max_length: int = 100_000
    truncation: bool = True
    output_tokenized: str | None = None
    deduplicate: str | None = None
    decontaminate: str | None = None
    redact: bool = False

    @classmethod
    def from_dict(cls, values: dict) -> CorpusConfig:
        """Unknown keys are left to other steps of the pipeline."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    @classmethod
    def from_yaml(cls, path: str) -> CorpusConfig:
        import yaml

        with open(path, encoding="utf-8") as file:
            return cls.from_dict(yaml.safe_load(file))


def select_repos(spark: SparkSession, config: CorpusConfig) -> DataFrame:
    """Manifest by mode: the preset list, or the top of a stored ranking."""
    if not config.ignore_preset_repos:
        return preset_manifest(spark, config.repos, config.repos_dir)
    by_rank = Window.orderBy("_first", "_second")  # over at most top_k rows
    if config.get_repos_from == "github":
        chosen = top_repos(read_search_pages(spark, config.search_pages), config.top_k).select(
            "name", F.col("html_url").alias("url"), F.col("page").alias("_first"), F.col("at").alias("_second")
        )
    elif config.get_repos_from == "pypi":
        ranked = top_packages(read_package_ranking(spark, config.package_ranking), config.top_k)
        links = page_links(spark.read.parquet(config.package_pages))
        chosen = package_links(ranked, links).select(
            F.col("project").alias("name"),
            "url",
            (-F.col("download_count")).alias("_first"),
            F.col("row_ord").alias("_second"),
        )
    else:
        raise ValueError(f"unknown repository source {config.get_repos_from!r}")
    ranked = chosen.withColumn("rank", F.row_number().over(by_rank) - 1)
    return selection_manifest(ranked, config.repos_dir, config.language)


def repeat_entries(records: DataFrame, manifest: DataFrame, setting: int) -> DataFrame:
    """Emit a repository once per manifest entry. ``records`` holds each name, path and extensions at its first entry.

    Only repeated entries take part in the join; they are broadcast up to a checked number.
    """
    repeated, seen = shared_checkpoint(
        manifest.groupBy(*ENTRY)
        .agg(F.min("repo_ord").alias("repo_ord"), F.collect_list("repo_ord").alias("_entries"))
        .filter(F.size("_entries") > 1)
        .select("repo_ord", "_entries"),
        n=F.count(F.lit(1)),
    )
    if seen["n"] == 0:
        return records
    if seen["n"] <= BROADCAST_ENTRIES:
        joined = records.join(F.broadcast(repeated), "repo_ord", "left")
    else:
        joined = salted_join(records, repeated, ["repo_ord"], ["file_path"], how="left")
    emitted = joined.withColumn("repo_ord", F.explode(F.coalesce("_entries", F.array("repo_ord")))).drop("_entries")
    if setting == GLOBAL_SHUFFLE:
        return emitted
    return emitted.withColumn("order_group", F.col("repo_ord").cast("long"))


def write_tokenized(records: DataFrame, config: CorpusConfig, mode: str) -> None:
    """Token rows of the configured length, in corpus order."""
    place = [*CORPUS_ORDER, "repo_ord", "file_path"]
    ids = tokenize(records.select(*place, "content"), tokenizer(config.tokenizer))
    padded = pad_truncate(F.col("input_ids"), config.max_length, truncation=config.truncation)
    write_tokens(ids.withColumn("input_ids", padded), config.output_tokenized, place, mode)


def in_file_order(cached: DataFrame) -> DataFrame:
    """A stored corpus with sort columns for the order of its files and of the lines in each.

    Line numbers come from the place of a row in its split: a file's splits are numbered in order, rows within a split
    by the order in which they are read. Staged, so that all later passes see one numbering.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at"))
    staged = cached.select("*", place.alias("order_key"))
    zero = F.lit(0)
    return shared_table(staged.withColumns({"order_group": zero.cast("long"), "repo_ord": zero}))


def rejects(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """What did not go as planned: ``(repo_name, rel_path, stage, reason)``. Reads names only."""
    return unreachable(manifest).unionByName(read_rejects(files)).unionByName(without_files(manifest, files))


def prepare(spark: SparkSession, config: CorpusConfig) -> DataFrame:
    """Build the corpus, write it to ``data_file`` (and ``output_file``), and return it as read back."""
    mode = "overwrite" if config.overwrite else "errorifexists"
    if config.use_cache:
        cached = read_corpus(spark, config.data_file, multiline=config.cached_array)
        if config.tokenize:
            write_tokenized(in_file_order(cached), config, mode)
        return cached
    manifest = select_repos(spark, config)
    entries = clean_manifest(manifest, dedupe=True) if config.dedupe else distinct_entries(manifest)
    broken = None
    if config.archives:
        files, broken = scan_archives(read_archives(spark, config.archives), entries)
    else:
        files = scan_repos(entries)
    rejected = None
    if config.deduplicate or config.decontaminate:
        benchmark = spark.read.parquet(config.decontaminate) if config.decontaminate else None
        rejected = rejected_files(files, config.deduplicate, benchmark)
    cleaned = clean_files(files, rejected, config.redact)
    graph = None
    if config.setting == DEPENDENCY_ORDER and config.graph_store:
        graph = stored_or_built_graph(files, config.graph_store)
    records = corpus(cleaned, config.setting, seed=config.seed, graph=graph)
    # Ordered once: every target and the tokens read the staged rows.
    emitted = shared_table(records if config.dedupe else repeat_entries(records, manifest, config.setting))
    for target in filter(None, dict.fromkeys([config.data_file, config.output_file])):
        write_corpus(emitted, target, mode=mode)
    if config.rejects_file:
        found = rejects(manifest, files)
        if broken is not None:
            found = found.unionByName(broken)
        if rejected is not None:
            found = found.unionByName(cleaning_rejects(files, rejected))
        write_jsonl(found, config.rejects_file, mode)
    if config.tokenize:
        write_tokenized(emitted, config, mode)
    return read_corpus(spark, config.data_file)
