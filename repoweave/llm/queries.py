"""The queries of the dealt operators, over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.llm import (
    decontamination, fingerprints, jaccard, language, mixing, oracles, periodic, phrases, ppm, quality,
    secrets, suffixes, surrogates, token_counts,
)


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; every executor has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    block = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    scored = ppm.score_documents(docs, learn=~ppm.held_out(), block=block)
    return scored.withColumn("held_out", ppm.held_out())


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_documents(spark, sf_dir))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(_documents(spark, sf_dir), labels)


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(_documents(spark, sf_dir), words=3, percent=90)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(_documents(spark, sf_dir), benchmark)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(_documents(spark, sf_dir))


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score", "mixture")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, every tenth of them made periodic from some word on."""
    planted = periodic.with_periods(_documents(spark, sf_dir))
    return periodic.digests(periodic.find_runs(planted, min_exponent=4, min_words=6))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_versions(_documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir), longest=5, min_count=100, percent=100, most=2000)


QUERIES: dict[str, Query] = {
    "op1_partial_matching": op1_partial_matching,
    "op2_secret_spans": op2_secret_spans,
    "op3_token_counts": op3_token_counts,
    "op4_repeated_strings": op4_repeated_strings,
    "op5_source_mix": op5_source_mix,
    "op6_quality_rules": op6_quality_rules,
    "op7_shingle_join": op7_shingle_join,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_surrogates": op9_surrogates,
    "op10_languages": op10_languages,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fingerprints": op12_fingerprints,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op7_shingle_join": oracles.SHINGLE_JOIN,
    "op11_periodic_runs": oracles.PERIODIC_RUNS,
    "op13_collocations": oracles.COLLOCATIONS,
}
