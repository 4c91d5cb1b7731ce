"""Which repositories and packages enter the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions.imports import extension_of
from repoweave.functions.text import join_path

# Words that mark a description as unwanted, matched anywhere in the lowercased text.
BLACKLIST = [
    "mirror", "fork", "test", "example", "assignment", "homework",
    "tutorial", "course", "workshop", "bootcamp", "practice", "solution",
    "interview", "coding", "challenge", "template", "study", "education",
    "教程", "学习", "教育", "课程", "练习", "解决方案", "挑战", "作业", "测试", "示例",
    "教學", "學習", "教育", "課程", "練習", "解決方案", "挑戰", "作業", "測試", "示例",
    "チュートリアル", "学習", "教育", "コース", "演習", "解決", "チャレンジ", "課題", "テスト", "例",
    "튜토리얼", "학습", "교육", "코스", "연습", "해결", "도전", "과제", "테스트", "예제",
]
# Words that rescue a description.
WHITELIST = ["机器学习"]
# Fixed value: a repository must be larger than this many kilobytes.
MIN_SIZE_KB = 100_000


def _contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), lambda w: F.contains(text, w))


def invalid_description(
    description: Column, blacklist: list[str] = BLACKLIST, whitelist: list[str] = WHITELIST
) -> Column:
    """True for a missing description, or one with a blacklisted and no whitelisted word."""
    lowered = F.lower(description)
    return F.coalesce(_contains_any(lowered, blacklist) & ~_contains_any(lowered, whitelist), F.lit(True))


def repo_candidates(items: DataFrame, min_size_kb: int = MIN_SIZE_KB) -> DataFrame:
    """Search items with an issue tracker, enough code and an acceptable description."""
    return items.filter(
        F.col("has_issues") & (F.col("size") > min_size_kb) & ~invalid_description(F.col("description"))
    )


def top_repos(items: DataFrame, k: int) -> DataFrame:
    """The first k candidates in the order of the stored ranking, ``(page, at)``. Filtering comes first, so k candidates
    are returned whenever they exist."""
    return repo_candidates(items).orderBy("page", "at").limit(k)


def top_packages(packages: DataFrame, k: int) -> DataFrame:
    """The k most downloaded packages; ties keep the order of the ranking."""
    return packages.orderBy(F.col("download_count").desc(), "row_ord").limit(k)


def package_links(packages: DataFrame, links: DataFrame) -> DataFrame:
    """Packages with the download link of their stored page; null when there is no page or no link on it."""
    return packages.join(links.select("project", F.col("link").alias("url")), "project", "left")


def selection_manifest(chosen: DataFrame, repos_dir: str, language: str = "python") -> DataFrame:
    """Manifest rows ``(repo_ord, repo_name, url, path, extensions)`` for ranked repositories.

    ``chosen`` has ``rank, name, url``.
    """
    return chosen.select(
        F.col("rank").cast("int").alias("repo_ord"),
        F.col("name").alias("repo_name"),
        "url",
        join_path(F.lit(repos_dir), F.col("name")).alias("path"),
        F.array(extension_of(F.lit(language))).alias("extensions"),
    )


def clean_manifest(manifest: DataFrame, dedupe: bool = False, trim: bool = False) -> DataFrame:
    """Optional repairs: strip blanks around names, keep the first entry of a repeated name."""
    if trim:
        manifest = manifest.withColumn("repo_name", F.trim("repo_name"))
    if not dedupe:
        return manifest
    columns = manifest.columns
    return (
        manifest.groupBy("repo_name")
        .agg(F.min(F.struct("repo_ord", *[c for c in columns if c not in ("repo_ord", "repo_name")])).alias("first"))
        .select(*[F.col("repo_name") if c == "repo_name" else F.col(f"first.{c}") for c in columns])
    )


# What makes two manifest entries the same work.
ENTRY = ["repo_name", "path", "extensions"]


def distinct_entries(manifest: DataFrame) -> DataFrame:
    """One row per name, path and extensions, with the first position it has."""
    first = manifest.groupBy(*ENTRY).agg(F.min(F.struct("repo_ord", "url")).alias("first"))
    return first.select("first.repo_ord", "repo_name", "first.url", "path", "extensions")


def missing_repos(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest rows whose repository is not there yet."""
    return manifest.join(present.select("repo_name"), "repo_name", "left_anti")


def without_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rejects: entries whose folder gave no file at all, because it is missing, cannot be read, or holds none."""
    seen = files.select("repo_name").distinct()
    return manifest.filter(F.col("url").isNotNull()).join(seen, "repo_name", "left_anti").select(
        "repo_name",
        F.lit(None).cast("string").alias("rel_path"),
        F.lit("scan").alias("stage"),
        F.lit("no files").alias("reason"),
    )


def unreachable(manifest: DataFrame) -> DataFrame:
    """Rejects: entries without a download link."""
    return manifest.filter(F.col("url").isNull()).select(
        "repo_name",
        F.lit(None).cast("string").alias("rel_path"),
        F.lit("download").alias("stage"),
        F.lit("no download link").alias("reason"),
    )
