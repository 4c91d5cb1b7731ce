"""Stored import graphs, kept before cycle removal and looked up by repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Repositories are filed by a hash of their name: one folder per repository would not scale to millions of them.
BUCKETS = 256


def _bucket(repo_name: Column) -> Column:
    return F.pmod(F.xxhash64(repo_name), F.lit(BUCKETS)).cast("int")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "append") -> None:
    """Store nodes and edges. Rows are rebalanced by bucket: few files for small buckets, and a bucket with a large
    repository is split among tasks."""
    for name, part in (("nodes", nodes), ("edges", edges)):
        filed = part.withColumn("bucket", _bucket(F.col("repo_name"))).hint("rebalance", "bucket")
        filed.write.mode(mode).partitionBy("bucket").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, repos: list[str] | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored nodes and edges, all or for some repositories, given as a short list or as a table with ``repo_name``.

    Only the folders of their buckets are read: by a filter for a list, by the partitions that Spark prunes while the join
    runs for a table of any length. The buckets, 256 at most, are broadcast; names are joined. Null names match nothing.
    """

    def load(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        if isinstance(repos, DataFrame):
            # The comparison drops nothing; Spark prunes by a side only if it is filtered.
            wanted = repos.select("repo_name", _bucket(F.col("repo_name")).alias("bucket")).filter(F.col("bucket") >= 0)
            df = df.join(F.broadcast(wanted.select("bucket").distinct()), "bucket", "left_semi")
            df = df.join(wanted.select("repo_name").distinct(), "repo_name", "left_semi")
        elif repos is not None:
            filed = spark.createDataFrame([(r,) for r in repos], "repo_name string").select(_bucket(F.col("repo_name")))
            buckets = [row[0] for row in filed.distinct().collect()]
            df = df.filter(F.col("bucket").isin(buckets) & F.col("repo_name").isin(repos))
        return df.drop("bucket")

    return load("nodes"), load("edges")
