"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def build_session(app_name: str = "repoweave", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the settings the jobs rely on: adaptive re-planning, skew splitting, reliable checkpoints."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Iterative jobs write one checkpoint per round; drop each once nothing refers to it.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: the cluster's setting, or a scratch folder of this
    process in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="repoweave-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return context.getCheckpointDir()


def shared_checkpoint(df: DataFrame, **metrics) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    Surviving executors re-read the files, so a lost executor never replays earlier rounds. Named aggregate
    expressions are evaluated while the rows are written and come back as a dict, which saves a second job.
    """
    checkpoint_folder(df.sparkSession)
    if not metrics:
        return df.checkpoint(eager=True)
    seen = Observation()
    stored = df.observe(seen, *[expr.alias(name) for name, expr in metrics.items()]).checkpoint(eager=True)
    return stored, seen.get


def shared_table(df: DataFrame, **metrics) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` as a Parquet table in the shared folder and read it from there, with named aggregates as above.

    For wide rows that later steps read in parts: unlike a checkpoint, the table still prunes columns. And for rounds that
    join a result with itself: a checkpoint hands on the size that the planner guessed, which such joins square every time,
    until the guess is a number of millions of digits; a table has the size of its files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4()}"
    seen = Observation()
    if metrics:
        df = df.observe(seen, *[expr.alias(name) for name, expr in metrics.items()])
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)  # without a job that looks the schema up
    return (stored, seen.get) if metrics else stored
