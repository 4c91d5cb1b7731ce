"""Mixing sources to target weights by Pareto order sampling.

A source is due ``target / size of the source`` copies of its words. Its documents share them unequally: short ones are due
more and long ones less, by an amount that adds up to nothing over the source, so that rather short documents are repeated.
The whole part of what a document is due is allocated for certain. For the rest, a document with inclusion chance ``p`` and a
uniform number ``u`` from its id gets the rank ``(u / (1 - u)) / (p / (1 - p))``, random odds over inclusion odds, and
each source takes its documents by rising rank until the words it still owes are reached. The sample size is fixed in
words, not documents, since the target is a number of words.

A document that would overshoot stops a round; the next one ranks those that are no larger than what is still owed, and
behind them further copies of documents that have fewer than the most. Rounds end when nothing fits in any source, so each
one is short of its target by less than its smallest document that may have another copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.operators.numbering import number_rows, running_total
from repoweave.session import shared_checkpoint, shared_table

WORD = r"[^\x20\x09-\x0D]+"
SOURCE_WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 2024


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a digest of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, total: int, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Targets of ``(source, source_size)`` rows that share ``total``: the weights repeat over the sources in code
    point order, null last. No target is above ``most`` times its size; the excess goes to the others by weight.

    With sources by rising ratio of limit to weight, the level that fills each source up to its limit or to
    ``level * weight`` is the largest of ``(total - limits before) / (weights from here on)``.
    """
    ranked = number_rows(
        sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], name="_rank"
    ).drop("_last")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    ranked, seen = shared_checkpoint(
        ranked.withColumn("_ratio", F.col("limit") / F.col("weight")), all_weights=F.sum("weight")
    )
    if not seen["all_weights"]:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    order = ["_ratio", "_rank"]
    filled = running_total(running_total(ranked, F.col("limit"), order, name="_limits"), F.col("weight"), order, name="_weights")
    level = filled.agg(
        F.max((F.lit(total) - F.col("_limits")) / (F.lit(seen["all_weights"]) - F.col("_weights"))).alias("_level")
    ).first()["_level"]
    target = F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def leaning(due: Column, size: Column, mean: Column, most: int, lean: float) -> Column:
    """Copies due to a document of ``size``: those of its source, ``due``, moved by at most ``lean`` times what keeps them
    between 0 and ``most``. ``mean`` is the average of ``halfway(size)`` over the words of the source, so that the moves add
    up to no words."""
    return due + F.lit(lean) * due * (most - due) / most * (mean - halfway(size))


def halfway(size: Column) -> Column:
    """Rises from 0 to 1 with the size; 1/2 at 100 words."""
    return size / (size + 100.0)


def pareto_copies(
    due: DataFrame, group: list[str], target: str, most: int = MOST_COPIES, tie_break: tuple[str, ...] = ("doc_id", "size")
) -> DataFrame:
    """Add ``copies`` to documents with ``size``, ``due`` copies, a random ``u`` and the ``target`` words of their group.

    Whole copies are certain. The fractional parts compete by Pareto rank for what the group owes beyond them, in rounds;
    further copies up to ``most``, by odds of ``u``, fill what is left when no fractional part fits. ``target`` has to be
    the same in all rows of a group. Rows that agree in everything have equal chances.
    """
    columns = due.columns
    whole = F.least(F.floor("due"), F.lit(most)).cast("long")
    rows = shared_table(due.withColumn("_whole", whole).withColumn("copies", whole).withColumn("_row", F.monotonically_increasing_id()))
    part, extra = F.col("due") - F.col("_whole"), F.col("copies") - F.col("_whole")
    odds = F.col("u") / (1 - F.col("u"))
    first = (part > 0) & (extra == 0)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in group]
    while True:
        owed = rows.groupBy(*group).agg((F.max(target) - F.sum(F.col("copies") * F.col("size"))).alias("_owed"))
        fits = (
            rows.filter((F.col("size") > 0) & (F.col("copies") < most)).alias("r")
            .join(owed.alias("g"), on)
            .filter("size <= _owed")
            .select(
                "r.*", "_owed",
                F.when(first, 0).otherwise(extra + 1).alias("_turn"),
                F.when(first, odds / (part / (1 - part))).otherwise(odds).alias("_rank"),
            )
        )
        ranked = running_total(fits, F.col("size"), ["_turn", "_rank", *tie_break, "_row"], group, "_before")
        taken = ranked.filter(F.col("_before") + F.col("size") <= F.col("_owed")).select("_row", F.lit(1).alias("_more"))
        taken, seen = shared_table(taken, n=F.count(F.lit(1)))
        if not seen["n"]:
            return rows.select(*columns, "copies")
        more = F.col("copies") + F.coalesce("_more", F.lit(0))
        rows = shared_table(rows.join(taken, "_row", "left").withColumn("copies", more).drop("_more"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = SOURCE_WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = SEED,
    share: float = 1.0,
    lean: float = 1.0,
) -> DataFrame:
    """How often each document of ``(doc_id, text, source)`` goes into the mix.

    Returns ``doc_id, source, size, source_size, target, taken, copies, text_hash``, one row per input row. The mix is worth
    ``share`` of all words. ``lean`` says how much shorter documents are preferred, from 0 (not at all) to 1. A null or blank
    text has size 0 and takes nothing; a null source is a source of its own; rows with the same id share their random number
    and are told apart by size; an empty table gives no rows. Other columns are not looked at.
    """
    sized, seen = shared_checkpoint(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")),
        words=F.sum("size"),
    )
    total = int((seen["words"] or 0) * share)
    words = F.sum("size")
    sizes = sized.groupBy("source").agg(
        words.alias("source_size"),
        F.when(words > 0, F.sum(F.col("size") * halfway(F.col("size"))) / words).otherwise(0.0).alias("mean"),
    )
    targets = source_targets(sizes.drop("mean"), total, weights, most)
    of_source = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    null_safe = F.col("d.source").eqNullSafe(F.col("t.source"))
    rows = (
        sized.alias("d")
        .join(targets.join(sizes.select(F.col("source").alias("_s"), "mean"), F.col("source").eqNullSafe(F.col("_s"))).alias("t"), null_safe, "left")
        .select("d.*", "source_size", "target", "mean")
        .withColumn("due", leaning(of_source, F.col("size"), F.col("mean"), most, lean))
        .withColumn("u", uniform(F.col("doc_id"), seed))
    )
    copied = pareto_copies(rows, ["source"], "target", most)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return copied.select("doc_id", "source", "size", "source_size", "target", taken, "copies", "text_hash")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each repeated as often as ``mix_plan`` says, numbered by ``copy`` from 0.

    Rows with the same id and text share the copies of all of them evenly, rounded.
    """
    plan = (
        mix_plan(docs, **options)
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.round(F.avg("copies")).cast("int").alias("_copies"))
        .filter("_copies > 0")
    )
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    joined = keyed.join(
        plan.hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")),
    )
    times = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("copy")
    return joined.select(*docs.columns, times)
