"""Exact and near copies of texts.

Exact copies share a digest. Near copies are texts whose sets of word shingles have a Jaccard similarity of at least
``percent``; documents linked by a chain of such pairs form one component. Texts with equal sets are one class throughout.
Candidates come from min-hash signatures cut into bands: in a bucket of classes that agree in a band, every class meets the
smallest one only. Candidates are estimated from their signatures, then verified on the whole sets. Buckets whose members
then lie in different components are gone through a second time, in blocks of bounded size, and only for pairs of different
components. So no group is brought together, no pairs of a large cluster are listed, and no link between classes that share a
band is lost; a pair at exactly 80 % shares none of 24 bands of 4 with a chance of 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions.shingles import scramble, shingles, signatures, word_slices
from repoweave.operators.connected import connected_components
from repoweave.operators.joins import salted_join
from repoweave.session import shared_checkpoint

BANDS = 24
BAND_ROWS = 4
WORDS = 5
PERCENT = 80
# A pair is verified if its signatures agree in at least this much less than asked: five standard deviations.
ESTIMATE_SLACK = 0.2
# Members of a bucket that are compared at a time in the second pass.
BLOCK = 128
# Largest number of class keys that is broadcast.
BROADCAST_KEYS = 1_000_000


def text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``digest, first_key, copies`` of every different text: the smallest key and the number of rows. Null texts are one group
    with a null digest. Combined before the shuffle, so a text that fills a third of all rows is no hot group."""
    return docs.groupBy(text_digest(F.col(text)).alias("digest")).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))


def drop_exact(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with the smallest key of their text. Keys have to be unique; rows without a text or a key stay as they are."""
    kept = exact_groups(docs.filter(F.col(text).isNotNull() & F.col(key).isNotNull()), key, text)
    kept = kept.select(F.col("first_key").alias("_kept"))
    rest = docs.filter(F.col(text).isNull() | F.col(key).isNull())
    return docs.join(kept, F.col(key) == F.col("_kept"), "left_semi").unionByName(rest)


def _class_names(owner: np.ndarray, digest: np.ndarray, n: int) -> list[str]:
    """128 bits of each set of digests, from two sums over its members."""
    sums = np.zeros((2, n), dtype=np.uint64)
    np.add.at(sums[0], owner, scramble(digest))
    np.add.at(sums[1], owner, scramble(~digest))
    return [a.tobytes().hex() for a in np.ascontiguousarray(sums.T)]


def _sketched(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """``key, class, n, signature, bands`` of every row with a word; ``class`` is 128 bits of the set, ``bands`` a digest each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, owner, digest, count in word_slices(batch.column(1)):
                owner, digest = shingles(owner, digest, count, words)
                n = np.bincount(owner, minlength=count)
                signature = signatures(owner, digest, count, bands * rows)
                band = np.zeros((count, bands), dtype=np.uint64)
                for i in range(rows):
                    band = scramble(band * np.uint64(31) + signature[:, i::rows].astype(np.uint64) + np.uint64(i))
                has = np.flatnonzero(n)
                lists = pa.ListArray.from_arrays(
                    pa.array((np.arange(len(has) + 1) * bands).astype(np.int32)), pa.array(band[has].view(np.int64).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, count).take(pa.array(has)),
                        pa.array(_class_names(owner, digest, count), pa.string()).take(pa.array(has)),
                        pa.array(n[has]),
                        pa.array([s.tobytes() for s in signature[has]], pa.binary()),
                        lists,
                    ],
                    names=["key", "class", "n", "signature", "bands"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(scan, f"key {kind}, class string, n long, signature binary, bands array<long>")


def _sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``key, class, shingles`` of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, owner, digest, count in word_slices(batch.column(1)):
                owner, digest = shingles(owner, digest, count, words)
                offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(digest.view(np.int64)))
                names = pa.array(_class_names(owner, digest, count), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, count), names, lists], names=["key", "class", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(scan, f"key {kind}, class string, shingles array<long>")


def _agreeing(left: str, right: str, length: int) -> Column:
    """Share of equal values in two signatures."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), dtype=np.uint32).reshape(-1, length)
        y = np.frombuffer(b"".join(b), dtype=np.uint32).reshape(-1, length)
        return pd.Series((x == y).mean(axis=1))

    return share(left, right)


def _starred(members: DataFrame) -> DataFrame:
    """``a, b``: every class with the smallest class of each of its buckets; ``members`` is ``(band, bucket, class)``."""
    least = members.groupBy("band", "bucket").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = salted_join(members, least.drop("m"), ["band", "bucket"], ["class"])
    return met.filter("a <> class").select("a", F.col("class").alias("b")).distinct()


def _crossing(members: DataFrame, components: DataFrame, signed: DataFrame, least: float, length: int) -> DataFrame:
    """``a, b``: pairs of classes in one bucket that lie in different components and whose signatures agree well enough. The
    smallest class of a bucket has met all others, so a bucket of two holds no new pair."""
    labelled = members.join(components.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "class"))
    split = labelled.groupBy("band", "bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")
    )
    split = split.filter("low <> high and m > 2").select("band", "bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    open_ = salted_join(labelled, split, ["band", "bucket"], ["class"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    placed = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.join(signed, "class").select(
        "band", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "component", "signature"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.drop_duplicates("class")
        x, y = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        out = []
        if len(x) and len(y):
            left = np.frombuffer(b"".join(x["signature"]), dtype=np.uint32).reshape(-1, length)
            right = np.frombuffer(b"".join(y["signature"]), dtype=np.uint32).reshape(-1, length)
            classes, parts = y["class"].to_numpy(), y["component"].to_numpy()
            for name, part, signature in zip(x["class"], x["component"], left, strict=True):
                near = np.flatnonzero(((right == signature).mean(axis=1) >= least) & (parts != part))
                out += [(min(name, classes[k]), max(name, classes[k])) for k in near]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"])

    return placed.groupBy("band", "bucket", "i", "j").applyInPandas(compare, "a string, b string").distinct()


def near_components(
    docs: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """``key, n_shingles, component, links`` of every row: the smallest key of its component (its own if it has no copies), and
    the number of verified candidate links of its class.

    Null, empty and blank texts have no shingles and are linked with nothing, and so is a row without a key; rows with equal
    sets are linked; equal keys are rows of their own; an empty table gives no rows.
    """
    length, least = bands * rows, percent / 100 - ESTIMATE_SLACK
    sketched = shared_checkpoint(_sketched(docs, key, text, words, bands, rows))
    classes = shared_checkpoint(
        sketched.filter("key is not null").groupBy("class").agg(
            F.min("key").alias("first_key"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
        )
    )
    signed = classes.select("class", "signature")
    members = classes.select("class", F.posexplode("bands").alias("band", "bucket"))

    def verified(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Of ``(a, b)`` those that reach ``percent``. Sets are made again from the texts of the classes that take part."""
        pairs, seen = shared_checkpoint(pairs, n=F.count(F.lit(1)))
        wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        wanted, part = shared_checkpoint(wanted.join(classes, "class").select("class", F.col("first_key").alias("key")), n=F.count(F.lit(1)))
        small = part["n"] <= BROADCAST_KEYS
        chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        chosen = chosen.join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), "key")
        made = shared_checkpoint(
            _sets(chosen, "key", "text", words).join(wanted, ["key", "class"]).groupBy("class").agg(F.first("shingles").alias("shingles"))
        )
        left = made.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
        right = made.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
        both = salted_join(salted_join(pairs, left, ["a"], ["b"], rows=seen["n"]), right, ["b"], ["a"], rows=seen["n"])
        shared = F.size(F.array_intersect("x", "y"))
        kept = both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared))
        return shared_checkpoint(kept.select("a", "b"))

    def signed_pairs(pairs: DataFrame) -> DataFrame:
        left = signed.select(F.col("class").alias("a"), F.col("signature").alias("x"))
        right = signed.select(F.col("class").alias("b"), F.col("signature").alias("y"))
        both = salted_join(pairs, left, ["a"], ["b"]).join(right, "b")
        return both.filter(_agreeing("x", "y", length) >= least).select("a", "b")

    links = verified(signed_pairs(_starred(members)))
    crossing = _crossing(members, connected_components(links), signed, least, length)
    links = shared_checkpoint(links.union(verified(crossing)).distinct())
    found = connected_components(links)
    named = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least_key = named.groupBy("component").agg(F.min("first_key").alias("least_key"))
    degree = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").count()
    named = salted_join(named.select("class", "component"), least_key, ["component"], ["class"]).join(degree, "class", "left")
    named = named.select("class", "least_key", F.coalesce("count", F.lit(0)).alias("links"))
    rows_of = salted_join(sketched.filter("key is not null").select("key", "class", "n"), named, ["class"], ["key"])
    linked = rows_of.select("key", F.col("n").alias("n_shingles"), F.col("least_key").alias("component"), "links")
    zero = F.lit(0).cast("long")
    without = sketched.filter("key is null").select("key", F.col("n").alias("n_shingles"), F.col("key").alias("component"), zero.alias("links"))
    blank = docs.filter(~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return linked.unionByName(without).unionByName(blank.select(F.col(key).alias("key"), zero.alias("n_shingles"), F.col(key).alias("component"), zero.alias("links")))


def drop_near(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """One row of each component: that with the smallest key. Rows without words stay as they are; keys have to be unique."""
    kept = near_components(docs, key, text, **options).filter(F.col("key").eqNullSafe(F.col("component")))
    kept = kept.select(F.col("key").alias("_kept")).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
