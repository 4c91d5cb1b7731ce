"""Benchmark passages in a corpus, by word grams.

The grams of the benchmark become bits of a Bloom filter that is built on Spark. The corpus is scanned once: the digests of
its grams are tested against the filter before anything leaves a row, so clean texts give no rows at all. Only grams that
pass are spelled out and joined with the benchmark's, as strings, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.functions.shingles import scramble, windows, word_slices, words_of
from repoweave.session import shared_checkpoint

GRAM = 13
# Bits of the filter for each gram, and the largest filter (64 MB); a fuller one only lets more through to the join.
BITS_PER_GRAM = 16
MOST_FILTER_BITS = 1 << 29
HASHES = 3


def _slots(digest: np.ndarray, bits: int) -> np.ndarray:
    """Places of a digest in a filter of ``bits`` (a power of two) bits, one row per hash."""
    return np.stack([(scramble(digest + np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)])


def _grams(texts: DataFrame, sizes: list[int], passing=None, bits: int = 0, whole: bool = False) -> DataFrame:
    """``key, size, digest, gram`` of stretches of the given numbers of words in ``texts (key, text)``, as often as they
    occur. With ``passing`` only those that the filter lets through; with ``whole`` a shorter stretch than the longest only
    where it is the whole text."""
    longest = max(sizes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, owner, digest, count in word_slices(batch.column(1)):
                in_text = np.bincount(owner, minlength=count)
                first = np.concatenate([[0], np.cumsum(in_text)])
                for size in sizes:
                    at, found = windows(owner, digest, count, size)
                    found = scramble(found + np.uint64(size))
                    kept = in_text[owner[at]] == size if whole and size < longest else np.ones(len(at), dtype=bool)
                    if passing is not None:
                        filter_bits = passing.value
                        for slot in _slots(found, bits):
                            kept &= (filter_bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    at, found = at[kept], found[kept]
                    if not len(at):
                        continue
                    of = owner[at]
                    spelled: list[str] = []
                    for part in np.split(at, np.flatnonzero(of[1:] != of[:-1]) + 1):
                        row = owner[part[0]]
                        words = words_of(batch.column(1)[int(begin + row)].as_py())
                        for i in (part - first[row]).tolist():
                            spelled.append(b" ".join(words[i : i + size]).decode("utf-8"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(begin + of)),
                            pa.array(np.full(len(at), size, dtype=np.int32)),
                            pa.array(found.view(np.int64)),
                            pa.array(spelled, pa.string()),
                        ],
                        names=["key", "size", "digest", "gram"],
                    )

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(scan, f"key {kind}, size int, digest long, gram string")


def _filter_bits(digests: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``digest``, built as pieces of 32,768 bits on Spark."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots) + 1)], names=["slot"])

    slots = digests.select("digest").mapInArrow(place, "slot long")
    pieces = slots.groupBy(F.bitmap_bucket_number("slot").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    out = np.zeros(max(bits >> 3, 4096), dtype=np.uint8)
    for row in pieces.collect():
        begin = (row["piece"] - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def shared_grams(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, n: int = GRAM
) -> DataFrame:
    """``doc_key, item_key, grams``: every document and item that share a stretch of ``n`` words, and how many different ones.

    Words are runs of anything but blanks and line breaks, with A-Z in lower case. An item of fewer than ``n`` words has to
    stand in the document as a whole. Null, empty and blank texts share nothing; rows with equal keys count as one; an empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_key).alias("key"), F.col(item_text).alias("text"))
    grams, seen = shared_checkpoint(
        _grams(texts, list(range(1, n + 1)), whole=True).distinct().withColumnRenamed("key", "item"), n=F.count(F.lit(1))
    )
    if not seen["n"]:
        return spark.createDataFrame([], f"{doc_key} {docs.schema[doc_key].dataType.simpleString()}, {item_key} "
                                         f"{items.schema[item_key].dataType.simpleString()}, grams long")  # fmt: skip
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n
    bits = min(1 << max(15, math.ceil(math.log2(seen["n"] * BITS_PER_GRAM))), MOST_FILTER_BITS)
    passing = spark.sparkContext.broadcast(_filter_bits(grams, bits))
    found = _grams(docs.select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text")), sizes, passing, bits).distinct()
    # One row per document, item and gram they share: what the report counts. A gram that stands in very many documents is
    # split by adaptive execution, as it may stand in several items.
    pairs = found.join(grams, ["gram", "size"]).select(found["key"], "item", "gram")
    return pairs.groupBy(F.col("key").alias(doc_key), F.col("item").alias(item_key)).agg(F.count(F.lit(1)).alias("grams"))


def without_benchmark(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_text: str, n: int = GRAM) -> DataFrame:
    """Documents that share no stretch of ``n`` words with any item. Rows without a key or text are kept."""
    numbered = items.select(F.lit(0).alias("_item"), F.col(item_text).alias("_text"))
    leaked = shared_grams(docs, doc_key, doc_text, numbered, "_item", "_text", n).select(F.col(doc_key).alias("_leaked"))
    return docs.join(leaked, F.col(doc_key) == F.col("_leaked"), "left_anti")
