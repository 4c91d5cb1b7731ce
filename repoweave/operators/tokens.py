"""Token rows for training: encode, truncate, pad, label, and lay out as one stream.

A tokenizer is a plug-in: a function that is called once per Python worker and returns ``list[str] -> list of id
lists``. Two come with the package. ``byte_tokenizer`` needs no vocabulary. ``word_tokenizer`` uses a vocabulary
counted on Spark; its size is fixed by the caller, like that of any pretrained tokenizer, and a piece outside it is
spelled in bytes, so encoding loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoweave.operators.joins import attach
from repoweave.operators.numbering import running_total, sort_column
from repoweave.operators.ordering import sample_rows
from repoweave.session import shared_checkpoint, shared_table

# Ids 0-255 are bytes; the end token doubles as padding.
END_ID = 256
FIRST_WORD_ID = 257
# Label value that the loss ignores.
IGNORED_LABEL = -100

# The end marker of records is the end token, wherever it stands.
END_TEXT = "<|endoftext|>"

# A word takes the blank before it; other blanks stand alone. Joined, the pieces give the text back. The end marker is a
# piece of its own: texts are split at it first.
PIECE = r" ?[^ \n\r\t]+|[ \n\r\t]"

# Rows of ids: lists, byte strings or arrays.
Encoder = Callable[[Sequence[str]], Sequence[Sequence[int]]]


def _array(row: Sequence[int]) -> np.ndarray:
    return np.frombuffer(row, dtype=np.uint8).astype(np.int32) if isinstance(row, bytes) else np.asarray(row, dtype=np.int32)


def byte_tokenizer() -> Encoder:
    """The UTF-8 bytes of the text as ids, the end marker as the end id."""

    end = np.array([END_ID], dtype=np.int32)

    def encode(texts: Sequence[str]) -> list[Sequence[int]]:
        rows: list[Sequence[int]] = []
        for text in texts:
            first, *rest = text.split(END_TEXT)
            row: Sequence[int] = first.encode("utf-8")
            if rest:
                parts = [_array(row)]
                for part in rest:
                    parts += (end, _array(part.encode("utf-8")))
                row = np.concatenate(parts)
            rows.append(row)
        return rows

    return encode


_TOKENIZERS: dict[str, Callable[[], Encoder]] = {"bytes": byte_tokenizer}


def register_tokenizer(name: str, create: Callable[[], Encoder]) -> None:
    """Make a tokenizer factory available to configurations by name."""
    _TOKENIZERS[name] = create


def tokenizer(name: str) -> Callable[[], Encoder]:
    if name not in _TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; registered: {sorted(_TOKENIZERS)}")
    return _TOKENIZERS[name]


def word_pieces(text: Column) -> Column:
    """Pieces of a text in order, without end markers."""
    parts = F.split(text, END_TEXT.replace("|", r"\|"))
    return F.flatten(F.transform(parts, lambda part: F.regexp_extract_all(part, F.lit(PIECE), F.lit(0))))


def vocabulary(texts: DataFrame, size: int, column: str = "content") -> DataFrame:
    """The ``size`` most frequent pieces with their ids: ``(piece, n, token_id)``, by count, then piece.

    Counts are combined before the shuffle, so frequent words cost one row per task.
    """
    pieces = texts.select(F.explode(word_pieces(F.col(column))).alias("piece"))
    counts = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.orderBy(F.col("n").desc(), "piece").limit(size)
    by_rank = Window.orderBy(F.col("n").desc(), "piece")  # over at most ``size`` rows
    return kept.withColumn("token_id", (F.row_number().over(by_rank) + (FIRST_WORD_ID - 1)).cast("int"))


# Largest vocabulary that is shipped to every worker.
MAX_VOCABULARY = 1_000_000


def _piece_ids(vocab: DataFrame) -> dict[str, int]:
    rows = vocab.select("piece", "token_id").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary may hold at most {MAX_VOCABULARY} pieces")
    return {row["piece"]: row["token_id"] for row in rows}


def word_tokenizer(vocab: DataFrame) -> Callable[[], Encoder]:
    """Tokenizer factory over a vocabulary of fixed size, shipped to the workers as a broadcast variable."""
    shared = vocab.sparkSession.sparkContext.broadcast(_piece_ids(vocab))

    def create() -> Encoder:
        import re

        known = shared.value
        split = re.compile(PIECE).findall

        def ids_of(part: str) -> list[int]:
            pieces = split(part)
            ids = list(map(known.get, pieces))
            if None not in ids:
                return ids
            out: list[int] = []
            for piece, token in zip(pieces, ids):
                out.extend(piece.encode("utf-8")) if token is None else out.append(token)
            return out

        def encode(texts: Sequence[str]) -> list[list[int]]:
            rows = []
            for text in texts:
                first, *rest = text.split(END_TEXT)
                row = ids_of(first)
                for part in rest:
                    row.append(END_ID)
                    row += ids_of(part)
                rows.append(row)
            return rows

        return encode

    return create


def decode_words(ids: Column, vocab: DataFrame) -> Column:
    """Text of word-tokenizer ids; end and padding ids are left out."""
    shared = vocab.sparkSession.sparkContext.broadcast({i: piece.encode() for piece, i in _piece_ids(vocab).items()})

    @F.pandas_udf(T.StringType())
    def decode(rows: pd.Series) -> pd.Series:
        spelled = {**shared.value, END_ID: b"", **{i: bytes([i]) for i in range(END_ID)}}
        return rows.map(lambda row: b"".join([spelled[i] for i in row]).decode("utf-8", "ignore"))

    return decode(ids)


def token_preview(texts: DataFrame, vocab: DataFrame, key: str, n: int, seed: int, column: str = "content") -> DataFrame:
    """A few rows for the eye: ids and the text they stand for. Keys are drawn first, so only these rows are moved and
    tokenized."""
    drawn = sample_rows(texts.select(key), key, n, seed)
    few = texts.join(F.broadcast(drawn), key, "left_semi")  # at most ``n`` keys
    shown = tokenize(few, word_tokenizer(vocab), column)
    return shown.select(key, "input_ids", decode_words(F.col("input_ids"), vocab).alias("decoded"))


# Where ids stand that were made in order: the slice, and the ids of the slice before and after the row.
SLICE, BEGIN, END = "_slice", "_begin", "_end"


def tokenize(df: DataFrame, create: Callable[[], Encoder], column: str = "content", order_by: Sequence[str] = ()) -> DataFrame:
    """Replace ``column`` by ``input_ids``. The tokenizer is built once per task and fed Arrow batches.

    With ``order_by`` the texts are range-sorted first and ids are numbered as they are made, in three more columns, so that
    ``place_tokens`` in the same order moves no ids. Rows may be filtered or changed only after that.
    """
    if order_by:
        order = [sort_column(c) for c in order_by]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    others = [f for f in df.schema.fields if f.name != column]
    fields = [*others, T.StructField("input_ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, T.StructField(BEGIN, T.LongType()), T.StructField(END, T.LongType())] if order_by else fields)
    names = [f.name for f in others]

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, begin = create(), 0
        for batch in batches:
            rows = [_array(row) for row in encode([text or "" for text in batch.column(column).to_pylist()])]
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            at = [pa.array(begin + ends[:-1]), pa.array(begin + ends[1:])] if order_by else []
            begin += int(ends[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, *at], names=schema.names)

    encoded = df.mapInArrow(encode_batches, schema)
    if not order_by:
        return encoded
    return encoded.withColumn(SLICE, F.spark_partition_id().alias(SLICE, metadata={"order_by": list(order_by)}))


def pad_truncate(ids: Column, length: int, pad: int = END_ID, truncation: bool = True) -> Column:
    """Ids brought to ``length``. Without truncation a longer row is left as it is."""
    padding = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(F.slice(ids, 1, length) if truncation else ids, padding)


def attention_mask(ids: Column, length: int, truncation: bool = True) -> Column:
    """1 for each real token, 0 for padding, for ids not yet padded."""
    real = F.least(F.size(ids), F.lit(length)) if truncation else F.size(ids)
    blank = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), blank))


def lm_labels(ids: Column, pad: int = END_ID) -> Column:
    """Labels for next-token training: the ids, with the padding id masked."""
    return F.transform(ids, lambda x: F.when(x == F.lit(pad), F.lit(IGNORED_LABEL)).otherwise(x))


def training_rows(tokenized: DataFrame, length: int, pad: int = END_ID) -> DataFrame:
    """Fixed-length ``input_ids``, ``attention_mask`` and ``labels``."""
    return tokenized.withColumns(
        {
            "attention_mask": attention_mask(F.col("input_ids"), length),
            "input_ids": pad_truncate(F.col("input_ids"), length, pad),
        }
    ).withColumn("labels", lm_labels(F.col("input_ids"), pad))


def token_offsets(tokenized: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Where each row starts in the flat stream: the order columns plus ``n_tokens, offset``. Only lengths are sorted;
    they are checkpointed first, since the sort would tokenize a second time to sample its input."""
    names = [c.lstrip("-") for c in order_by]
    lengths = shared_checkpoint(tokenized.select(*names, F.size("input_ids").cast("long").alias("n_tokens")))
    return running_total(lengths, F.col("n_tokens"), order_by, name="offset")


def place_tokens(tokenized: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Token rows with ``n_tokens`` and ``offset``. They are staged as a table first, so the tokenizer runs once. Ids made in
    this order only need the totals of earlier slices, one row each; otherwise offsets are found from the lengths alone and
    joined. Rows with a null in an order column take up their place but are left out."""
    names = [c.lstrip("-") for c in order_by]
    counted = tokenized.withColumn("n_tokens", F.size("input_ids").cast("long"))
    if SLICE in tokenized.columns and tokenized.schema[SLICE].metadata.get("order_by") == list(order_by):
        off = F.count_if(F.col(END) - F.col(BEGIN) != F.col("n_tokens"))
        staged, seen = shared_table(counted, off=off)
        if seen["off"]:
            raise ValueError("ids were changed after they were numbered; tokenize without order_by")
        earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # over one row per slice
        totals = staged.groupBy(SLICE).agg(F.sum("n_tokens").alias("_total"))
        carried = totals.select(SLICE, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).cast("long").alias("offset"))
        placed = staged.dropna(subset=names).join(F.broadcast(carried), SLICE)
        return placed.withColumn("offset", F.col("offset") + F.col(BEGIN)).drop(SLICE, BEGIN, END)
    staged = shared_table(counted.drop(SLICE, BEGIN, END))
    offsets = running_total(staged.select(*names, "n_tokens"), F.col("n_tokens"), order_by, name="offset")
    return attach(staged, offsets.drop("n_tokens"), names)


def flatten_tokens(tokenized: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The stream itself: ``(position, token)``, one row per token."""
    placed = place_tokens(tokenized, order_by).select("offset", F.posexplode("input_ids").alias("_at", "token"))
    return placed.select((F.col("offset") + F.col("_at")).alias("position"), "token")
