"""Token counts with a whole-token shortcut.

A byte-level BPE file splits a text into pre-tokens first and merges inside each. Most pre-tokens are vocabulary strings
that come out of the merges as one token. Which ones do is proved before the scan: every vocabulary string that is a
single pre-token is encoded alone by the library, and those that give one id form the shortcut set. In the scan such a
pre-token counts 1; only the others are merged, once per distinct string of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-token pattern of byte-level BPE files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LIMIT = 512
KNOWN_STRINGS = 200_000
SLICE_CHARS = 2_000_000


def _bytes_of_signs() -> dict[str, int]:
    """The printable sign that a byte-level vocabulary writes for each byte, reversed: printable Latin-1 stands for
    itself, all other bytes are numbered from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _library_counts(path: str, strings: list[str]) -> list[int]:
    if not strings:
        return []
    return [len(e.ids) for e in _library(path).encode_batch(strings, add_special_tokens=False)]


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token. Bounded by the vocabulary."""
    tokenizer, signs, pattern = _library(path), _bytes_of_signs(), regex.compile(PRE_TOKEN)
    specials = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    candidates = []
    for sign_string in tokenizer.get_vocab(with_added_tokens=False):
        try:
            string = bytes(signs[c] for c in sign_string).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if string not in specials and pattern.fullmatch(string) and pattern.findall(string) == [string]:
            candidates.append(string)
    return frozenset(s for s, n in zip(candidates, _library_counts(path, candidates), strict=True) if n == 1)


class PreTokenCounter:
    """Counts tokens of texts for one vocabulary file; ``known`` remembers merged strings up to a bound."""

    def __init__(self, path: str, shortcut: frozenset[str]):
        self.path, self.shortcut = path, shortcut
        self.pattern = regex.compile(PRE_TOKEN)
        added = _library(path).get_added_tokens_decoder().values()
        self.specials = regex.compile("|".join(regex.escape(t.content) for t in added)) if added else None
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of ``text`` and the number of special strings in it, which count one token each."""
        if self.specials is None or not self.specials.search(text):
            return self.pattern.findall(text), 0
        parts = self.specials.split(text)
        return [t for part in parts for t in self.pattern.findall(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        shortcut, known, rest, found = self.shortcut, self.known, set(), []
        for text in texts:
            pre, special = self.pre_tokens(text)
            whole = [t for t in pre if t not in shortcut]
            found.append((len(pre) - len(whole) + special, whole))
            rest.update(t for t in whole if t not in known)
        if len(known) + len(rest) > KNOWN_STRINGS:
            rest.update(t for _, whole in found for t in whole)
            known.clear()
        new = list(rest)
        known.update(zip(new, _library_counts(self.path, new), strict=True))
        return [n + sum(map(known.__getitem__, whole)) for n, whole in found]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``(doc_id, text)``.

    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text count as the library takes them by
    default. Rows are independent: repeated rows and null ids come out as they went in, an empty table gives no rows,
    other columns are not looked at. ``path`` must be readable on every executor.
    """
    shortcut = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PreTokenCounter(path, shortcut.value)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            counts = [n for group in _groups(texts) for n in counter.count(group)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.array(counts, dtype=np.int64))],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    narrow = docs.select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    counted = narrow.mapInArrow(scan, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
