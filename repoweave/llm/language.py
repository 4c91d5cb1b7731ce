"""Language of documents as a mixture inferred by expectation-maximisation.

Models are counts of byte n-grams per language, over all training texts, in a hashed table of fixed size. A document is a
bag of short stretches of words; the likelihood of a stretch in a language comes from its n-grams. Expectation-maximisation finds the shares of
the languages in the document. The set of languages is chosen by penalised likelihood: starting from all, the language with
the smallest share goes as long as the criterion ``log-likelihood - penalty * languages * log(stretches) / 2`` does not fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.llm.words import Flat, flat_slices, mix
from repoweave.session import shared_checkpoint

TABLE = 1 << 16
ORDERS = (3,)
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 1.0
# A document is a bag of stretches of this many words (the last one of a document is shorter).
STRETCH = 6
# Log-likelihood of a stretch is kept within this range of its best language, so that one odd stretch cannot decide.
RANGE = 24.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = True
_LETTER[97:123] = True
_LETTER[128:] = True
_GRAM = np.uint64(0x9E3779B97F4A7C15)
_ORDER_STEP = [np.uint64(mix(np.array([o], dtype=np.uint64))[0]) for o in range(8)]


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def word_grams(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (letter runs, lower case, a space before and after) as ``(word of each n-gram, its bucket, text of word)``."""
    low = flat.lower()
    starts, ends = low.runs(_LETTER[low.data])
    size = ends - starts + 2
    place = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(place[-1], 32, dtype=np.uint8)
    inside = np.ones(place[-1], dtype=bool)
    inside[place[:-1]] = False
    inside[place[1:] - 1] = False
    padded[inside] = low.data[_LETTER[low.data]]
    word = np.repeat(np.arange(len(starts)), size)
    codes = padded.astype(np.uint64)
    buckets, words = [], []
    rolling = np.zeros(len(padded), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(padded) - order + 1
        if n <= 0:
            break
        rolling = (rolling[:n] << np.uint64(8)) | codes[order - 1 :][:n]
        if order in ORDERS:
            ok = word[:n] == word[order - 1 :]
            mixed = mix((rolling[:n][ok] ^ _ORDER_STEP[order]) * _GRAM)
            buckets.append((mixed >> np.uint64(48)).astype(np.int64))
            words.append(word[:n][ok])
    if not buckets:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    return np.concatenate(words), np.concatenate(buckets), flat.doc_of(starts)


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # TABLE x languages, log-probability of a bucket


def fit(docs: DataFrame) -> Languages:
    """Counts over all texts of ``(text, lang)`` with both known; one table row of counts per language leaves a task."""
    training = docs.filter("text is not null and lang is not null").select("lang", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi, flat in flat_slices(batch.column(1)):
                word, bucket, doc = word_grams(flat)
                of_gram = doc[word]
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    counts = np.bincount(bucket[code[of_gram] == k], minlength=TABLE)
                    total[name] = total.get(name, 0) + counts
            if len(total) > 64:
                yield from written(total)
                total = {}
        yield from written(total)

    def written(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(counts[used])],
                names=["lang", "bucket", "n"],
            )

    counted = training.mapInArrow(scan, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = shared_checkpoint(counted).toArrow()  # at most TABLE rows per language
    names = sorted(set(rows.column("lang").to_pylist()), key=lambda s: s.encode())
    counts = np.zeros((TABLE, max(1, len(names))))
    at = {name: i for i, name in enumerate(names)}
    column = np.array([at[name] for name in rows.column("lang").to_pylist()], dtype=np.int64)
    counts[rows.column("bucket").to_numpy(), column] = rows.column("n").to_numpy()
    smooth = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * TABLE))
    return Languages(names, np.asfortranarray(smooth))


def stretch_scores(flat: Flat, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each stretch per language, less that of its best one, and the text of each stretch."""
    word, bucket, doc = word_grams(flat)
    if not len(doc):
        return np.zeros((0, table.shape[1])), doc
    first = np.searchsorted(doc, np.arange(flat.n + 1))
    new = (np.arange(len(doc)) - first[doc]) % STRETCH == 0
    stretch = np.cumsum(new) - 1
    of = stretch[word]
    scores = np.stack(
        [np.bincount(of, weights=table[:, k][bucket], minlength=stretch[-1] + 1) for k in range(table.shape[1])], axis=1
    )
    scores /= len(ORDERS)  # n-grams of several orders tell of the same letters
    scores -= scores.max(axis=1, keepdims=True)
    return np.maximum(scores, -RANGE), doc[new]


def mixtures(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Shares of languages per text, for all texts at once; rows of texts without stretches are 0."""
    k = scores.shape[1]
    words = np.bincount(doc, minlength=n)
    chances = np.exp(scores)

    def em(alive: np.ndarray, texts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihoods of the chosen texts with the languages that are alive in each."""
        picked = np.zeros(n, dtype=bool)
        picked[texts] = True
        rows = np.flatnonzero(picked[doc])
        local = np.cumsum(picked) - 1
        of = local[doc[rows]]
        p = chances[rows] * alive[texts][of]
        shares = start[texts] * alive[texts]
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
        for _ in range(ROUNDS):
            parts = p * shares[of]
            total = np.maximum(parts.sum(axis=1), 1e-300)
            parts /= total[:, None]
            shares = np.stack([np.bincount(of, weights=parts[:, j], minlength=len(texts)) for j in range(k)], axis=1)
            shares /= np.maximum(words[texts], 1)[:, None]
        fit_ = np.log(np.maximum((p * shares[of]).sum(axis=1), 1e-300))
        return shares, np.bincount(of, weights=fit_, minlength=len(texts))

    alive = np.ones((n, k), dtype=bool)
    shares = np.full((n, k), 1.0 / k)
    likelihood = np.zeros(n)
    texts = np.flatnonzero(words)
    shares[words == 0] = 0.0
    if not len(texts):
        return shares
    shares[texts], likelihood[texts] = em(alive, texts, shares)
    price = PENALTY * np.log(np.maximum(words, 2)) / 2
    for _ in range(k - 1):
        smaller = alive.copy()
        ranked = np.where(alive, shares, np.inf)
        drop = ranked[texts].argmin(axis=1)
        smaller[texts, drop] = False
        new, fit_ = em(smaller, texts, shares)
        better = (fit_ + price[texts] >= likelihood[texts]) & (alive[texts].sum(axis=1) > 1)
        texts, new, fit_ = texts[better], new[better], fit_[better]
        if not len(texts):
            break
        alive[texts], shares[texts], likelihood[texts] = smaller[texts], new, fit_
    return shares


def languages(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` of every row of ``(doc_id, text)``, learned from ``labelled (text, lang)``.

    ``lang_pred`` is the language with the largest share (of equal ones, the first by code points), ``score`` its share,
    ``mixture`` all languages of the chosen set with their shares. A null text or one without a letter is ``und`` with score
    0, and so is every text when nothing is labelled. Rows are independent: repeated rows and null ids come out as they
    went in; an empty table gives no rows; other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for lo, hi, flat in flat_slices(batch.column(1)):
                if known.names:
                    shares = mixtures(*stretch_scores(flat, known.table), flat.n)
                else:
                    shares = np.zeros((flat.n, 1))
                shares[~batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)] = 0.0
                best = shares.argmax(axis=1)
                score = shares[np.arange(flat.n), best]
                names = [known.names[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)]
                sets = [
                    ",".join(f"{known.names[j]}:{row[j]:.4f}" for j in np.argsort(-row, kind="stable") if row[j] > 1e-4)
                    for row in shares
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names), pa.array(np.clip(score, 0.0, 1.0)), pa.array(sets)],
                    names=["doc_id", "lang_pred", "score", "mixture"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    return docs.select("doc_id", "text", letter).mapInArrow(scan, f"doc_id {id_type}, lang_pred string, score double, mixture string")


def identify(docs: DataFrame) -> DataFrame:
    """``languages`` for a table that carries its own labels: learned from rows whose id does not hash to the held-out
    fold, applied to all. The language column is never an input of a prediction."""
    marked = languages(docs.select("doc_id", "text"), docs.filter(~held_out()).select("text", "lang"))
    return marked.withColumn("held_out", held_out())
