"""Quality rules as a learned decision list.

Sequential covering over labelled statistics of documents: a rule is a conjunction of thresholds, grown on two thirds of
the labelled rows by information gain, pruned on the rest, and kept while it is precise there. The rows it covers are set
aside and the next rule is grown. The list is emitted as one ordered Spark conditional expression over the statistics, so
every verdict can be read as a rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.llm.words import Flat, flat_slices, grams, span_hash

# Bound of the labelled sample that rules and flagged words are learned from: rows with the smallest digests.
SAMPLE = 4000
SAMPLE_CHARS = 4000
MAX_RULES = 12
MAX_TERMS = 4
CANDIDATE_CUTS = 32
MIN_COVERED = 4
MIN_PRECISION = 0.9
FLAGGED_WORDS = 256

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_chars_all", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_flagged"]
STATISTICS = [
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share",
    "distinct_share", "mean_line", "n_flagged",
]


def _hash_words(words: list[str]) -> np.ndarray:
    """Hashes of words as ``counts_of`` sees them, sorted."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    _, _, flat = next(flat_slices(pa.array(words, pa.string()), 1 << 40))
    return np.sort(span_hash(flat.prefix_hash(), flat.offsets[:-1], flat.offsets[1:]))


def counts_of(flat: Flat, flagged: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of the texts of a slice. ``flagged`` are sorted hashes of lower-case letter runs."""
    data, n = flat.data, flat.n

    def by_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(flat.doc_of(np.flatnonzero(mask)), minlength=n)

    prefix = flat.prefix_hash()
    starts, ends = flat.words()
    doc = flat.doc_of(starts)
    words = span_hash(prefix, starts, ends)
    out = {"n_words": np.bincount(doc, minlength=n)}
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    out["word_chars"] = np.bincount(doc, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64)
    out["n_chars_all"] = lead[flat.offsets[1:]] - lead[flat.offsets[:-1]]
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = by_text(table[data])

    # Lines with a word, equal to an earlier line of the text: sort by (text, line), count all but one of each.
    line_starts, line_ends = flat.runs(data != 10)
    line_doc = flat.doc_of(line_starts)
    has_word = np.searchsorted(starts, line_starts, side="left") < np.searchsorted(starts, line_ends, side="left")
    line_starts, line_ends, line_doc = line_starts[has_word], line_ends[has_word], line_doc[has_word]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    lines = span_hash(prefix, line_starts, line_ends)
    order = np.lexsort((lines, line_doc))
    same = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    out["n_dup_lines"] = np.bincount(line_doc[order][1:][same], minlength=n)

    # Words inside a 3-word window that the text holds at least twice.
    windows = grams(words, 3)
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(words) > 2 else np.zeros(0, dtype=np.int64)
    window, window_doc = windows[at], doc[at]
    order = np.lexsort((window, window_doc))
    same = (window[order][1:] == window[order][:-1]) & (window_doc[order][1:] == window_doc[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[at[twice] + shift] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    order = np.lexsort((words, doc))
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out["n_distinct"] = np.bincount(doc[order][fresh], minlength=n)
    out["n_flagged"] = np.zeros(n, dtype=np.int64)
    if len(flagged):
        low = flat.lower()
        a, b = low.runs(_LETTER[low.data] | (low.data >= 128))
        found = span_hash(low.prefix_hash(), a, b)
        place = np.minimum(np.searchsorted(flagged, found), len(flagged) - 1)
        hit = flagged[place] == found
        out["n_flagged"] = np.bincount(flat.doc_of(a[hit]), minlength=n)
    return out


def document_counts(docs: DataFrame, flagged: list[str], keep: list[str] | None = None) -> DataFrame:
    """``COUNTS`` and ``MORE_COUNTS`` of each row, beside the ``keep`` columns (``doc_id`` by default)."""
    keep = keep or ["doc_id"]
    marks = _hash_words(flagged)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, flat in flat_slices(batch.column(batch.num_columns - 1)):
                counts = counts_of(flat, marks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                    + [pa.array(counts[c].astype(np.int64)) for c in COUNTS + MORE_COUNTS],
                    names=[*[f"k{i}" for i in range(len(keep))], *COUNTS, *MORE_COUNTS],
                )

    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text_"))
    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema = ", ".join([*kinds, *[f"{c} long" for c in COUNTS + MORE_COUNTS]])
    return picked.mapInArrow(scan, schema)


def statistics() -> dict[str, Column]:
    """The statistics that rules test, as expressions over the counts; 0 where there is nothing to divide by."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    exprs = [
        F.col("n_words").cast("double"), share("word_chars", "n_words"), share("n_symbols", "n_words"),
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "n_letters"),
        share("n_digits", "n_chars_all"), share("n_marks", "n_words"), share("n_distinct", "n_words"),
        share("n_words", "n_lines"), F.col("n_flagged").cast("double"),
    ]
    return dict(zip(STATISTICS, exprs, strict=True))


@dataclass(frozen=True)
class Term:
    name: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, STATISTICS.index(self.name)]
        return column > self.cut if self.above else column <= self.cut

    def expression(self) -> Column:
        value = statistics()[self.name]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Term, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (t.holds(x) for t in rule), np.ones(len(x), dtype=bool))


def _cuts(values: np.ndarray) -> np.ndarray:
    """Cuts half way between neighbouring values, at most CANDIDATE_CUTS, evenly by rank."""
    distinct = np.unique(values)
    between = (distinct[1:] + distinct[:-1]) / 2
    if len(between) > CANDIDATE_CUTS:
        between = between[np.linspace(0, len(between) - 1, CANDIDATE_CUTS).astype(int)]
    return between


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Add the term with the best information gain until no bad row too many is covered."""
    rule: Rule = ()
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_TERMS and (inside & ~y).any() and (inside & y).any():
        p, n = (inside & y).sum(), (inside & ~y).sum()
        base, best = np.log2(p / (p + n)), (0.0, None)
        for name in STATISTICS:
            for cut in _cuts(x[inside, STATISTICS.index(name)]):
                for above in (True, False):
                    term = Term(name, above, float(cut))
                    covered = inside & term.holds(x)
                    p1, n1 = (covered & y).sum(), (covered & ~y).sum()
                    if p1 >= MIN_COVERED:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - base)
                        if gain > best[0] + 1e-12:
                            best = (gain, term)
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The beginning of the rule with the best ``(bad - good) / covered`` on the held-back rows."""

    def worth(r: Rule) -> float:
        covered = _covers(r, x)
        p, n = (covered & y).sum(), (covered & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """An ordered list of rules that say ``y``. Every third row is held back for pruning."""
    rules: list[Rule] = []
    held = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), dtype=bool)
    while len(rules) < MAX_RULES and (y & left & ~held).sum() >= MIN_COVERED:
        rule = _prune(_grow(x[left & ~held], y[left & ~held]), x[left & held], y[left & held])
        if not rule:
            break
        covered = _covers(rule, x) & left
        if (y & covered).sum() < MIN_PRECISION * covered.sum() or not (y & covered).any():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 when none does."""
    out: Column | None = None
    for i, rule in enumerate(rules, 1):
        holds = reduce(lambda a, b: a & b, [t.expression() for t in rule])
        out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _flagged_words(texts: pa.ChunkedArray, toxic: np.ndarray) -> list[str]:
    """Letter runs that mark toxic texts: seen in at least 1% of them (4 at least), ten times as often as elsewhere.

    Copies would make every word of theirs look like a mark, so a toxic text that shares half its words with an earlier
    one is passed over. The sample is bounded, and so is this comparison.
    """
    def words(text: str) -> set[str]:
        return set(re.findall(r"[a-z\u0080-\U0010ffff]+", text.translate(_LOWER_CASE)))

    different: list[set[str]] = []
    for i in np.flatnonzero(toxic):
        own = words(texts[int(i)].as_py() or "")
        if own and all(2 * len(own & other) <= min(len(own), len(other)) for other in different):
            different.append(own)
    often = max(4, len(different) / 100)
    seen = {w: c for w, c in Counter(w for own in different for w in own).items() if c >= often}
    elsewhere: Counter[str] = Counter()
    for i in np.flatnonzero(~toxic):  # one text at a time, and only words that may still count
        elsewhere.update(words(texts[int(i)].as_py() or "") & seen.keys())
    n, m = max(1, len(different)), max(1, int((~toxic).sum()))
    rate = {w: (c / n) / ((elsewhere[w] + 0.5) / m) for w, c in seen.items()}
    return sorted(sorted((w for w, r in rate.items() if r >= 10), key=lambda w: (-rate[w], w))[:FLAGGED_WORDS])


_LOWER_CASE = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class RuleList:
    rules: list[Rule]
    flagged: list[str]

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, rule)) for rule in self.rules)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleList:
    """Rules for documents to reject: those labelled ``quality = 0`` or ``toxic = 1``.

    Learned from at most ``sample`` labelled documents, those with the smallest digests of their id, so the choice does
    not depend on the order of rows. A toxic word is looked for in a stretch of SAMPLE_CHARS characters of each, from a
    place that the digest chooses. Labels of ids that occur more than once count as bad if any of them is; null labels
    count as good. Without labels the list is empty and rejects nothing.
    """
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")).alias("_poor"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("_toxic"),
    )
    digest = F.xxhash64(F.col("_id"), F.lit(6))
    chosen = marked.withColumn("_digest", digest).orderBy("_digest", "_id").limit(sample)
    few = F.broadcast(chosen)  # at most ``sample`` narrow rows
    labelled = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("_id"))
    shift = F.pmod("_digest", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    rows = (
        labelled.select("_id", "_poor", "_toxic", F.substring(F.col("text"), shift.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"))
        .orderBy("_id", "t")
        .toArrow()
    )
    toxic = np.array(rows.column("_toxic").to_pylist(), dtype=bool)
    flagged = _flagged_words(rows.column("t"), toxic) if len(toxic) else []
    counted = document_counts(labelled, flagged, ["_id", "_poor", "_toxic"])
    table = (
        counted.select(
            ((F.col("k1") == 1) | (F.col("k2") == 1)).alias("bad"),
            F.col("k0").alias("id"),
            *[e.alias(f"s_{name}") for name, e in statistics().items()],
        )
        .orderBy("id", "s_n_words")
        .toArrow()
    )
    bad = np.array(table.column("bad").to_pylist(), dtype=bool)
    x = np.stack([table.column(f"s_{name}").to_numpy() for name in STATISTICS], axis=1) if len(bad) else np.zeros((0, len(STATISTICS)))
    return RuleList(learn(x, bad), flagged)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``rule`` (first rule that rejects, 0: none) of every row.

    A null or empty text has no words and fails the base. Rows are independent: repeated rows and null ids come out as
    they went in; an empty table gives no rows; other columns are not looked at.
    """
    found = fit(docs, labels, sample)
    counted = document_counts(docs, found.flagged)
    return counted.select(
        F.col("k0").alias("doc_id"),
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & (verdict(found.rules) == 0)).alias("kept"),
        verdict(found.rules).alias("rule"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns as they are. Judged row by row, so nothing is joined."""
    found = fit(docs, labels, sample)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"))
    counted = document_counts(inner, found.flagged, [f"c{i}" for i in range(len(names))])
    good = counted.filter(~base_failed() & (verdict(found.rules) == 0))
    return good.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
