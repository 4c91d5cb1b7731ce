"""Small tables with everything that a column can hold, and plain counterparts of the operators."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = (
    "The river ran past the old mill and the miller counted sacks of grain by the door. "
    "Every evening a lamp was lit above the bridge so that carts could find the road in fog. "
    "Nobody in the village remembered who had built the tower or why its bell had no clapper at all. "
)
OTHER = (
    "Der Fluss lief an der alten Muehle vorbei und der Mueller zaehlte die Saecke neben der Tuer. "
    "Jeden Abend wurde eine Lampe ueber der Bruecke angezuendet damit die Wagen den Weg fanden. "
)


def odd_rows():
    """Nulls in every column, empty and blank texts, one word, ties, repeated rows, and a very long text."""
    long_text = " ".join(f"word{i % 997} {i}" for i in range(30_000))
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE + "One more line here.", "en", "b", None),
        (4, OTHER, "de", None, 3), (5, None, "en", "a", 0), (6, "", "en", "c", 0), (7, " \t\n ", None, "c", 3), (8, "word", "de", "b", 4),
        (None, PROSE.replace("river", "stream"), "en", "b", 5), (None, None, None, None, None), (9, long_text, "en", "c", 6),
        (10, OTHER.upper(), "de", "a", 1), (11, "naïve café \U0001f600 日本語 текст", "fr", "b", 2), (12, "a\x00b   c", "en", "a", 1),
        (13, PROSE * 3, "en", "d", 9),
    ]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def clashing(df):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["n", "class", "size", "target", "owed", "block", "learn", "text_key", "anchor", "kept", "k0", "c0", "copies", "hit"]
    return df.select("*", *[F.lit("x").alias(name) for name in names])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(rows, n, percent):
    """``{row number: (set size, smallest id that is reached)}`` by comparing all pairs."""
    sets = [shingles(text, n) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def same(a, b):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def quality_counts(text):
    text = text or ""
    words, seen, duplicates = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)
