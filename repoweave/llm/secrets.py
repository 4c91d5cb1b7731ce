"""Secrets in texts: fixed patterns, and what a conditional random field finds beyond them.

The field is fitted to the pattern matches of the corpus as weak labels. These would only teach it the patterns again, so
matches are also shown without their keyword, and keys of the usual shapes, passwords behind other names and decoys are set
into lines of the corpus that have no match. It sees the shape of a token, its neighbours and the kind of file, so it also
tags values that no pattern names, and leaves long numbers and mail addresses alone.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm import crf
from repoweave.llm.words import flat_slices

# The base patterns. A failing match is consumed all the same.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_HEX_SIGNS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LONG_HEX = b"x" * 32
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("passw", "secret", "token", "api")

# Bounds of the training sample: lines with a match, lines without, and characters to both sides of a place.
MATCH_LINES = 300
OTHER_LINES = 500
AROUND = 200
FALSE_LINES, LOST = 1 / 500, 0.05
FIRST_ROUNDS, ROUNDS, STEP = 40, 80, 0.5
SHORTEST = 8
LONG_TOKEN = re.compile(r"[0-9][A-Za-z0-9+/_.-]{7}")

# Names that secrets go by beside those of the patterns, and what issued keys begin with, in code point order.
KEY_NAMES = "access_key auth bearer client_key credential credentials key pass passphrase private_key pwd".split()
PREFIXES = "ghp_ glpat- npm_ pk_live_ sk- sk_live_ xoxb-".split()
ALNUM = string.ascii_letters + string.digits
HEX_SIGNS = "0123456789abcdef"

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns in code points, by start, then kind."""
    spans: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if _LONG_HEX in text.encode("utf-8", "replace").translate(_HEX_SIGNS):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(spans)


def _marks(texts: list[str]) -> tuple[crf.Tokens, np.ndarray, np.ndarray]:
    """Tokens of the joined texts, the number of code points before each byte, and where each text begins."""
    _, _, flat = next(flat_slices(pa.array(texts, pa.string()), 1 << 40))
    starts_char = (flat.data & 0xC0) != 0x80
    chars = np.zeros(len(flat.data) + 1, dtype=np.int64)
    np.cumsum(starts_char, out=chars[1:])
    return crf.Tokens(flat), chars, flat.offsets


def _labelled(text: str, secrets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and states of a piece of text whose secrets are known, the tokens around the first one."""
    tokens, chars, _ = _marks([text])
    states = np.zeros(len(tokens.starts), dtype=np.int64)
    at = chars[tokens.starts]
    for lo, hi in sorted(secrets, reverse=True):
        inside = np.flatnonzero((at >= lo) & (at < hi))
        states[inside], states[inside[:1]] = crf.I, crf.B
    first = max(0, int(np.argmax(states > 0)) - crf.LINE_TOKENS // 2)
    return tokens.features()[first : first + crf.LINE_TOKENS], states[first : first + crf.LINE_TOKENS]


def _weak(text: str) -> list[tuple[int, int]]:
    """The secret parts of the pattern matches of a piece of text."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST]
    return spans + [(a, b) for a, k, b in base_spans(text) if k > 0]


def _training_line(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and weak states of a piece of text: the secret part of each match is begin, then inside."""
    return _labelled(text, _weak(text))


def _drawn_value(draw: random.Random) -> str:
    """A random key of one of the usual shapes."""
    shape = draw.randrange(5)
    signs = {0: HEX_SIGNS, 1: ALNUM + "+/"}.get(shape, ALNUM)
    value = "".join(draw.choices(signs, k=draw.randint(16, 44)))
    if shape == 4:
        return f"eyJ{value[:20]}.{value}.{''.join(draw.choices(signs + '-_', k=30))}"
    return draw.choice(PREFIXES) + value if shape == 3 else value


def _drawn_password(draw: random.Random, words: list[str]) -> str:
    """Words of the line with digits and capitals, as people choose them. Only a name in front makes it a secret."""
    value = (draw.choice(words) + draw.choice(words)).capitalize()[:12]
    return value + "".join(draw.choices("0123456789", k=max(2, 10 - len(value))))


def _named(draw: random.Random, name: str, value: str) -> str:
    return draw.choice(("{}: {}", "{}={}", '{} = "{}"', "{}: '{}'", "{} {}")).format(name, value)


def _drawn_decoy(draw: random.Random, words: list[str]) -> str:
    """What looks a little like a secret and is none: numbers, dates, versions, addresses, names of files and variables, and
    ordinary words behind the name of a secret."""
    one, two = draw.choice(words), draw.choice(words)
    number = "".join(draw.choices("0123456789", k=draw.randint(2, 18)))
    plain = draw.choice((
        number, f"{number[:4]}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}T1{draw.randint(0, 9)}:{draw.randint(10, 59)}:00",
        f"v{draw.randint(0, 30)}.{draw.randint(0, 9)}.{draw.randint(0, 9)}-rc{draw.randint(1, 9)}", f"+{draw.randint(1, 99)}-{number[:3]}-555-{draw.randint(1000, 9999)}",
        ".".join(str(draw.randint(1, 255)) for _ in range(4)), f"{one}.{number[:2]}@{two}{number[:1]}.example.com",
        f"{one}/{two}/{one}_{number[:4]}.txt", f"{one}_{two}_{number[:2]}", one + two.capitalize() + one.capitalize() + number[:1],
        f"https://www.{one}.org/{two}/{number[:6]}", f"{one}-{two}-{one}", one + two + one,
    ))
    shape = draw.randrange(3)
    return plain if shape == 0 else _named(draw, two, plain) if shape == 1 else _named(draw, draw.choice(KEY_NAMES), one)


def _set_in(line: str, secret: bool) -> tuple[str, list[tuple[int, int]]]:
    """The line with a drawn secret or decoy at a drawn place, and where secrets are; a pattern match of the line loses its
    keyword, so that shape and neighbours have to tell. The draws depend on the line alone."""
    draw = random.Random(hashlib.md5(line.encode("utf-8", "replace")).digest())
    words = [w for w in re.findall(r"[^\W\d_]{2,12}", line) if w.lower() not in KEYWORDS] or ["word"]
    if _weak(line):
        name = draw.choice(KEY_NAMES) if draw.random() < 0.5 else draw.choice(words)
        line = ASSIGN.sub(lambda m: m[0].replace(m[1], name, 1), line)
        return line, [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", line) if any(c.isdigit() for c in m[0])]
    at = draw.choice([0, *(m.end() for m in re.finditer(r"\s+", line)), len(line)])
    if not secret:
        return f"{line[:at]} {_drawn_decoy(draw, words)} {line[at:]}", []
    shape = draw.randrange(4)
    value = _drawn_password(draw, words) if shape == 0 else _drawn_value(draw)
    name = draw.choice(KEY_NAMES) if shape < 2 else draw.choice(words)
    piece = value if shape == 3 else _named(draw, name, value)
    begin = at + 1 + piece.index(value)
    return f"{line[:at]} {piece} {line[at:]}", [(begin, begin + len(value))]


def _with_drawn(line: str, secret: bool) -> tuple[np.ndarray, np.ndarray]:
    return _labelled(*_set_in(line, secret))


def _window(text: str, start: int, end: int) -> str:
    """The line around a place, at most AROUND characters to both sides, whole words; of a very long match its begin."""
    end = min(end, start + AROUND)
    begin = max(text.rfind("\n", 0, start) + 1, start - AROUND)
    stop = text.find("\n", end, end + AROUND)
    stop = min(len(text), end + AROUND) if stop < 0 else stop
    left = text.find(" ", begin, start) + 1 if begin == start - AROUND else begin
    right = text.rfind(" ", end, stop) if stop == end + AROUND else stop
    return text[max(begin, left) : stop if right < 0 else right]


def _places(text: str) -> Iterator[tuple[int, int, bool]]:
    """``start, end, positive`` of all matches and all long numbers of a text that no window before them holds, and of one
    place drawn from the whole text."""
    spans = base_spans(text)
    for found, positive in ((((a, b) for a, _, b in spans), True), ((m.span() for m in LONG_TOKEN.finditer(text)), False)):
        after = -1
        for a, b in found:
            if a > after:
                yield a, b, positive
                after = a + AROUND // 2
    at = zlib.crc32(text.encode("utf-8", "replace")) % len(text)
    yield at, at, False


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate training lines of a task, the smallest digests of each kind: ``positive, digest, line``."""
    best: dict[bool, dict[str, str]] = {True: {}, False: {}}
    limits = {True: MATCH_LINES, False: 2 * OTHER_LINES}
    last = {True: "g", False: "g"}  # above all digests

    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py()
            if not text:
                continue
            for start, end, positive in _places(text):
                line, kept, limit = _window(text, start, end), best[positive], limits[positive]
                digest = hashlib.md5(line.encode("utf-8", "replace")).hexdigest()
                if not line or digest >= last[positive] or (not positive and base_spans(line)):
                    continue
                kept[digest] = line
                if len(kept) >= 2 * limit:
                    for more in sorted(kept)[limit:]:
                        del kept[more]
                    last[positive] = max(kept)
    for positive, kept in best.items():
        digests = sorted(kept)[: limits[positive]]
        if digests:
            yield pa.RecordBatch.from_arrays(
                [pa.array([positive] * len(digests)), pa.array(digests), pa.array([kept[d] for d in digests])],
                names=["positive", "digest", "line"],
            )


def fit(docs: DataFrame) -> crf.Model | None:
    """The field fitted to at most MATCH_LINES + OTHER_LINES lines of the corpus, those with the smallest digests, so the
    sample depends on the set of texts alone; as many other lines set the threshold. None when no text has a pattern match."""
    lines = docs.select("text").mapInArrow(_samples, "positive boolean, digest string, line string").distinct()
    positive = [r.line for r in lines.filter("positive").orderBy("digest").limit(MATCH_LINES).collect()]
    if not positive:
        return None
    other = [r.line for r in lines.filter("not positive").orderBy("digest").limit(2 * OTHER_LINES).collect()]
    return fitted(positive, other)


def fitted(positive: list[str], other: list[str]) -> crf.Model:
    """The field for lines with and without pattern matches.

    Lines without a match may hold secrets all the same, which would teach the field to pass them over. So a first field is
    fitted on lines without any long token but drawn ones; lines where it sees a secret count as unlabelled, and the second
    field learns from all others. Every second line is held back for the threshold: entering a secret gets dearer until at most FALSE_LINES of them are touched, unless
    that would lose more than LOST of the secrets set into them.
    """
    learn, held = other[::2], other[1::2]
    matched = [_training_line(line) for line in positive] + [_with_drawn(line, True) for line in positive]

    def fit_on(lines: list[str], rounds: int) -> crf.Model:
        return crf.train([*matched, *(_with_drawn(line, secret) for line in lines for secret in (True, False))], rounds)

    first = fit_on([line for line in learn if not LONG_TOKEN.search(line)], FIRST_ROUNDS)
    model = fit_on([line for line, spans in zip(learn, field_spans(learn, first), strict=True) if not spans], ROUNDS)
    drawn = [_set_in(line, True) for line in held]

    def share(texts: list[str], field: crf.Model) -> float:
        return sum(map(bool, field_spans(texts, field))) / max(1, len(texts))

    while share(held, model) > FALSE_LINES:
        tighter = model.dearer(STEP)
        if share([text for text, _ in drawn], tighter) < 1 - LOST:
            break
        model = tighter
    return model


def field_spans(texts: list[str], model: crf.Model | None) -> list[list[Span]]:
    """Spans of SHORTEST characters or more that the field tags, per text, in code points."""
    found: list[list[Span]] = [[] for _ in texts]
    if model is None or not texts:
        return found
    tokens, chars, offsets = _marks(texts)
    states = crf.decode(model, tokens)
    for i in np.flatnonzero(states == crf.B):
        j = i
        while j + 1 < len(states) and states[j + 1] == crf.I and tokens.doc[j + 1] == tokens.doc[i]:
            j += 1
        doc = int(tokens.doc[i])
        base = chars[offsets[doc]]
        start, end = int(chars[tokens.starts[i]] - base), int(chars[tokens.ends[j]] - base)
        if end - start >= SHORTEST:
            found[doc].append((start, 3, end))
    return found


def merged_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans and the stretches of ``more`` that lie outside all of them, as spans of their own."""
    extra, taken = [], sorted((a, b) for a, _, b in base)
    for start, kind, end in more:
        at = start
        for a, b in taken:
            if b <= at or a >= end:
                continue
            if a > at:
                extra.append((at, kind, a))
            at = max(at, b)
        if at < end:
            extra.append((at, kind, end))
    return sorted([*base, *extra])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal covered stretch replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Secrets of every row of ``(doc_id, text)``:
    ``doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans`` and, if asked, ``masked``.

    Spans are ``kind:start:end`` in code points, end exclusive. A null text is empty and has none (``masked`` stays
    null). Rows are independent: repeated rows and null ids come out as they went in; an empty table gives no rows; other
    columns are not looked at. Without any pattern match in the corpus there is nothing to learn from and only the
    patterns speak.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, hi, _ in flat_slices(column):
                known = column.slice(lo, hi - lo).to_pylist()
                texts = [t or "" for t in known]
                base = [base_spans(t) for t in texts]
                every = [merged_spans(b, m) for b, m in zip(base, field_spans(texts, model.value), strict=True)]
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo),
                    *[pa.array([sum(s[1] == k for s in spans) for spans in every], pa.int64()) for k in range(4)],
                    pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]),
                    pa.array([written(s) for s in every], pa.string()),
                ]
                names = ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"]
                if with_text:
                    columns.append(
                        pa.array([t and masked(t, s) for t, s in zip(known, every, strict=True)], pa.string())
                    )
                    names.append("masked")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema + (", masked string" if with_text else ""))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with secrets in the text replaced, and ``n_chars`` (if there) counted anew.

    A null text stays null. Rows, their number and all other columns stay as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            for lo, hi, _ in flat_slices(batch.column(at)):
                piece = batch.slice(lo, hi - lo)
                known = piece.column(at).to_pylist()
                texts = [t or "" for t in known]
                spans = [
                    merged_spans(base_spans(t), m)
                    for t, m in zip(texts, field_spans(texts, model.value), strict=True)
                ]
                new = pa.array([t and masked(t, s) for t, s in zip(known, spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [new if i == at else piece.column(i) for i in range(len(names))], names=names
                )

    out = docs.mapInArrow(scan, docs.schema)
    if "n_chars" in names:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(counted))
    return out
