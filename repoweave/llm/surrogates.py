"""Keyed surrogates for personal data: consistent in the corpus, distinct, and of the same type and format.

An entity is found by a pattern (mail, phone, address, card, social number, bank account) or by a known first name with a
capitalised surname. Its canonical form (digits only, lower case) is what the surrogate depends on, so that all spellings
of one entity get one surrogate, each in its own format. A surrogate is drawn from a keyed digest: digits for digits,
letters for letters of the same case; cards and accounts keep their issuer and whether their check digits are right, phones
their country code, addresses whether they are private, names their gender and script.

Distinct entities must stay distinct, and no surrogate may be an entity of the corpus. Both are checked over the whole
corpus by grouping on surrogates; of those that clash, all but one draw again until none is left. A format may have fewer
values than the corpus has entities of it, so every few attempts the space of what is left gets wider: more signs, or, for
an address, all private networks and then the next version of addresses.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.words import Flat, flat_slices, span_hash
from repoweave.operators.joins import salted_join
from repoweave.session import shared_checkpoint, shared_table

KEY = b"replace me: the key of a run is a parameter"
KINDS = ("mail", "account", "social", "address", "phone", "card", "name")
WIDER_EACH = 4
NEXT_VERSION_FROM = 24

# First names by script and gender: fixed values, in code point order.
NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carmen Charlotte Elena Emily Emma Helen Ingrid Isabel Jane Julia Laura Linda Lucy "
    "Maria Martha Mary Sarah Sofia Susan".split(),
    ("latin", "m"): "Albert Andrew Carlos Charles Daniel David Edward Frank George Hans Henry James John Luis Mark "
    "Michael Paul Peter Robert Thomas Walter William".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Николай Павел Сергей".split(),
    ("greek", "f"): "Αικατερίνη Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος".split(),
}
SYLLABLES = {
    "latin": "ba den fer gan hol kin lor mar nes pol ros sta tin vel wes zan".split(),
    "cyrillic": "ба вел гор дан зин кол лер мар нов пет рос сел тин фед хар чер".split(),
    "greek": "βα γορ δαν ζιν καλ λερ μαρ νικ παν ρος σελ τιν φιλ χαρ".split(),
}
_OF_NAME = {name: group for group, names in NAMES.items() for name in names}

PATTERN = re.compile(
    r"""
    (?P<mail>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<account>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<social>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
  | (?P<address>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9]))
  | (?P<phone>(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]))
  | (?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))
  | (?P<name>\b(?:FIRST)[ ][^\W\d_]+(?:-[^\W\d_]+)?)
    """.replace("FIRST", "|".join(sorted(_OF_NAME))),
    re.VERBOSE,
)


def canonical(kind: str, value: str) -> str:
    if kind in ("phone", "card", "social"):
        digits = re.sub("[^0-9]", "", value)
        # A number with and without the country code 1 is one number.
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "account":
        return value.replace(" ", "")
    return value.lower() if kind in ("mail", "name") else value


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, canonical`` of the entities of a text, in order. A name needs a capitalised surname."""
    out = []
    for m in PATTERN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "name" and not value.split(" ", 1)[1][0].isupper():
            continue
        out.append((m.start(), m.end(), kind, canonical(kind, value)))
    return out


class Draw:
    """An endless keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.count, self.left = hmac.new(key, f"{kind}|{attempt}|{entity}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        """A number below ``n``; 4 bytes each make the bias negligible for small ``n``."""
        if len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.count.to_bytes(8, "big")).digest()
            self.count += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters, the rest as it is."""
        return "".join(
            str(self.below(10)) if "0" <= c <= "9" else chr(97 + self.below(26)) if "a" <= c <= "z"
            else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text
        )


def luhn(digits: str) -> int:
    """Remainder of the check sum, 0 for a right number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _account_rest(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The canonical surrogate of a canonical entity. The values to draw from grow tenfold or more every WIDER_EACH attempts
    (addresses: to the next version's 2**96 or more), so no number of entities exhausts them."""
    draw, wider = Draw(key, kind, entity, attempt), attempt // WIDER_EACH
    if kind == "mail":
        local, domain = entity.split("@")
        *rest, top = domain.split(".")
        return f"{draw.like(local)}{draw.like('a' * wider)}@{'.'.join(draw.like(r) for r in rest)}.{top}"
    if kind == "card":
        body = entity[0] + draw.like(entity[1:-1] + "0" * wider)
        last = next(d for d in "0123456789" if luhn(body + d) == 0)
        return body + (last if luhn(entity) == 0 else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        country, rest = entity[:-10], entity[-10:]
        return country + str(2 + draw.below(8)) + draw.like(rest[1:] + "0" * wider)
    if kind == "address":
        a, b, c, d = map(int, entity.split("."))
        private = a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32) or a == 127
        if attempt >= NEXT_VERSION_FROM:
            groups = [f"{draw.below(1 << 16):x}" for _ in range(7)]
            return ":".join([f"fd{draw.below(256):02x}", *groups] if private else ["2001", "db8", *groups[:6]])
        if private and wider and a != 127:
            a = 10
        elif (a, b) == (192, 168):
            return f"192.168.{draw.below(256)}.{draw.below(256)}"
        if private:
            return f"{a}.{16 + draw.below(16) if a == 172 else draw.below(256)}.{draw.below(256)}.{draw.below(256)}"
        public = [n for n in range(11, 224) if n not in (127, 172, 192)]
        return f"{public[draw.below(len(public))]}.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}"
    if kind == "account":
        body = draw.like(entity[4:] + "0" * wider)
        right = f"{98 - _account_rest(entity[:2] + '00' + body):02d}"
        if _account_rest(entity) == 1:
            return entity[:2] + right + body
        return entity[:2] + f"{(int(right) + 1 + draw.below(90)) % 97 + 2:02d}" + body
    if kind == "name":
        first, last = entity.split(" ", 1)
        script, gender = _OF_NAME[first[:1].upper() + first[1:]]
        names, parts = NAMES[script, gender], SYLLABLES[script]
        size = max(2, round(len(last) / 3)) + wider
        return f"{names[draw.below(len(names))]} {''.join(parts[draw.below(len(parts))] for _ in range(size)).capitalize()}".lower()
    return draw.like(entity + "0" * wider)


def rendered(kind: str, value: str, new: str) -> str:
    """The canonical surrogate ``new`` in the format of ``value``. Signs that the format has no place for go to the end, those
    of a phone before it, as a country code."""
    if kind in ("phone", "card", "social", "account"):
        keep = "0123456789" if kind != "account" else "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        old = [c for c in value if c in keep]
        more = max(0, len(new) - len(old))
        head, tail = ("", new[len(old) :]) if kind != "phone" or not more else (f"+{new[:more]}", "")
        signs = iter("".join(old[: max(0, len(old) - len(new))]) + (new[more:] if head else new))
        out = "".join(next(signs, c) if c in keep else c for c in value)
        return (head + (out[1:] if out[0] == "+" else f" {out}") if head else out) + tail
    if kind == "name":
        return " ".join(w[:1].upper() + w[1:] for w in new.split(" ")) if not value.isupper() else new.upper()
    return new.upper() if value.isupper() and kind == "mail" else new


_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _name_hashes() -> dict[int, np.ndarray]:
    """Sorted hashes of the first names by their number of bytes."""
    _, _, flat = next(flat_slices(pa.array(sorted(_OF_NAME)), 1 << 40))
    hashes, size = span_hash(flat.prefix_hash(), flat.offsets[:-1], flat.offsets[1:]), np.diff(flat.offsets)
    return {int(n): np.sort(hashes[size == n]) for n in np.unique(size)}


def suspects(flat: Flat, names: dict[int, np.ndarray]) -> np.ndarray:
    """Texts that may hold an entity, and all that do: an at sign, four digits or more, two capitals before two digits (an
    account may have no more), or a known first name before a space. A run of letters and bytes of other scripts may
    begin with signs, such as quotes and dashes, so a name may be any end of it that follows such a byte."""
    data, digit, upper = flat.data, _DIGIT[flat.data], _UPPER[flat.data]
    at = np.bincount(flat.doc_of(np.flatnonzero(data == 64)), minlength=flat.n) > 0
    digits = np.bincount(flat.doc_of(np.flatnonzero(digit)), minlength=flat.n) >= 4
    coded = np.flatnonzero(upper[:-3] & upper[1:-2] & digit[2:-1] & digit[3:])
    accounts = np.bincount(flat.doc_of(coded), minlength=flat.n) > 0
    starts, ends = flat.runs(_LETTER[data])
    spaced = np.flatnonzero(np.append(data, 0)[ends] == 32)
    starts, ends = starts[spaced], ends[spaced]
    prefix = flat.prefix_hash()
    named = np.zeros(flat.n, dtype=bool)
    for size, known in names.items():
        first = ends - size
        some = np.flatnonzero((first == starts) | ((first > starts) & (data[np.maximum(first - 1, 0)] >= 128)))
        found = span_hash(prefix, first[some], ends[some])
        place = np.minimum(np.searchsorted(known, found), len(known) - 1)
        named[flat.doc_of(first[some][known[place] == found])] = True
    return at | digits | accounts | named


def _found(docs: DataFrame) -> DataFrame:
    """``text_key, kind, entity`` of each text of ``(text_key, text)``, once per slice of a batch."""
    names = _name_hashes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, flat in flat_slices(batch.column(1)):
                rows: dict[tuple, None] = {}
                for i in np.flatnonzero(suspects(flat, names)):
                    key = batch.column(0)[lo + int(i)].as_py()
                    for _, _, kind, entity in entities(batch.column(1)[lo + int(i)].as_py()):
                        rows[key, kind, entity] = None
                if rows:
                    keys, kinds, values = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(kinds), pa.array(values)], names=["text_key", "kind", "entity"]
                    )

    return docs.select("text_key", "text").mapInArrow(scan, "text_key long, kind string, entity string")


def assign(all_entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind, entity, surrogate`` for distinct ``(kind, entity)``: no two entities of a kind share a surrogate, and no
    surrogate is an entity of that kind. Ends for any number of entities, as ``surrogate`` widens what is drawn from."""
    todo, seen = shared_checkpoint(all_entities.withColumn("attempt", F.lit(0)), n=F.count(F.lit(1)))
    settled = None

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
            new = pa.array([surrogate(key, *row) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=["kind", "entity", "attempt", "surrogate"])

    while True:
        drawn = shared_checkpoint(
            todo.select("kind", "entity", "attempt").mapInArrow(draw, "kind string, entity string, attempt int, surrogate string")
        )
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        real = all_entities.select("kind", F.col("entity").alias("surrogate"))
        good = first.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            good = good.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = good.select("kind", "entity", "surrogate")
        settled = shared_checkpoint(good if settled is None else settled.union(good))
        todo, seen = shared_checkpoint(
            drawn.join(settled, ["kind", "entity"], "left_anti").withColumn("attempt", F.col("attempt") + 1), n=F.count(F.lit(1))
        )
        if not seen["n"]:
            return settled


def replaced(text: str, new: dict[tuple[str, str], str]) -> tuple[str, Counter]:
    """The text with its entities replaced, and how often each kind stands in it."""
    out, at, counts = [], 0, Counter()
    for start, end, kind, entity in entities(text):
        out += [text[at:start], rendered(kind, text[start:end], new[kind, entity])]
        at = end
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts


def pseudonymize(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id, text, n_entities`` and ``n_<kind>`` of every row of ``(doc_id, text)``, entities replaced.

    Texts without an entity come out as they are, null stays null. Repeated rows are replaced alike; null ids come out as
    they went in; an empty table gives no rows; other columns are not looked at.
    """
    keyed = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    found = shared_table(_found(keyed))
    mapping = shared_table(assign(found.select("kind", "entity").distinct(), key))
    per_text = found.distinct()
    # An entity may stand in a third of all texts: its rows are dealt out before the join.
    joined = salted_join(per_text, mapping, ["kind", "entity"], ["text_key"])
    news = joined.groupBy("text_key").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("news"))
    names = _name_hashes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.zeros(batch.num_rows, dtype=bool)
            for lo, _, flat in flat_slices(batch.column(1)):
                for i in np.flatnonzero(suspects(flat, names)):
                    marks[lo + i] = PATTERN.search(batch.column(1)[lo + int(i)].as_py()) is not None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=["doc_id", "text", "text_key", "hit"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                replaced(t, {(r["kind"], r["entity"]): r["surrogate"] for r in n or []})
                for t, n in zip(batch.column("text").to_pylist(), batch.column("news").to_pylist(), strict=True)
            ]
            counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS]
            columns = [batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    marked = keyed.mapInArrow(split, f"doc_id {id_type}, text string, text_key long, hit boolean")
    # Only texts with an entity are moved.
    moved = marked.filter("hit").join(news.hint("shuffle_hash"), "text_key", "left").select("doc_id", "text", "news")
    schema = f"doc_id {id_type}, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    changed = moved.mapInArrow(rewrite, schema)
    same = marked.filter("not hit").select("doc_id", "text", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    every = changed.unionByName(same)
    return every.withColumn("n_entities", sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")))
