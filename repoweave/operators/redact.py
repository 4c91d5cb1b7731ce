"""Personal data and keys in texts, replaced by typed marks. Built-in functions only.

Each kind is a pattern; kinds are replaced one after the other, so a mark is in place before the next kind looks and no two
spans overlap. Counts come from the same pass over the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# No letter, digit or underscore on either side: the same as a word border for ASCII, whatever the engine takes for a letter.
_BEGIN, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


@dataclass(frozen=True)
class Kind:
    """What is looked for and what comes in its place (``$1`` for the part in the first parentheses)."""

    name: str
    pattern: str
    mark: str


KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}", "<EMAIL>"),
    Kind(
        "secret",
        r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? {0,8}[:=] {0,8}[\"']?)[A-Za-z0-9+/_.=-]{8,}",
        "$1<SECRET>",
    ),
    Kind("key", rf"{_BEGIN}(?:AKIA[A-Z0-9]{{12,}}|[0-9a-f]{{32,}}){_END}", "<KEY>"),
    Kind("ip", rf"{_BEGIN}{_BYTE}(?:\.{_BYTE}){{3}}{_END}", "<IP>"),
    Kind("card", rf"{_BEGIN}(?:[0-9]{{13,16}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}){_END}", "<CARD>"),
    Kind("phone", rf"(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)|{_BEGIN}[0-9]{{2,4}})[ .-]?[0-9]{{3,4}}[ .-][0-9]{{3,4}}{_END}", "<PHONE>"),
)


def redact(docs: DataFrame, text: str, kinds: tuple[Kind, ...] = KINDS, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` redacted and, with ``counts``, a column ``n_<kind>`` for each kind. A null text stays null and
    counts nothing; other columns, repeated rows and empty tables pass through."""
    columns = [c for c in docs.columns if not (counts and c in {f"n_{k.name}" for k in kinds})]
    out = docs.select(*columns)
    for kind in kinds:
        found = F.coalesce(F.regexp_count(text, F.lit(kind.pattern)), F.lit(0)).cast("long")
        replaced = F.regexp_replace(text, kind.pattern, kind.mark)
        out = out.withColumns({text: replaced, **({f"n_{kind.name}": found} if counts else {})})
    return out
