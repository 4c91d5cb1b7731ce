"""Import statements as array columns, one expression per language.

The character classes are spelled out so that word and blank characters agree with Unicode text handling in
Python rather than with Java's ASCII defaults. ``(?d)`` makes the newline the only line end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[\p{L}\p{N}_.]+"
_BLANKS_IN_LINE = r"\t\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_GAP = rf"[\n{_BLANKS_IN_LINE}]+"

# A statement may be indented. Blank lines before it are skipped by the line anchor, not by the blank class,
# which keeps the scan linear on long runs of empty lines.
_PYTHON_STATEMENT = rf"(?md)^[{_BLANKS_IN_LINE}]*(?:import{_GAP}{_NAME}|from{_GAP}{_NAME}{_GAP}import)"
_PYTHON_MODULE = rf"(?:import|from){_GAP}({_NAME})"
_JAVA_STATEMENT = rf"(?md)^import{_GAP}({_NAME});"

JAVA_HEADER_LINES = 100


def python_modules(content: Column) -> Column:
    """First module named by each ``import``/``from`` statement. One pass over the text finds whole statements;
    the module is then cut out of the short matches."""
    statements = F.regexp_extract_all(content, F.lit(_PYTHON_STATEMENT), F.lit(0))
    return F.transform(statements, lambda s: F.regexp_extract(s, _PYTHON_MODULE, 1))


def java_modules(content: Column) -> Column:
    """Plain imports of the file header: the first lines, before any public class or interface."""
    header = F.substring_index(content, "\n", JAVA_HEADER_LINES)
    header = F.substring_index(F.substring_index(header, "public class", 1), "interface", 1)
    return F.regexp_extract_all(header, F.lit(_JAVA_STATEMENT), F.lit(1))


@dataclass(frozen=True)
class Language:
    name: str
    suffix: str
    modules: Callable[[Column], Column]
    ignored: tuple[str, ...] = ()


_LANGUAGES: dict[str, Language] = {}


def register_language(
    name: str, suffix: str, modules: Callable[[Column], Column], ignored: tuple[str, ...] = ()
) -> Language:
    """Add a language: its file suffix and an expression from content to an array of imported modules."""
    _LANGUAGES[name] = Language(name, suffix, modules, ignored)
    return _LANGUAGES[name]


def language(name: str) -> Language:
    if name not in _LANGUAGES:
        raise ValueError(f"no import rules for language {name!r}; known: {sorted(_LANGUAGES)}")
    return _LANGUAGES[name]


register_language("python", ".py", python_modules, ignored=("__future__",))
register_language("java", ".java", java_modules)

DEFAULT_LANGUAGES = ("python", "java")


def extension_of(language_name: Column) -> Column:
    """Registered file suffix of a language name column; null when unknown."""
    pairs = [F.lit(part) for entry in _LANGUAGES.values() for part in (entry.name, entry.suffix)]
    return F.create_map(*pairs)[language_name]
