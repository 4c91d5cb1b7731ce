"""Download links from stored package pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: class attribute of the element that holds a package file.
FILE_CARD = "card file__card"

# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Found(Exception):
    pass


class _CardLink(HTMLParser):
    """Stops at the first ``<a>`` inside the first card, or when that card ends."""

    def __init__(self, card: str):
        super().__init__()
        self.card = card
        self.open: list[str] = []
        self.card_depth = 0
        self.link: str | None = None

    def handle_starttag(self, tag, attrs):
        if self.card_depth and tag == "a":
            self.link = dict(attrs).get("href")
            raise _Found
        if tag not in VOID:
            self.open.append(tag)
        if not self.card_depth and tag == "div" and dict(attrs).get("class") == self.card:
            self.card_depth = len(self.open)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if len(self.open) < self.card_depth:
            raise _Found


def _link_of(html: str | None, card: str) -> str | None:
    if html is None or card not in html:
        return None
    parser = _CardLink(card)
    try:
        parser.feed(html)
        parser.close()
    except _Found:
        pass
    return parser.link


def first_link(html: Column, card: str = FILE_CARD) -> Column:
    """Link of the first anchor inside the first file card; null without a card or an anchor in it."""

    @F.pandas_udf(T.StringType())
    def links(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: _link_of(page, card))

    return links(F.when(F.contains(html, F.lit(card)), html))


def page_links(pages: DataFrame) -> DataFrame:
    """``(project, link)`` of stored pages ``(project, html)``."""
    return pages.select("project", first_link(F.col("html")).alias("link"))
