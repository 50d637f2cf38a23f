"""Fact paragraphs of web pages: the parser runs inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Elements left out, elements read, and words that mark a fact.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg"}
BLOCKS = {"p", "li", "dd", "td"}
FACT_WORDS = (
    r"\b(nose|palate|finish|aroma|notes? of|flavou?rs?|tast|aged|years?|proof|abv|alcohol|distill|mash ?bill|barrel|"
    r"cask|oak|grape|vineyard|blend|vintage|fermented|agave|botanical|brewed|hops?|ipa|style|made|produced|crafted|"
    r"region|valley|estate)\b"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Collects the text of p, li, dd and td elements outside skipped ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipping: list[str] = []
        self.open: list[tuple[str, list[str], int]] = []
        self.found: list[tuple[int, str]] = []
        self.seen = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if self.skipping or tag in SKIPPED:
            if tag in SKIPPED:
                self.skipping.append(tag)
            return
        if tag in BLOCKS:
            if tag in ("p", "li") and self.open and self.open[-1][0] == tag == "p":
                self._close(len(self.open) - 1)
            self.open.append((tag, [], self.seen))
            self.seen += 1

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def _close(self, i: int) -> None:
        while len(self.open) > i:
            _, parts, order = self.open.pop()
            self.found.append((order, "".join(parts)))

    def handle_data(self, data):
        if not self.skipping:
            for _, parts, _ in self.open:
                parts.append(data)


def blocks(html: str) -> list[str]:
    """Texts of the page's blocks in document order, whitespace collapsed."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._close(0)
    return [re.sub(r"\s+", " ", t).strip() for _, t in sorted(parser.found)]


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One array of block texts per page; whole pages, no page is cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "blocks": [blocks(h) for h in b[html]]})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, blocks array<string>")


def page_fact_paragraphs(pages: DataFrame, key: str = "page_id", limit: int = 1800, minimum: int = 120) -> DataFrame:
    """Distinct fact paragraphs of 40-900 characters joined per page, cut at
    ``limit`` as the feature asks, kept from ``minimum`` characters on."""
    facts = F.array_distinct(
        F.filter("blocks", lambda t: F.length(t).between(40, 900) & t.rlike("(?i)" + FACT_WORDS))
    )
    text = F.array_join(facts, "\n")
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    return (
        page_blocks(pages, key)
        .select(key, F.size(facts).alias("paragraphs"), cut.alias("text"))
        .where(F.length("text") >= minimum)
    )
