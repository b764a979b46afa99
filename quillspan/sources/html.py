"""HTML extraction: the text of paragraphs, headings, list items and cells."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements whose text counts, and tags whose start ends an open paragraph
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th")
PARAGRAPH_ENDERS = ("address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
#: A start tag that ends an open element of the same family, up to the element that holds the family.
_SIBLINGS = {"li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("td", "th", "tr"), ("table",))}
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_SILENT = ("script", "style", "template", "noscript")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag, and its text's place or -1
        self.texts: list[list[str]] = []
        self.silent = 0

    def close_to(self, depth: int) -> None:
        del self.open[depth:]

    def end_paragraph(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "p":
                return self.close_to(i)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in PARAGRAPH_ENDERS:
            self.end_paragraph()
        if tag in _SIBLINGS:
            family, holders = _SIBLINGS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in family:
                    self.close_to(i)
                    if tag != "tr":
                        break
                elif self.open[i][0] in holders:
                    break
        if tag in _VOID:
            return
        if tag in _SILENT:
            self.silent += 1
        place = -1
        if tag in TEXT_TAGS:
            place = len(self.texts)
            self.texts.append([])
        self.open.append((tag, place))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self.close_to(i)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, place in self.open:
                if place >= 0:
                    self.texts[place].append(data)


_REFERENCE = re.compile(r"&(#?[0-9A-Za-z]+;)?")


def _ended(found: re.Match) -> str:
    """A character reference as it is, and any other & as text."""
    name = found[1] or ""
    return found[0] if name.startswith("#") or name in html5 else "&amp;" + name


def html_text(html: str | None, bare_references: bool = True) -> str:
    """The texts in document order, stripped, a line each; nested elements give their text each. With bare_references
    an old name counts without its semicolon (`&amp`), as browsers read it; else that is text."""
    reader = _Reader()
    reader.feed((html or "") if bare_references else _REFERENCE.sub(_ended, html or ""))
    reader.close()
    return "\n".join(t for t in ("".join(parts).strip() for parts in reader.texts) if t)


@F.pandas_udf(T.StringType())
def _extract(html: pd.Series) -> pd.Series:
    return html.map(html_text)


@F.pandas_udf(T.StringType())
def _extract_ended(html: pd.Series) -> pd.Series:
    return html.map(lambda page: html_text(page, bare_references=False))


def extracted_html(html: Column, bare_references: bool = True) -> Column:
    return _extract(html) if bare_references else _extract_ended(html)
