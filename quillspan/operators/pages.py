"""Pages: spans of extracted pages, the pages under a byte range, and whether native text is good enough."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import strip

SAMPLED_PAGES = 10
LEAST_RATIO = 0.5
LEAST_BYTES = 500

_SPANS = "array<struct<page:int,start_byte:bigint,end_byte:bigint>>"


def folded_pages(pages: Column, keep_blank: bool = False) -> Column:
    """struct<text, spans> of an array of page texts: each page and a newline, spans end to end. Blank pages are left
    out, or stand as their newline (as scanned pages do)."""
    numbered = F.transform(pages, lambda text, i: F.struct((i + 1).cast("int").alias("page"), text.alias("text")))
    kept = numbered if keep_blank else F.filter(numbered, lambda p: strip(p["text"]) != "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(state: Column, p: Column) -> Column:
        end = state["at"] + F.octet_length(p["text"]) + 1
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(p["page"], state["at"], end)).cast(_SPANS)).alias("spans"))

    text = F.array_join(F.transform(kept, lambda p: F.concat(p["text"], F.lit("\n"))), "")
    return F.struct(text.alias("text"), F.aggregate(kept, start, add)["spans"].alias("spans"))


def pages_for_range(spans: Column, start: Column, end: Column) -> Column:
    """struct<first,last> of the pages that overlap [start, end), or null."""
    met = F.transform(F.filter(spans, lambda p: (p["start_byte"] < end) & (p["end_byte"] > start)), lambda p: p["page"])
    return F.when(F.size(met) > 0, F.struct(F.array_min(met).alias("first"), F.array_max(met).alias("last")))


def text_ratio(pages: Column) -> Column:
    """Share of the first pages that hold text; 0 without pages."""
    first = F.slice(pages, 1, SAMPLED_PAGES)
    return F.when(F.size(first) > 0, F.size(F.filter(first, lambda p: strip(p) != "")) / F.size(first)).otherwise(F.lit(0.0))


def native_text_accepted(pages: Column) -> Column:
    """Whether extracted pages will do without character recognition."""
    return (text_ratio(pages) > LEAST_RATIO) & (F.octet_length(strip(folded_pages(pages)["text"])) > LEAST_BYTES)
