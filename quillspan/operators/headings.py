"""Section headings: detection by line, and the heading in force at a chunk. All on arrays inside the document's
row, so no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import strip

# fixed values: the prefixes of heading lines, each followed by one space
HEADING_PREFIXES = ("article", "art.", "chapter", "cap.", "section", "sec.", "annex", "clause", "articolo", "capitolo", "sezione", "allegato", "clausola")
HEADING_LINE = r"^(?i:" + "|".join(p.replace(".", r"\.") for p in HEADING_PREFIXES) + r") [0-9A-Z]"
NUMBERED_LINE = r"^[0-9]+[.)]"
LONGEST_HEADING = 60
LONGEST_TITLE = 120
DASH = " — "


def is_heading(line: Column) -> Column:
    """line is stripped."""
    return (F.length(line) <= LONGEST_HEADING) & line.rlike(HEADING_LINE)


def is_title(line: Column) -> Column:
    """Whether the stripped line after a heading is its title."""
    return (line != "") & (F.length(line) <= LONGEST_TITLE) & ~line.rlike(NUMBERED_LINE) & ~is_heading(line)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def headings(text: Column) -> Column:
    """array<struct<byte_offset,label>> by rising offset, in one pass: each heading adds the lines since the last one."""
    return _once(F.split(F.coalesce(text, F.lit("")), "\n"), _marks)


def _marks(lines: Column) -> Column:
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), strip(line).alias("line")))
    found = F.filter(numbered, lambda x: is_heading(x["line"]))

    def label(x: Column) -> Column:
        below = F.coalesce(strip(F.get(lines, x["i"] + 1)), F.lit(""))
        return _once(below, lambda b: F.when(is_title(b), F.concat(x["line"], F.lit(DASH), b)).otherwise(x["line"]))

    def add(marks: Column, x: Column) -> Column:
        last = F.try_element_at(marks, F.lit(-1))
        since = F.slice(lines, F.coalesce(last["i"], F.lit(0)) + 1, x["i"] - F.coalesce(last["i"], F.lit(0)))
        offset = F.aggregate(since, F.coalesce(last["byte_offset"], F.lit(0).cast("long")), lambda s, line: s + F.octet_length(line) + 1)
        return F.array_append(marks, F.struct(x["i"].alias("i"), offset.alias("byte_offset"), label(x).alias("label")))

    none = F.array().cast("array<struct<i:int,byte_offset:bigint,label:string>>")
    return F.transform(F.aggregate(found, none, add), lambda m: F.struct(m["byte_offset"].alias("byte_offset"), m["label"].alias("label")))


def heading_at(marks: Column, start: Column) -> Column:
    """Label of the last heading at or before a byte, or null."""
    return F.try_element_at(F.filter(marks, lambda h: h["byte_offset"] <= start), F.lit(-1))["label"]


def with_heading(chunk: Column, label: Column) -> Column:
    """The chunk below its heading; unchanged without one, or if it begins with the heading's own line."""
    own = F.split_part(label, F.lit(DASH), F.lit(1))
    carries = F.startswith(F.regexp_replace(chunk, r"(?U)^\s+", ""), own)
    return F.when(label.isNull() | carries, chunk).otherwise(F.concat(F.lit("["), label, F.lit("]\n\n"), chunk))


def enriched(chunks: DataFrame, label: str = "label") -> DataFrame:
    """chunks (chunk and the label of the heading in force, as the splitter gives it from marks) with retrieval_text,
    null where it is the chunk."""
    return chunks.withColumn("retrieval_text", F.nullif(with_heading(F.col("chunk"), F.col(label)), F.col("chunk")))
