"""Text expressions. Lengths are code points unless a name says bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_LENGTH = 50
PARSER_VERSION = 1
CHUNKER_VERSION = 2


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def shortened(text: Column, n: int, mark: str) -> Column:
    """The first n code points, and the mark if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def auto_title(text: Column) -> Column:
    return shortened(text, TITLE_LENGTH, "...")


def provenance_id(content_hash: Column, index: Column) -> Column:
    """hash:index:pv:cv; it doesn't depend on the document's id."""
    return F.concat_ws(":", content_hash, index.cast("string"), F.lit(f"pv{PARSER_VERSION}"), F.lit(f"cv{CHUNKER_VERSION}"))


def safe_name(path: Column) -> Column:
    r"""The last component after / or \; `unnamed` for none, `.` and `..`."""
    last = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.when(last.isin("", ".", ".."), "unnamed").otherwise(last)


def is_archive_name(name: Column) -> Column:
    """One plain component that ends in .tar.gz."""
    return ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\")) & name.endswith(".tar.gz")


def file_extension(name: Column) -> Column:
    """Lower-case extension; none for a name without a dot, or whose only dot leads it."""
    return F.lower(F.regexp_extract(name, r"[^./\\]\.([^./\\]*)$", 1))


def quoted_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def byte_label(n: Column) -> Column:
    return (
        F.when(n >= 1 << 30, F.format_string("%.1f GB", n / float(1 << 30)))
        .when(n >= 1 << 20, F.format_string("%.0f MB", n / float(1 << 20)))
        .otherwise(F.format_string("%d KB", F.floor(n / 1024)))
    )


def duration_label(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
        .when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def similarity_label(similarity: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(similarity * 100, 1)), F.lit("%"))


def page_label(first: Column, last: Column) -> Column:
    """pag. N, or N-M with an en dash; null without a page."""
    return F.when(first.isNull(), F.lit(None)).when(last.isNull() | (first == last), F.concat(F.lit("pag. "), first.cast("string"))).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def version_parts(version: Column) -> Column:
    """[major, minor, patch] of a version with or without a leading v; compares as numbers."""
    return F.transform(F.slice(F.split(F.regexp_replace(version, "^v", ""), r"\."), 1, 3), lambda x: x.cast("int"))
