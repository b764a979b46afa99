"""File sources: binary files dealt by extension to their extractors."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import file_extension, safe_name
from quillspan.sources.html import html_text

PLAIN = ("txt", "md", "csv")
HTML = ("html", "htm")
FORMATS = (*PLAIN, *HTML, "docx", "xlsx")

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """document (path), filename, extension, content, sha256 of the files under path. Spark's scan passes over empty
    files; extracted() makes an error of one that comes in another way."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = safe_name(F.col("path"))
    return raw.select(F.col("path").alias("document"), name.alias("filename"), file_extension(name).alias("extension"), "content", F.sha2("content", 256).alias("sha256"))


def _paragraph(node) -> str:
    return "".join(t.text or "" for run in node.iter(_W + "r") for t in run.findall(_W + "t"))


def docx_text(content: bytes) -> str:
    """Top-level paragraphs, a line each; a table's cells with a tab each and a line for each row."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(_W + "body")
    out = []
    for child in body if body is not None else ():
        if child.tag == _W + "p":
            out.append(_paragraph(child) + "\n")
        elif child.tag == _W + "tbl":
            for row in child.findall(_W + "tr"):
                for cell in row.findall(_W + "tc"):
                    out.append("".join(_paragraph(p) for p in cell.findall(_W + "p")) + "\t")
                out.append("\n")
    return "".join(out)


def xlsx_text(content: bytes) -> str:
    """Every sheet's rows, cells joined by tabs, a line each."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(_S + "t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(_S + "si")]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(book.read("xl/workbook.xml")).iter(_S + "sheet"):
        target = targets[sheet.get(_R + "id")].lstrip("/")
        for row in ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(_S + "row"):
            cells = []
            for cell in row.findall(_S + "c"):
                value = cell.findtext(_S + "v") or ""
                if cell.get("t") == "s" and value:
                    value = shared[int(value)]
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(_S + "t"))
                cells.append(value)
            out.append("\t".join(cells) + "\n")
    return "".join(out)


def _plain(content: bytes) -> str:
    return content.decode("utf-8")


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(PLAIN, _plain),
    **dict.fromkeys(HTML, lambda content: html_text(content.decode("utf-8"))),
    "docx": docx_text,
    "xlsx": xlsx_text,
}


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files without content, with text and error; an empty file, a format without an extractor, and content that its
    extractor can't read (invalid UTF-8 among it), become errors. Extractors for further formats (PDF, pictures) can be given."""
    known = EXTRACTORS | (extractors or {})
    keep = [c for c in files.columns if c != "content"]
    schema = files.select(*keep, F.lit("").alias("text"), F.lit("").alias("error")).schema
    for field in schema.fields:
        field.nullable = True

    def read(extension: str, content: bytes) -> tuple[str | None, str | None]:
        if not content:
            return None, "empty file"
        if extension not in known:
            return None, "unsupported format"
        try:
            return known[extension](bytes(content)), None
        except Exception as error:  # a broken file is a row of the result, not a failed job
            return None, f"{type(error).__name__}: {error}"[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [read(e, c) for e, c in zip(pdf["extension"], pdf["content"], strict=True)]
            yield pdf[keep].assign(text=[s[0] for s in said], error=[s[1] for s in said])

    return files.mapInPandas(run, schema)
