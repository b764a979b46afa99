"""The recursive splitter: pieces by paragraph, line and word, packed greedily into overlapping chunks.

Limits count code points, spans count UTF-8 bytes. Both splitters run in Arrow batches and are linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 1000
OVERLAP = 100
SEPARATORS = ("\n\n", "\n", " ")

Chunk = tuple[str, int, int]


def window_chunks(text: str, start: int, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Windows of size code points, each overlapping the last; the one that reaches the end is the last."""
    n = len(text)
    if not n:
        return []
    if text.isascii():
        at = range(n + 1)
    else:
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)].tolist()
    firsts = [0, *range(size - overlap, max(n - overlap, 0), size - overlap)]
    return [(text[a : a + size], start + at[a], start + at[min(a + size, n)]) for a in firsts]


def packed_run(pieces: list[str], starts: list[int], separator: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Consecutive small pieces packed: a chunk takes pieces while they fit; the next begins with the longest tail of
    at most overlap code points that still leaves room for its first new piece."""
    gap, n = len(separator), len(pieces)
    lengths = np.array([len(p) for p in pieces])
    # reach[i]: length up to piece i with a separator after each, so a run a..b takes reach[b+1] - reach[a] - gap
    reach = np.r_[0, np.cumsum(lengths + gap)]
    out: list[Chunk] = []
    a = 0
    while a < n:
        b = max(a, int(np.searchsorted(reach, reach[a] + size + gap, "right")) - 2)
        text = separator.join(pieces[a : b + 1])
        out.append((text, starts[a], starts[b] + len(pieces[b].encode())))
        if b == n - 1:
            break
        spare = min(overlap, size - gap - int(lengths[b + 1]))
        nearest = int(np.searchsorted(reach, reach[b + 1] - gap - spare, "left"))
        a = min(max(nearest, a + 1), b + 1)
    return out


def split_text(text: str, start: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[Chunk]:
    """(text, first byte, last byte) of each chunk."""
    which = next((i for i, s in enumerate(separators) if s in text), None)
    if which is None:
        return window_chunks(text, start)
    separator, finer = separators[which], separators[which + 1 :]
    out: list[Chunk] = []
    run: list[str] = []
    starts: list[int] = []
    at = start
    for piece in text.split(separator):
        if piece and len(piece) < SIZE:
            run.append(piece)
            starts.append(at)
        elif piece:
            out += packed_run(run, starts, separator)
            run, starts = [], []
            out += split_text(piece, at, finer)
        at += len(piece.encode()) + len(separator)
    return out + packed_run(run, starts, separator)


CHUNK_FIELDS = "chunk_index int, chunk string, start_byte bigint, end_byte bigint"


def _chunks(docs: DataFrame, keep: list[str], text: str, split, marks: str | None = None) -> DataFrame:
    more = CHUNK_FIELDS + (", label string" if marks else "")
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(more).fields])
    extra = [F.col(marks).alias("__marks")] if marks else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, texts, low, high = [], [], [], [], []
            texts_in = batch.column(len(keep))
            for r in range(batch.num_rows):
                for i, (t, a, b) in enumerate(split(texts_in[r].as_py() or "")):
                    rows.append(r)
                    index.append(i)
                    texts.append(t)
                    low.append(a)
                    high.append(b)
            at = pa.array(rows, pa.int64())
            out = [*(batch.column(i).take(at) for i in range(len(keep))), pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
            if marks:
                out.append(labels_at(batch.column(len(keep) + 1), np.array(rows, np.int64), np.array(low, np.int64)))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.select(*keep, F.col(text).alias("__text"), *extra).mapInArrow(run, schema)


def labels_at(marks: pa.ListArray, rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Label of the last mark at or before each start in its row, or null. marks rise within a row."""
    edges = marks.offsets.to_numpy()
    bytes_at = marks.values.field("byte_offset").to_numpy(zero_copy_only=False)
    found = np.full(len(rows), -1, np.int64)
    for r in np.unique(rows):
        own = slice(*np.searchsorted(rows, [r, r + 1]))
        place = np.searchsorted(bytes_at[edges[r] : edges[r + 1]], starts[own], "right") - 1
        found[own] = np.where(place < 0, -1, edges[r] + place)
    return marks.values.field("label").take(pa.array(found, mask=found < 0))


def recursive_chunks(docs: DataFrame, keep: list[str], text: str = "text", marks: str | None = None) -> DataFrame:
    """The kept columns with chunk_index, chunk, start_byte, end_byte; no rows for empty text. With marks, a column of
    array<struct<byte_offset,label>> by rising offset, also label, that of the last mark at or before the chunk's start."""
    return _chunks(docs, keep, text, split_text, marks)


def character_chunks(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """As recursive_chunks, by windows of code points alone."""
    return _chunks(docs, keep, text, lambda t: window_chunks(t, 0))


def chunk_rejects(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows that split into no chunk: null or empty text, or nothing but the separator that is tried first."""
    only = F.regexp_replace(F.col(text), "^(\n\n)+$|^\n$|^ +$", "")
    return docs.where(F.coalesce(only, F.lit("")) == "")
