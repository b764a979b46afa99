"""Helpers shared by the training-data operators: the shared folder, Arrow text buffers, rolling hashes.

Word rule used throughout: a word is a maximal run of bytes outside space and 0x09-0x0D.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the vectorised kernels hold at once, which take some eighty times as many; a longer single text is
#: taken alone.
CHUNK_BYTES = 500_000
#: Powers that a worker keeps.
KEPT_POWERS = 4_000_000
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- shared folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests)
    and an error on a cluster, whose machines see only their own temporary folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables of the scratch scopes that are open.
_scratch: list[list[tuple[DataFrame, str]]] = []


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df as a Parquet table of the shared folder: its lineage is cut and lost executors don't recompute it. It goes with
    the scratch scope that is open; a lasting one is handed to the scope around that, or stays if there is none."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if len(_scratch) > lasting:
        _scratch[-1 - lasting].append((out, path))
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written in here are emptied at the end. What is used afterwards must be a lasting table by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for table, path in _scratch.pop():
            table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES, unless the session says otherwise: by default a task's whole split of
    texts would be one batch, which an executor holds several times over (vectors, message, worker)."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: The internal row number of a keyed table, and the text in what goes to Python.
ROW = "__quillspan_row"
TEXT = "__quillspan_text"


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, ROW, as a stored table. Numbers are given once and read from then on, so a
    changed cluster, split size or lost executor between two passes can't join a decision to another row."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def arrow_of(docs: DataFrame, keep: list[str], added: str) -> T.StructType:
    """The schema of the kept columns and the added ones; a kept column of an added name gives way."""
    extra = T.StructType.fromDDL(added).fields
    names = {f.name for f in extra}
    return T.StructType([*(f for f in docs.select(*keep).schema.fields if f.name not in names), *extra])


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema and the fields that the DDL string names."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def learnable(doc_id) -> "F.Column":
    """Rows from which models may learn: crc32 of the id's text, modulo 4, is not 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 != 2


# ---------------------------------------------------------------- Arrow text buffers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data uint8, offsets int64) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs_of(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of at most limit bytes together, or a single longer one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def trim() -> None:
    """Gives freed memory back to the system: an executor's idle workers would otherwise hold their largest task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """An Arrow function that trims its worker after the last batch."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        trim()

    return inner


# ---------------------------------------------------------------- rolling hashes

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least; kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values[i] * base**i; with them a window's hash takes one subtraction and one product."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal content wherever it stands."""
    inverse = powers(base, len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the words; none spans two texts."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the words: each byte is mixed with its place in the word before the sum, so unlike a
    polynomial modulo 2**64 no pattern of a word makes terms cancel."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at = np.repeat(starts, size) + place
    mixed = mix(byte_table(lane * 77 + 1)[data[at]] + place.astype(np.uint64) * np.uint64(_BASES[lane]))
    return mix(np.add.reduceat(mixed, first) + size.astype(np.uint64))


def window_hashes(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hashes of values[i : i + width] for each i that has so many: windows of twice the width are mixed from two of
    half, so every step is nonlinear."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    base = np.uint64(_BASES[lane])
    out, span = values, 1
    while span * 2 <= width:
        out = mix(out[:-span] + out[span:] * base)
        span *= 2
    if span < width:
        rest = width - span
        out = mix(out[:-rest] + out[rest:] * base + np.uint64(rest))
    return out


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
