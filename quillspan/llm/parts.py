"""Texts in parts, and hashes in buckets: the exchange under both repeat removers.

A part packs neighbouring rows of about PART_BYTES of text into one compressed Arrow payload, so a pass over all
texts moves few, large, well-compressed rows. A pass reads every part, sends hashes to buckets (one row for each
part and bucket, each hash once), and every bucket answers the parts that asked. A hash that fills a corpus
reaches a bucket once from each part, never once from each place.

Parts are cut once and stored; later passes read them and can't cut them in another way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, trim, written

PART_BYTES = 1_000_000
#: Hashes that a bucket should hold.
BUCKET = 400_000
#: Bytes of parts that a task of a join by part should read.
TASK_BYTES = 128_000_000


def parts_of(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """part, payload: rows (doc_id, text) of docs, whole, in parts of about part_bytes or one longer text; stored."""
    cols = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum([0, *(pc.binary_length(batch.column(1)).to_pylist())])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + part_bytes, "right")) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([packed(batch.slice(i, j - i))], pa.binary())], ["part", "payload"])
                part, i = part + 1, j

    return written(cols.mapInArrow(frugal(pack), "part bigint, payload binary"), "parts")


def with_answers(parts: DataFrame, said: DataFrame) -> DataFrame:
    """parts with their answers. The exchange has a task for each TASK_BYTES at least, however many the session sets."""
    size = parts.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0
    least = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, int(size / TASK_BYTES))
    if n > least:
        parts, said = parts.repartition(n, "part"), said.repartition(n, "part")
    return parts.join(said, "part", "left")


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def bucket_count(docs: DataFrame, per_byte: float, text: str = "text") -> int:
    """Buckets for about per_byte hashes for each byte of all texts."""
    return max(1, int(text_bytes(docs, text) * per_byte / BUCKET) + 1)


def of_parts(by: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its places) of places that are ordered by their part by[place]. One pass: a look at all places for each
    part would take parts times keys, which grows with the square of a corpus."""
    owner = by[places]
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(places) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(owner[a]), places[a:b]


def to_buckets(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the keys, by the upper half of each key."""
    at = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(at[order[a]]), order[a:b]


def asked(parts: DataFrame, ask: Callable[..., dict[str, np.ndarray]], buckets: int, opened: Callable | None = None) -> DataFrame:
    """bucket, part, data: what ask(opened payload, answers) sends of each part; opened: by unpacked(), a batch of
    documents, unless told otherwise. ask gives arrays of equal
    length; `key` (uint64, each once) deals them to buckets. Answers: the blobs in the column of that name, if any."""
    answered, opened = "answers" in parts.columns, opened or unpacked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.column("part")[r].as_py()
                answers = (batch.column("answers")[r].as_py() or []) if answered else []
                sent = ask(opened(batch.column("payload")[r].as_py()), answers)
                rows = [(b, part, frame({k: v[at] for k, v in sent.items()})) for b, at in to_buckets(sent["key"], buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], ["bucket", "part", "data"])

    return parts.mapInArrow(frugal(run), "bucket bigint, part bigint, data binary")


def frame(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one blob. Arrays of bytes objects make all of equal length and compressed."""
    if any(v.dtype == object for v in arrays.values()):
        columns = [pa.array(v, pa.binary()) if v.dtype == object else pa.array(v) for v in arrays.values()]
        return b"z" + packed(pa.RecordBatch.from_arrays(columns, list(arrays)))
    head = ",".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    return b"r" + len(head).to_bytes(2, "little") + head + b"".join(v.tobytes() for v in arrays.values())


def arrays_of(blob: bytes) -> dict[str, np.ndarray | pa.Array]:
    if blob[:1] == b"z":
        batch = unpacked(blob[1:])
        return {n: c if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
    n = int.from_bytes(blob[1:3], "little")
    at, out = 3 + n, {}
    for field in blob[3:at].decode().split(","):
        name, kind, length = field.split(":")
        out[name] = np.frombuffer(blob, np.dtype(kind), int(length), at)
        at += out[name].nbytes
    return out


def answers(sent: DataFrame, answer: Callable[[list[dict], np.ndarray], Iterator[tuple[int, dict]]]) -> DataFrame:
    """part, answers (array of blobs). answer gets a bucket's arrays, one dict for each part that asked, and the
    parts; it yields (place of the part, arrays)."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        order = np.argsort(parts, kind="stable")
        data = table.column("data")
        said = [(int(parts[order[k]]), frame(arrays)) for k, arrays in answer([arrays_of(data[int(i)].as_py()) for i in order], parts[order])]
        trim()
        return pa.table({"part": pa.array([x[0] for x in said], pa.int64()), "blob": pa.array([x[1] for x in said], pa.binary())})

    replied = sent.groupBy("bucket").applyInArrow(run, "part bigint, blob binary")
    return replied.groupBy("part").agg(F.collect_list("blob").alias("answers"))  # at most what the part has asked


def repeated_keys(asks: list[dict], parts: np.ndarray) -> Iterator[tuple[int, dict]]:
    """The keys that two parts or more have sent. With `check`, a key is the pair of both."""
    key = np.concatenate([a["key"] for a in asks])
    check = np.concatenate([a["check"] for a in asks]) if "check" in asks[0] else None
    by = np.repeat(np.arange(len(asks)), [len(a["key"]) for a in asks])
    hit = repeated_here(key, check)
    for k in np.unique(by[hit]):
        own = np.flatnonzero(hit & (by == k))
        own = own[np.argsort(key[own], kind="stable")]
        yield int(k), {"key": key[own]} | ({} if check is None else {"check": check[own]})


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which x are in the sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def member_pairs(x: np.ndarray, check: np.ndarray, among: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which pairs (x, check) are among the pairs sorted by their first. Of equal firsts two are looked at: with 64
    bits in a part, three don't occur."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    after = np.minimum(at + 1, len(among) - 1)
    return ((among[at] == x) & (checks[at] == check)) | ((among[after] == x) & (checks[after] == check))


def repeated_here(keys: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """Which keys (or pairs of key and check) stand more than once in the array."""
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    same = keys[order][1:] == keys[order][:-1]
    if check is not None:
        same &= check[order][1:] == check[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
