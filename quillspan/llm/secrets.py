"""Secret scans by multipart credential linking.

Strong spans (kinds assign, access, hex) stand by themselves. Weak parts - an identifier, a secret-looking
value, an endpoint - are reported only when all complementary parts meet in one scope: SCOPE code points, in which a
part lies whole (of a longer part, its first SCOPE). A scope completes a credential if a secret (weak or strong) and
either a strong access key, or a weak identifier and an endpoint, lie in it. Parts are joined by position: a weak part
is reported if some scope that holds it completes a credential. A scope doesn't grow by what it holds.

Defined results: null text counts as empty; repeated rows are scanned alike; parts that start together are told in
the order of their kinds; columns named like a result give way to it where find_secrets() adds it, and are kept by
redacted_documents(); an empty table gives an empty result. Texts are scanned whole, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT, arrow_of, documents, frugal

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("weak_id", "weak_secret", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
#: Code points that a scope spans.
SCOPE = 320

# All patterns are ASCII, so they run on UTF-8 bytes; positions are turned into code points afterwards.
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_HEX_HINT = re.compile(rb"[0-9a-f]{12}")
_WEAK_ID = re.compile(rb"(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{2,})", re.IGNORECASE)
_WEAK_SECRET = re.compile(rb"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(rb"(?:https?|postgres(?:ql)?|mysql|redis|amqp|s3)://[A-Za-z0-9._-]+(?::[0-9]+)?|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{4,}", re.IGNORECASE)
_ENDPOINT_HINTS = (b"://", b"host", b"endpoint", b"server")


def strong_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, leftmost and non-overlapping in each kind."""
    low, out = raw.lower(), []
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    return out


def linked_spans(raw: bytes, strong: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of the weak parts that complete a credential. strong: in bytes too."""
    low = raw.lower()
    points = [m.span() + ("endpoint",) for m in _ENDPOINT.finditer(raw)] if any(h in low for h in _ENDPOINT_HINTS) else []
    access = [s for s in strong if s[2] == "access"]
    if not points and not access:
        return []
    weak_ids = [m.span() + ("weak_id",) for m in _WEAK_ID.finditer(raw)]
    if not access and not weak_ids:
        return []
    weak = [m.span() + ("weak_secret",) for m in _WEAK_SECRET.finditer(raw)]
    if weak and strong:
        # a weak secret that overlaps a strong span adds nothing: of the spans that start before its end, one ends after its start
        begins, ends = map(np.array, zip(*sorted((a, b) for a, b, _ in strong), strict=True))
        reach = np.r_[-1, np.maximum.accumulate(ends)]
        weak = [w for w in weak if reach[np.searchsorted(begins, w[1], "left")] <= w[0]]
    parts = sorted([*points, *strong, *weak_ids, *weak])
    start, end = code_points(raw, np.array([p[0] for p in parts])), code_points(raw, np.array([p[1] for p in parts]))
    last = np.minimum(end, start + scope)
    return [parts[i] for i in np.flatnonzero(in_scope(start, last, [p[2] for p in parts], scope)) if parts[i][2] in WEAK_KINDS]


def code_points(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The code points before each of the bytes."""
    if raw.isascii():
        return at
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    edges = np.unique(np.r_[0, at[at < len(raw)]])
    before = np.r_[0, np.cumsum(np.add.reduceat(lead, edges, dtype=np.int64))]
    return before[np.searchsorted(edges, at)]


def in_scope(start: np.ndarray, last: np.ndarray, kinds: list[str], scope: int) -> np.ndarray:
    """Which parts lie in a scope that completes a credential; parts by start. The scopes that matter begin at a part's
    start, so each is an interval [start, start + scope]; of each kind, the part from there on that ends first tells
    whether one lies in it. A part lies in a complete scope if one begins at most scope before its end and not after
    its start: n log n in all."""
    n = len(start)
    edge = start + scope
    ends = {}
    for kind in {*kinds}:
        own = np.array([k == kind for k in kinds])
        least = np.where(own, last, np.iinfo(np.int64).max)
        ends[kind] = np.minimum.accumulate(least[::-1])[::-1]
    none = np.full(n, np.iinfo(np.int64).max)
    holds = lambda *some: np.minimum.reduce([ends.get(k, none) for k in some]) <= edge
    complete = holds("weak_secret", "assign", "hex") & (holds("access") | (holds("weak_id") & holds("endpoint")))
    begins = np.r_[0, np.cumsum(complete)]
    return begins[np.searchsorted(start, start, "right")] > begins[np.searchsorted(start, last - scope, "left")]


def scan_text(raw: bytes) -> list[tuple[int, int, str]]:
    """All spans of one text in code points, by start, then kind in KINDS' order."""
    strong = strong_spans(raw)
    if _HEX_HINT.search(raw):
        strong += [m.span() + ("hex",) for m in _HEX.finditer(raw)]
    spans = strong + linked_spans(raw, strong)
    if not spans:
        return []
    start, end = (code_points(raw, np.array([s[i] for s in spans])).tolist() for i in (0, 1))
    spans = [(a, b, k) for a, b, (_, _, k) in zip(start, end, spans, strict=True)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


SPAN_FIELD = "spans array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """The kept columns with `spans`, array<struct<kind,start,end>> in code points; with redact, `text` with every
    span replaced by that string (overlapping spans become one)."""
    keep = docs.columns if keep is None else keep
    added = SPAN_FIELD if redact is None else f"{SPAN_FIELD}, `{text}` string"
    schema = arrow_of(docs, keep, added)
    return _scanned(docs, text, schema, redact, True)


def redacted_documents(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """docs, all columns as they are but for the text, in which every span is replaced by that string."""
    others = [c for c in docs.columns if c != text]
    return _scanned(docs, text, arrow_of(docs, others, f"`{text}` string"), by, False).select(*docs.columns)


def _scanned(docs: DataFrame, text: str, schema: T.StructType, redact: str | None, spans_too: bool) -> DataFrame:
    """The schema's columns: those of docs, then the spans and the text with its spans replaced, as asked for."""
    keep = schema.names[: -(spans_too + (redact is not None))]
    cols = docs.select(*keep, F.col(text).alias(TEXT))
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for t in batch.column(len(keep)):
                t = t.as_py()
                found = scan_text(t.encode()) if t else []
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found] if spans_too else None)
                if redact is not None:
                    clean.append(redacted(t, found, redact))
            out = [batch.column(i) for i in range(len(keep))]
            if spans_too:
                out.append(pa.array(spans, arrow_span))
            if redact is not None:
                out.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return cols.mapInArrow(frugal(scan), schema)


def redacted(text: str | None, spans: list[tuple[int, int, str]], by: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
