"""Suffix-array dedup: difference-cover blockwise construction over the suffixes that can repeat.

A byte is removed if a LENGTH-byte string covers it that also starts earlier (smaller doc_id, or earlier in the
same document). Three steps keep the suffix array to what matters:

1. Each LENGTH-byte string has an anchor, its GRAM-byte string of least hash; neighbouring starts share one and
   form a segment. Only segments whose anchor stands elsewhere too can hold a repeat; anchors are exchanged by hash.
2. Segments are dealt to buckets by anchor. Of segments with equal bytes the earliest stays. The others' suffixes are
   sorted, one suffix bucket (by leading bytes) at a time: by their first 16 bytes, and where these tie by the ranks of
   the suffixes at cover positions, computed beforehand by prefix doubling on the cover sample alone. Any two suffixes
   have a sample position at a common shift, so no tie needs more than one comparison of ranks.
3. Neighbours in the suffix array whose common prefix, compared byte by byte, reaches LENGTH form a class; all but its
   earliest start are repeats.

Hashes only deal the work; what is removed was compared by its bytes. An anchor with more than HOT segments (the edge
of a passage that stands in much of the corpus) would fill one bucket; its segments are dealt start by start, each
LENGTH-byte string to the bucket of its own hash, and go through the same sort there.

Defined results: null text is empty; rows of one doc_id are ordered as the table is read; the first of repeated
rows stays; a null doc_id comes first; texts of fewer than LENGTH bytes keep all; extra columns are ignored; an
empty table gives an empty result; a very long text is one row, worked through in runs of RUN_BYTES.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_table, documents, frugal, mix, prefix_sums, spans_hash, text_buffers, with_fields
from .parts import BUCKET, answers, arrays_of, asked, member, of_parts, parts_of, repeated_here, text_bytes, unpacked, with_answers

LENGTH = 100
GRAM = 36
STARTS = LENGTH - GRAM + 1
HOT = 4_000

PERIOD = 7
COVER = (0, 1, 3)
#: Suffixes sorted at once, and bytes of text whose suffixes are ranked at once (all segments of some anchors).
BLOCK = 200_000
TEXT = 1_000_000
#: Bytes of text in a part, and bytes that a worker hashes at once, which takes some hundred times as many.
PART_BYTES = 1_000_000
RUN_BYTES = 1_000_000
#: Every part meets every bucket, so their numbers must not both grow with the corpus: from GROWS bytes of text on parts
#: grow with it up to WIDEST times, buckets and HOT up to half as far.
GROWS = 1_000_000_000
WIDEST = 8

_BASE = 0x9E3779B97F4A7C15


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of keys[i : i + width] (40 upper bits), for each i that has so many."""
    out, step, bits = [], 1 << 23, np.uint64(24)
    for first in range(0, max(len(keys) - width + 1, 0), step):
        part = keys[first : first + step + width - 1]
        best = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < width:
            best = np.minimum(best[: len(part) - width + 1], best[width - span :])
        out.append((best & np.uint64((1 << 24) - 1)).astype(np.int64) + first)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Segments:
    """A part's segments: first and last start, anchor hash, document; `again`: an earlier one has the same bytes.
    A segment that crosses the end of a run is two of the same anchor."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, self.offsets = text_buffers(batch.column("text"))
        low, high, anchor, content = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint64))
        for a in range(0, len(self.data), RUN_BYTES):
            for column, x in zip((low, high, anchor, content), self.run(a, min(a + RUN_BYTES, len(self.data))), strict=True):
                column.append(x)
        self.low, self.high, self.anchor = np.concatenate(low), np.concatenate(high), np.concatenate(anchor)
        self.doc = np.searchsorted(self.offsets, self.low, "right") - 1
        ids = batch.column("doc_id").cast(pa.int64())
        own = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.doc_id = own[self.doc] if len(own) else np.zeros(0, np.int64)
        self.again = self.repeated(np.concatenate(content))

    def run(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, anchor, hash of the bytes) of the segments of the starts in [begin, end)."""
        data = self.data[begin : min(end + LENGTH - 1, len(self.data))]
        sums = prefix_sums(byte_table(50)[data], _BASE)
        starts = np.arange(max(len(data) - GRAM + 1, 0))
        grams = spans_hash(sums, starts, starts + GRAM, _BASE)
        del starts
        at = least_places(grams, STARTS)[: end - begin]  # one for each start at which LENGTH bytes follow in the part
        edges = np.clip(self.offsets - begin, 0, len(at))
        last = np.repeat(self.offsets[1:], np.diff(edges)) - begin - LENGTH
        sound = np.arange(len(last)) <= last
        at = at[: len(last)]
        change = np.ones(len(at) + 1, bool)
        change[1:-1] = (at[1:] != at[:-1]) | (sound[1:] != sound[:-1])
        change[edges[edges < len(change)]] = True
        cuts = np.flatnonzero(change)
        low, high = cuts[:-1], cuts[1:] - 1
        keep = sound[low] if len(low) else np.zeros(0, bool)
        low, high = low[keep], high[keep]
        # least hashes crowd near 0; mixed once more, they fill the buckets evenly
        anchor = mix(grams[at[low]]) if len(low) else np.zeros(0, np.uint64)
        return low + begin, high + begin, anchor, spans_hash(sums, low, high + LENGTH, _BASE)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.low[i] : self.high[i] + LENGTH].tobytes()

    def repeated(self, content: np.ndarray) -> np.ndarray:
        """Which segments have the same bytes as one that comes first among those of their hash."""
        order = np.lexsort((np.arange(len(content)), self.doc_id, content))
        same = np.flatnonzero(np.r_[False, content[order][1:] == content[order][:-1]])
        out = np.zeros(len(content), bool)
        first, head = -2, b""
        for k in same.tolist():
            if k != first + 1:
                head = self.bytes_of(order[k - 1])
            first = k
            out[order[k]] = self.bytes_of(order[k]) == head
        return out


def ask_anchors(batch: pa.RecordBatch, _: list) -> dict[str, np.ndarray]:
    own = Segments(batch)
    key, count = np.unique(own.anchor[~own.again], return_counts=True)
    return {"key": key, "count": count.astype(np.uint32)}


def repeated_anchors(asks: list[dict], parts: np.ndarray, hot: int = HOT) -> Iterator[tuple[int, dict]]:
    """Anchors of several segments, those of more than hot marked."""
    key = np.concatenate([a["key"] for a in asks])
    by = np.repeat(np.arange(len(asks)), [len(a["key"]) for a in asks])
    known, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([a["count"] for a in asks]), minlength=len(known))[back]
    for k, own in of_parts(by, np.flatnonzero(total > 1)):
        own = own[np.argsort(key[own])]
        yield k, {"key": key[own], "hot": (total[own] > hot).astype(np.uint8)}


def ask_segments(batch: pa.RecordBatch, said: list[bytes]) -> dict:
    """The earliest of each content among the segments whose anchor repeats, with their text."""
    own = Segments(batch)
    got = [arrays_of(b) for b in said]
    known = np.concatenate([np.zeros(0, np.uint64), *(g["key"] for g in got)])
    hot = np.concatenate([np.zeros(0, np.uint8), *(g["hot"] for g in got)])[np.argsort(known, kind="stable")]
    known = np.sort(known, kind="stable")
    use = np.flatnonzero(~own.again & member(own.anchor, known))
    is_hot = hot[np.searchsorted(known, own.anchor[use])] > 0 if len(use) else np.zeros(0, bool)
    cool, warm = use[~is_hot], use[is_hot]
    # start by start: each string is a segment of its own, dealt by its own hash
    width = own.high[warm] - own.low[warm] + 1
    shift = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    seg = np.concatenate([cool, np.repeat(warm, width)])
    low = np.concatenate([own.low[cool], np.repeat(own.low[warm], width) + shift])
    high = np.concatenate([own.high[cool], low[len(cool) :]])
    texts = [own.data[a:b].tobytes() for a, b in zip(low.tolist(), (high + LENGTH).tolist(), strict=True)]
    key = np.concatenate([own.anchor[cool], np.array([xxhash.xxh3_64_intdigest(t) for t in texts[len(cool) :]], np.uint64)])
    return {
        "key": key, "seg": seg.astype(np.uint32), "doc_id": own.doc_id[seg], "shift": np.concatenate([np.zeros(len(cool), np.uint8), shift.astype(np.uint8)]),
        "starts": (high - low + 1).astype(np.uint8), "text": as_objects(texts),
    }


def as_objects(texts: list[bytes]) -> np.ndarray:
    out = np.empty(len(texts), object)
    out[:] = texts
    return out


def cover_shifts() -> np.ndarray:
    """shift[a, b]: the least shift that takes both residues into the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


def sample_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by their first 112 bytes; 0 elsewhere. words: 8 bytes from each place."""
    ranks = np.zeros(n + 256, np.int64)
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    order = np.lexsort((words[sample + 6], words[sample]))
    a, b = words[sample][order], words[sample + 6][order]
    ranks[sample[order]] = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    for depth in (14, 28, 56):  # multiples of PERIOD, so the sample holds the places that it asks for
        ranks[sample] = np.unique((ranks[sample] << 32) | ranks[sample + depth], return_inverse=True)[1] + 1
    return ranks


def suffix_order(text: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffix bucket after suffix bucket: places in starts by rising suffix, and whether LENGTH bytes or more agree with
    the one before. At least LENGTH bytes follow each start."""
    n = len(text)
    padded = np.zeros(n + 256, np.uint64)
    padded[:n] = text
    words = np.zeros(n + 248, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    ranks = sample_ranks(words, n)
    span = int(ranks.max(initial=0)) + 1
    lead = (words[starts] >> np.uint64(40)).astype(np.int64)  # three leading bytes
    by_lead = np.argsort(lead, kind="stable")
    edges = np.flatnonzero(np.r_[True, lead[by_lead][1:] != lead[by_lead][:-1], True]) if len(starts) else np.zeros(1, np.int64)
    shifts = cover_shifts()
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + BLOCK, "right")) - 1)
        block = by_lead[edges[first] : edges[last]]
        first = last
        p = starts[block]
        order = np.lexsort((words[p + 8], words[p]))
        block, p = block[order], p[order]
        new = np.r_[True, (words[p][1:] != words[p][:-1]) | (words[p + 8][1:] != words[p + 8][:-1])]
        group = np.cumsum(new) - 1
        before = np.zeros(len(p), np.int64)
        residue = p % PERIOD
        mine = [np.flatnonzero(residue == r) for r in range(PERIOD)]
        for b in range(PERIOD):
            if not len(mine[b]):
                continue
            less = np.r_[0, np.cumsum(np.bincount(group[mine[b]], minlength=group[-1] + 1))]
            keys = {int(d): np.sort(group[mine[b]] * span + ranks[p[mine[b]] + d]) for d in np.unique(shifts[:, b])}
            for a in range(PERIOD):
                if len(mine[a]):
                    d = int(shifts[a, b])
                    found = np.searchsorted(keys[d], group[mine[a]] * span + ranks[p[mine[a]] + d])
                    before[mine[a]] += found - less[group[mine[a]]]
        order = np.lexsort((before, group))
        q = p[order]
        # neighbours with 16 bytes in common, then the rest of LENGTH, eight bytes after eight
        near = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        for k in (*range(16, LENGTH - 8, 8), LENGTH - 8):
            near = near[words[q[near] + k] == words[q[near - 1] + k]]
        equal = np.zeros(len(q), bool)
        equal[near] = True
        yield block[order], equal


def anchor_groups(key: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Runs of the sorted keys, never parting equal ones, of TEXT bytes or one key's."""
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    before = np.r_[0, np.cumsum(sizes)][edges]
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(before, before[i] + TEXT, "right")) - 1)
        yield slice(int(edges[i]), int(edges[j]))
        i = j


def later_starts(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, count: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment, start in it) of the strings that repeat an earlier one, of the given segments."""
    sizes = offsets[left + 1] - offsets[left]
    begin = np.cumsum(sizes) - sizes
    text = data[np.repeat(offsets[left] - begin, sizes) + np.arange(sizes.sum())]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, owner = np.repeat(begin, count) + step, np.repeat(left, count)
    for block, equal in suffix_order(text, at):
        kind = np.cumsum(~equal)
        by_age = np.lexsort((step[block], rank[owner[block]], kind))
        later = by_age[np.r_[False, kind[by_age][1:] == kind[by_age][:-1]]]
        yield owner[block][later], step[block][later]


def first_of_equals(raw: memoryview, offsets: list[int], order: list[int]) -> list[int]:
    """The segments that have the bytes of one before them in the order."""
    seen: set[bytes] = set()
    out = []
    for i in order:
        text = bytes(raw[offsets[i] : offsets[i + 1]])
        if text in seen:
            out.append(i)
        else:
            seen.add(text)
    return out


def repeats_in_bucket(asks: list[dict], parts: np.ndarray) -> Iterator[tuple[int, dict]]:
    """For each part, the starts (seg, low to high from the segment's first) that repeat an earlier string."""
    size = [len(a["seg"]) for a in asks]
    by = np.repeat(np.arange(len(asks)), size)
    key, seg, doc, shift, starts = (np.concatenate([a[c] for a in asks]) for c in ("key", "seg", "doc_id", "shift", "starts"))
    texts = pa.concat_arrays([a["text"] for a in asks])
    seg, shift, starts = seg.astype(np.int64), shift.astype(np.int64), starts.astype(np.int64)
    by_age = np.lexsort((shift, seg, by, doc))  # parts come in order
    rank = np.empty(len(seg), np.int64)
    rank[by_age] = np.arange(len(seg))
    data, offsets = text_buffers(texts.cast(pa.large_binary()))
    twice = repeated_here(key)
    again = np.array(first_of_equals(memoryview(data), offsets.tolist(), by_age[twice[by_age]].tolist()), np.int64)
    low = [shift[again]]
    high = [shift[again] + starts[again] - 1]
    whose = [again]
    left = twice.copy()
    left[again] = False
    left = np.flatnonzero(left)
    left = left[repeated_here(key[left])]  # alone with its anchor, a segment repeats nothing
    left = left[np.argsort(key[left], kind="stable")]
    for some in anchor_groups(key[left], (offsets[left + 1] - offsets[left])):
        mine = left[some]
        for owner, place in later_starts(data, offsets, mine, starts[mine], rank):
            low.append(shift[owner] + place)
            high.append(shift[owner] + place)
            whose.append(owner)
    low, high, whose = np.concatenate(low), np.concatenate(high), np.concatenate(whose)
    order = np.lexsort((low, whose))
    low, high, whose = low[order], high[order], whose[order]
    new = np.r_[True, (whose[1:] != whose[:-1]) | (low[1:] != high[:-1] + 1)] if len(low) else np.zeros(0, bool)
    ends = np.r_[np.flatnonzero(new)[1:] - 1, len(low) - 1] if len(low) else np.zeros(0, np.int64)
    low, high, whose = low[new], high[ends] if len(low) else high, whose[new]
    for k, own in of_parts(by[whose], np.arange(len(whose))):
        yield k, {"seg": seg[whose[own]].astype(np.uint32), "low": low[own].astype(np.uint8), "high": high[own].astype(np.uint8)}


def removed_bytes(own: Segments, said: list[bytes]) -> np.ndarray:
    """Which bytes of a part a repeated string covers."""
    got = [arrays_of(b) for b in said]
    low, high = [own.low[own.again]], [own.high[own.again]]
    for g in got:
        first = own.low[g["seg"].astype(np.int64)]
        low.append(first + g["low"])
        high.append(first + g["high"])
    edge = np.zeros(len(own.data) + 1, np.int32)
    np.add.at(edge, np.concatenate(low), 1)
    np.add.at(edge, np.concatenate(high) + LENGTH, -1)
    return np.cumsum(edge, dtype=np.int32, out=edge)[:-1] > 0


def before(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many marks stand before each of the rising places."""
    return np.cumsum([0, *(np.count_nonzero(marks[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True))])


def widths(size: int) -> tuple[float, float]:
    """How many times their usual size buckets and parts have for so many bytes of text."""
    wider = min(max(size / GROWS, 1.0), float(WIDEST))
    return max(wider / 2, 1.0), wider


def remove_repeats(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary), the remaining bytes."""
    size = text_bytes(docs, text)
    wide, wider = widths(size)
    parts = parts_of(docs, text, int(PART_BYTES * wider))
    buckets = size * 2.2 / (STARTS + 1) / BUCKET / wide
    anchors = answers(asked(parts, ask_anchors, int(buckets) + 1), functools.partial(repeated_anchors, hot=int(hot * wide)))
    # a quarter of the segments, and a tenth as many to a bucket
    repeats = answers(asked(with_answers(parts, anchors), ask_segments, int(buckets * 2.5) + 1), repeats_in_bucket)
    schema = with_fields(docs.select("doc_id").schema, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs_here = unpacked(batch.column("payload")[r].as_buffer())
                own = Segments(docs_here)
                gone = removed_bytes(own, batch.column("answers")[r].as_py() or [])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[own.offsets[:-1][own.offsets[:-1] < len(gone)]] |= gone[own.offsets[:-1][own.offsets[:-1] < len(gone)]]
                total, spans = before(gone, own.offsets), before(begins, own.offsets)
                removed, runs = np.diff(total), np.diff(spans)
                left = own.data[~gone].tobytes()
                at = own.offsets - total
                kept = [left[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs_here.column("doc_id"), pa.array(np.diff(own.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], schema.names)

    return with_answers(parts, repeats).mapInArrow(frugal(cut), schema)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
