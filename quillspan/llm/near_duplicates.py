"""Near-duplicates by ProbMinHash over weighted shingles, banding, verification and components.

A document is the multiset of its five-word shingles (fewer words: one shingle of all). Each shingle's arrivals
are a Poisson process of its weight, dealt to REGISTERS registers; a register keeps its earliest arrival, and a
shingle stops once its next arrival comes after every register's. Equal registers estimate the probability
Jaccard similarity. Bands of registers give candidate buckets.

A bucket's members are first compared with its pivot: the most central member, the one whose buckets are largest
together, so that the source of many edited copies comes first. While rounds still find many links (GAIN), a bucket's
next PIVOTS pivots are the most central members that have neither a link nor been a pivot. GAIN parts the work between
the two steps only: whatever the rounds leave, all members that share a bucket with another class go through
unlinked_pairs(), an exact join of the whole multisets. So every pair of SIMILAR or more that shares a bucket ends in
one class. Each comparison is exact: probability Jaccard of the whole multisets. Rows of a part (neighbouring rows of
the table) with equal words are one node, and a part asks for a bucket once, however many copies there are.

Defined results: null text or text without words is in a class of its own; repeated rows share a class; a class
is named by its least doc_id (null counts last; ties stay by the table's order); extra columns are ignored, and kept
by without_near_duplicates(); an empty table gives an empty result; a very long text is one row, its shingles counted
in runs of RUN_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, documents, frugal, keyed, mix, runs_of, scratch, text_buffers, window_hashes, word_hashes, word_spans, written
from .parts import BUCKET, answers, arrays_of, asked, frame, member, packed, unpacked
from .substrings import stretches

SHINGLE = 5
SIMILAR = 0.8
ROWS = 6
BANDS = 32
REGISTERS = ROWS * BANDS
#: Bytes of text that make a part, whose shingles are hashed at once.
CHUNK = 1_000_000
#: A row's uid is its part and, in ROW_BITS, its place there; a part's number is its partition's and, in PART_BITS, its
#: place there. Both are stored with the part.
ROW_BITS = 20
PART_BITS = 24
#: Rounds go on while a round finds a link for this share of the members of buckets; the rest is for unlinked_pairs().
GAIN = 0.02
#: Pivots of a bucket in each round after the first.
PIVOTS = 3
#: Words of 64 bits in the outline of a multiset.
OUTLINE = 12
#: Edges that one task contracts at once.
EDGES = 500_000

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of each distinct shingle by document."""
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(before)
    many = np.maximum(count - SHINGLE + 1, 0)
    doc = np.repeat(np.arange(len(count)), many)
    at = np.repeat(before[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    keys = window_hashes(words, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    short = [window_hashes(words[before[d] : before[d + 1]], int(count[d]))[0] + np.uint64(count[d]) for d in few.tolist()]
    return counted(np.r_[doc, few], np.r_[keys, np.array(short, np.uint64)], np.ones(len(doc) + len(few)))


def counted(doc: np.ndarray, keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys of a document once, with the sum of their weights."""
    order = np.lexsort((keys, doc))
    doc, keys, weight = doc[order], keys[order], weight[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], keys[new], np.add.reduceat(weight, new) if len(new) else weight


def shingles_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shingles(); a long text alone is hashed stretch by stretch, each with the last words of the one before."""
    if len(offsets) > 2 or len(data) <= 2 * CHUNK:
        return shingles(data, offsets)
    out, carried = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))], np.zeros(0, np.uint64)
    for a, b in stretches(data):
        starts, ends, _ = word_spans(data[a:b], np.array([0, b - a]))
        words = np.r_[carried, word_hashes(data[a:b], starts, ends)]
        keys = window_hashes(words, SHINGLE)
        out.append(counted(np.zeros(len(keys), np.int64), keys, np.ones(len(keys))))
        carried = words[max(0, len(words) - SHINGLE + 1) :]
    if sum(len(o[0]) for o in out):
        return counted(*(np.concatenate(c) for c in zip(*out, strict=True)))
    return shingles(data, offsets)  # one of few, very long words


def contents(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A digest of 128 bits of each text's words, b"" without words."""
    raw = data.tobytes()
    out = np.empty(len(offsets) - 1, object)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        said = b" ".join(raw[a:b].split())
        out[i] = xxhash.xxh3_128_digest(said) if said else b""
    return out


def signatures(doc: np.ndarray, keys: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """docs x registers: the shingle whose arrival each register keeps; 0 where a document has none."""
    best = np.full(docs * registers, np.inf)
    kept = np.zeros(docs * registers, np.uint64)
    time = np.zeros(len(keys))
    limit = np.full(docs, np.inf)
    arrival = 0
    while len(keys):
        arrival += 1
        draw = mix(keys + np.uint64(_STEP * arrival & _MASK))
        time = time - np.log(((draw >> np.uint64(32)).astype(float) + 0.5) / 2.0**32) / weight
        live = time < limit[doc]
        doc, keys, weight, time, draw = doc[live], keys[live], weight[live], time[live], draw[live]
        slot = doc * registers + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        kept[slot[won]] = keys[won]
        if len(doc):
            own = doc[np.r_[True, doc[1:] != doc[:-1]]]
            limit[own] = best.reshape(docs, registers)[own].max(axis=1)
    return kept.reshape(docs, registers)


def band_keys(kept: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """docs x bands, a hash of the band's number and registers."""
    parts = kept.reshape(len(kept), -1, rows)
    out = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(_STEP), parts.shape[:2]).copy()
    for i in range(rows):
        out = mix(out ^ parts[:, :, i]) + np.uint64(_STEP)
    return out


def signed(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """part, payload, body: the rows of docs in parts, stored. A part's payload holds uid, doc_id, known (whether doc_id
    isn't null), row (the column of that name), head (the place of the first row of the same words; -1 without words)
    and, for each head, its bands; its body, the heads' texts."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(row) if row else F.lit(0)).cast("long").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << PART_BITS
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in runs_of(offsets, CHUNK):
                own_data, own_offsets = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                content = contents(own_data, own_offsets)
                first, back = np.unique(content, return_index=True, return_inverse=True)[1:]
                head = np.where(content != b"", first[back], -1)
                heads = np.flatnonzero(head == np.arange(j - i))
                new = np.full(j - i, -1)
                new[heads] = np.arange(len(heads))
                doc, keys, weight = shingles_of(own_data, own_offsets)
                mine = new[doc] >= 0
                bands = band_keys(signatures(new[doc[mine]], keys[mine], weight[mine], len(heads)))
                ids = batch.column(0)[i:j]
                blob = frame({
                    "uid": (part << ROW_BITS) + np.arange(j - i), "doc_id": ids.fill_null(0).to_numpy(), "known": (~ids.is_null().to_numpy(zero_copy_only=False)).astype(np.uint8),
                    "row": batch.column(2)[i:j].to_numpy(), "head": head, "bands": bands.ravel(),
                })
                texts = pa.RecordBatch.from_arrays([batch.column(1)[i:j].fill_null("").take(pa.array(heads))], ["text"])
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([blob], pa.binary()), pa.array([packed(texts)], pa.binary())], ["part", "payload", "body"])
                part += 1

    return written(cols.mapInArrow(frugal(run), "part bigint, payload binary, body binary"), "near-signed")


def ask_counts(own: dict, _: list) -> dict[str, np.ndarray]:
    key, count = np.unique(own["bands"], return_counts=True)
    return {"key": key, "count": count.astype(np.int64)}


def bucket_sizes(asks: list[dict], parts: np.ndarray) -> Iterator[tuple[int, dict]]:
    """The sizes of the buckets of two members or more."""
    key, count = np.concatenate([a["key"] for a in asks]), np.concatenate([a["count"] for a in asks])
    by = np.repeat(np.arange(len(asks)), [len(a["key"]) for a in asks])
    back = np.unique(key, return_inverse=True)[1]
    total = np.bincount(back, weights=count).astype(np.int64)[back]
    for k in np.unique(by[total > 1]):
        own = (by == k) & (total > 1)
        yield int(k), {"key": key[own], "total": total[own]}


def members(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, payload) and (uid, own) of the heads that share a bucket, stored. A payload holds uid and central (the sum
    of the sizes of its buckets) of each, and its buckets as key and row; own is a head's packed shingles: its sorted
    hashes, then their weights."""
    sizes = answers(asked(parts, ask_counts, bucket_count_of(parts), arrays_of), bucket_sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.binary())
        for batch in batches:
            for r in range(batch.num_rows):
                own = arrays_of(batch.column("payload")[r].as_py())
                got = [arrays_of(b) for b in batch.column("answers")[r].as_py()]
                known, total = np.concatenate([g["key"] for g in got]), np.concatenate([g["total"] for g in got])
                order = np.argsort(known)
                known, total = known[order], total[order]
                hit = np.flatnonzero(member(own["bands"], known))
                row = hit // BANDS
                central = np.bincount(row, weights=total[np.searchsorted(known, own["bands"][hit])])
                used, place = np.unique(row, return_inverse=True)
                heads = own["uid"][own["head"] == np.arange(len(own["head"]))]
                blob = frame({"uid": heads[used], "central": central[used].astype(np.int64), "key": own["bands"][hit], "row": place})
                data, offsets = text_buffers(unpacked(batch.column("body")[r].as_buffer()).column(0).take(pa.array(used)))
                held = []
                for i, j in runs_of(offsets, CHUNK):
                    doc, keys, weight = shingles_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    edges = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                    held += [keys[a:b].tobytes() + np.minimum(weight[a:b], 2**31).astype(np.uint32).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("part")[r : r + 1], pa.array([blob], pa.binary()), pa.array([held], kind)], ["part", "payload", "held"])

    joined = parts.join(sizes, "part").select("part", "payload", "body", "answers")
    own = written(joined.mapInArrow(frugal(run), "part bigint, payload binary, held array<binary>"), "near-members")

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, held in zip(batch.column(0), batch.column(1), strict=True):
                uid = arrays_of(payload.as_py())["uid"]
                yield pa.RecordBatch.from_arrays([pa.array(uid), held.values], ["uid", "own"])

    return own.select("part", "payload"), own.select("payload", "held").mapInArrow(one_by_one, "uid bigint, own binary")


def bucket_count_of(parts: DataFrame) -> int:
    """Buckets for the exchange, by the bytes of the parts."""
    return max(8, int((parts.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0) / 8 / BUCKET))


def best_open(key: np.ndarray, central: np.ndarray, uid: np.ndarray, most: int) -> np.ndarray:
    """Places of the most central members of each key, ties to the smaller uid."""
    order = np.lexsort((uid, -central, key))
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < most]


def pivot_pairs(parts: DataFrame, closed: DataFrame | None, most: int) -> DataFrame:
    """a, b: each bucket's pivots a and its other members b. A bucket's pivots are its most central members that
    aren't closed. closed: part, answers: the closed uids of each part as a blob."""

    def ask(own: dict, said: list[bytes]) -> dict[str, np.ndarray]:
        """The part's best open members of each bucket, or -1 for one that has none."""
        got = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, np.int64) for b in said)]))
        row = own["row"]
        central = np.where(member(own["uid"], got), -1, own["central"])[row]
        first = best_open(own["key"], central, own["uid"][row], most)
        return {"key": own["key"][first], "central": central[first], "uid": own["uid"][row][first]}

    def choose(asks: list[dict], asking: np.ndarray) -> Iterator[tuple[int, dict]]:
        key, central, uid = (np.concatenate([x[c] for x in asks]) for c in ("key", "central", "uid"))
        by = np.repeat(np.arange(len(asks)), [len(x["key"]) for x in asks])
        best = best_open(key, central, uid, most)
        best = best[central[best] >= 0]
        for k in np.unique(by):
            mine = best[member(key[best], np.unique(key[by == k]))]
            if len(mine):
                yield int(k), {"key": key[mine], "pivot": uid[mine]}

    state = parts
    if closed is not None:
        state = parts.join(closed, "part", "left").select("part", "payload", "answers")
    pivots = answers(asked(state, ask, bucket_count_of(parts), arrays_of), choose)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = arrays_of(batch.column("payload")[r].as_py())
                got = [arrays_of(b) for b in batch.column("answers")[r].as_py()]
                known, pivot = np.concatenate([g["key"] for g in got]), np.concatenate([g["pivot"] for g in got])
                order = np.argsort(known, kind="stable")
                known, pivot = known[order], pivot[order]
                first, last = np.searchsorted(known, own["key"], "left"), np.searchsorted(known, own["key"], "right")
                n = last - first
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x, y = pivot[at], np.repeat(own["uid"][own["row"]], n)
                pair = np.unique(np.stack([x, y], 1)[x != y], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return parts.join(pivots, "part").mapInArrow(run, "a bigint, b bigint")


def multiset(own: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes and weights of packed shingles."""
    n = len(own) // 12
    return np.frombuffer(own, np.uint64, n), np.frombuffer(own, np.uint32, n, 8 * n).astype(float)


def similarity(a: bytes, b: bytes) -> float:
    """Probability Jaccard of two packed multisets: the sum over shared shingles of 1 / sum over all of the larger of
    the two ratios of weights."""
    (x, u), (y, v) = multiset(a), multiset(b)
    keys = np.union1d(x, y)
    wx, wy = np.zeros(len(keys)), np.zeros(len(keys))
    wx[np.searchsorted(keys, x)] = u
    wy[np.searchsorted(keys, y)] = v
    both = np.flatnonzero((wx > 0) & (wy > 0))
    if not len(both):
        return 0.0
    # for a shared d: 1 / sum_e max(wx[e] / wx[d], wy[e] / wy[d]); by the ratio of the weights, in n log n
    ratio = np.where(wy > 0, wx / np.maximum(wy, 1e-300), np.inf)
    order = np.argsort(ratio)
    sorted_ratio = ratio[order]
    sx, sy = np.r_[0, np.cumsum(wx[order])], np.r_[0, np.cumsum(wy[order])]
    cut = np.searchsorted(sorted_ratio, ratio[both], "right")
    total = (sx[-1] - sx[cut]) / wx[both] + sy[cut] / wy[both]
    return float((1 / total).sum())


def similar(a: bytes, b: bytes) -> bool:
    """Whether two packed multisets are SIMILAR or more. First by the bound of unlinked_pairs(): with p and q the
    shares of weight in shingles of both, J_P <= p q / (p + q - p q)."""
    (x, u), (y, v) = multiset(a), multiset(b)
    p, q = u[member(x, y)].sum() / u.sum(), v[member(y, x)].sum() / v.sum()
    return p * q >= (SIMILAR - 1e-6) * (p + q - p * q) and similarity(a, b) >= SIMILAR - 1e-9


def verified(pairs: DataFrame, table: DataFrame, lasting: bool = False) -> DataFrame:
    """pairs (a, b) with similar, whether they are SIMILAR or more, stored."""
    left, right = table.select(F.col("uid").alias("a"), F.col("own").alias("x")), table.select(F.col("uid").alias("b"), F.col("own").alias("y"))
    joined = pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(said, pa.bool_())], ["a", "b", "similar"])

    return written(joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, similar boolean"), "near-verified", lasting)


def links(parts: DataFrame, gain: float = GAIN) -> DataFrame:
    """a, b: links between heads that make the classes: every pair of SIMILAR or more that shares a bucket is linked
    over some of them. gain: the share of links under which the pivot rounds end (0: once they find none)."""
    own, table = members(parts)
    every = spent = closed = None
    most, size = 1, table.count()
    while True:
        fresh = verified(pivot_pairs(own, closed, most), table)
        found = fresh.where("similar").select("a", "b")
        every = found if every is None else every.unionByName(found)
        if found.count() <= gain * size:
            break
        # closed: members with a link, and spent pivots
        mine = fresh.select(F.col("a").alias("uid")).unionByName(found.select(F.col("b").alias("uid")))
        spent = mine if spent is None else spent.unionByName(mine)
        closed = packed_uids(spent.groupBy(F.shiftright("uid", ROW_BITS).alias("part")).agg(F.collect_set("uid").alias("uids")))  # rows of a part
        most = PIVOTS
    roots = components(every)
    with scratch():
        rest = verified(unlinked_pairs(own, table, roots), table, lasting=True).where("similar")
    return roots.select(F.col("uid").alias("a"), F.col("root").alias("b")).unionByName(rest.select("a", "b"))


def largest(x: Column, y: Column) -> Column:
    """The most that J_P can be of two multisets of which the shares x and y aren't shared. With p = 1 - x and
    q = 1 - y, J_P is the sum over shared d of at most p q / (p + x q), so J_P <= p q / (p + q - p q)."""
    return (1 - x) * (1 - y) / (1 - x * y)


def outline(own: bytes) -> tuple[int, ...]:
    """(shingles, weight, words) of a packed multiset: each bit of the OUTLINE words tells whether an odd number of its
    shingles falls on it. Two outlines differ in no more bits than the multisets in shingles."""
    keys, weight = multiset(own)
    odd = np.bincount((keys >> np.uint64(7)) % np.uint64(64 * OUTLINE), minlength=64 * OUTLINE) & 1
    words = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return len(keys), int(weight.sum()), *words.tolist()


def unlinked_pairs(parts: DataFrame, table: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: the pairs, among the members that share a bucket with another class, that are in different classes and may
    be SIMILAR or more: a prefix join, without loss.

    A shingle that only one class holds can't be shared; `alone` is a member's share of weight in such. Its other
    shingles are ordered, the rarest first; `past` is the share that comes before one, `alone` included. If a pair's
    first shared shingle is d, neither shares what comes before d, so largest(past, past) bounds its similarity. A pair
    of SIMILAR or more therefore meets at a shingle where that bound holds, within 1 - SIMILAR of either's weight.
    Pages of one template with texts of their own have spent that share before the template begins. Outlines bound
    what two members don't share in another way: with n and m shingles that differ in d bits, the first has at least
    (n - m + d) / 2 that the other lacks, each of weight 1 or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                own = arrays_of(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(own["key"].view(np.int64)), pa.array(own["uid"][own["row"]])], ["key", "uid"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, root, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x, weight = multiset(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), uid)), pa.array(np.full(len(x), root)), pa.array(x.view(np.int64)), pa.array(weight / weight.sum())], ["uid", "root", "shingle", "share"])

    bits = [f"bits{i}" for i in range(OUTLINE)]
    lines = ["uid", "shingles", "weight", *bits]

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [outline(own) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[i] for s in said], pa.int64()) for i in range(len(lines) - 1))], lines)

    classes_of = (F.min("root").alias("low"), F.max("root").alias("high"))
    member_keys = parts.select("payload").mapInArrow(keys, "key bigint, uid bigint")
    labelled = written(member_keys.join(roots.hint("merge"), "uid", "left").select("key", "uid", F.coalesce("root", "uid").alias("root")), "near-labelled")
    mixed = labelled.groupBy("key").agg(*classes_of).where("low != high").select("key")
    live = labelled.join(mixed.hint("merge"), "key").select("uid", "root").distinct()
    of_live = written(table.join(live.hint("merge"), "uid").select("uid", "root", "own"), "near-live")
    shares = written(of_live.mapInArrow(held, "uid bigint, root bigint, shingle bigint, share double"), "near-shares")
    met = shares.groupBy("shingle").agg(*classes_of, F.count(F.lit(1)).alias("members")).where("low != high").select("shingle", "members")
    common = shares.join(met.hint("merge"), "shingle")
    own = Window.partitionBy("uid").orderBy("members", "shingle")  # the shingles of one document
    alone = 1 - F.sum("share").over(Window.partitionBy("uid"))
    past = common.withColumn("past", F.greatest(F.lit(0.0), alone + F.sum("share").over(own) - F.col("share"))).where(F.col("past") <= 1 - SIMILAR + 1e-6)
    drawn = of_live.select("uid", "own").mapInArrow(outlines, ", ".join(f"{c} bigint" for c in lines))
    past = written(past.join(drawn.hint("merge"), "uid").select("shingle", "root", "past", *lines), "near-prefixes")
    x, y = (past.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("root", "past", *lines))) for side in "ab")
    differ = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in bits[1:]), F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))))
    lacks = lambda u, v: F.greatest(F.col(f"past_{u}"), (F.col(f"shingles_{u}") - F.col(f"shingles_{v}") + differ) / 2 / F.col(f"weight_{u}"))
    able = (F.col("uid_a") < F.col("uid_b")) & (F.col("root_a") != F.col("root_b")) & (largest(F.col("past_a"), F.col("past_b")) >= SIMILAR - 1e-6)
    able &= largest(lacks("a", "b"), lacks("b", "a")) >= SIMILAR - 1e-6
    return x.hint("merge").join(y, (x["shingle"] == y["shingle"]) & able).select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b")).distinct()


def packed_uids(by_part: DataFrame) -> DataFrame:
    """part, answers: the uids as one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [[np.array(u.as_py(), np.int64).tobytes()] for u in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.list_(pa.binary()))], ["part", "answers"])

    return by_part.mapInArrow(run, "part bigint, answers array<binary>")


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that link the same rows, fewer: each task makes stars of the components of its own edges."""
    edges = written(edges, "near-links")
    n = max(1, -(-edges.count() // EDGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if y in up else y
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        tips = [x for x in up if root(x) != x]
        for i in range(0, len(tips), 50_000):
            some = tips[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["a", "b"])

    return edges.repartition(n).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """uid, root of every end of an edge: the least uid that it is linked to over any number of links. Labels spread
    to neighbours and then jump to their label's label, so a chain of n takes about log n rounds."""
    edges = written(contracted(edges), "near-stars")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "near-labels")
    while True:
        near = both.join(labels, both.b == labels.uid).groupBy("a").agg(F.min("root").alias("other"))
        spread = labels.join(near, labels.uid == near.a).select("uid", F.col("root").alias("was"), F.least("root", "other").alias("root"))
        spread = written(spread, "near-spread")
        jump = spread.alias("s").join(spread.select(F.col("uid").alias("up"), F.col("root").alias("upper")), F.col("s.root") == F.col("up")).select("uid", "was", F.least("root", "upper").alias("root"))
        moved = written(jump, "near-labels")
        if moved.where("root != was").isEmpty():
            return moved.select("uid", "root")
        labels = moved.select("uid", "root")


def row_heads(parts: DataFrame) -> DataFrame:
    """uid, row, doc_id, head (the uid of the part's first row of the same words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                own = arrays_of(payload.as_py())
                head = own["uid"][np.where(own["head"] < 0, np.arange(len(own["head"])), own["head"])]
                yield pa.RecordBatch.from_arrays([pa.array(own["uid"]), pa.array(own["row"]), pa.array(own["doc_id"], mask=own["known"] == 0), pa.array(head)], ["uid", "row", "doc_id", "head"])

    return parts.select("payload").mapInArrow(run, "uid bigint, row bigint, doc_id bigint, head bigint")


def classes(docs: DataFrame, text: str = "text", row: str | None = None, gain: float = GAIN) -> DataFrame:
    """row (of the column of that name), doc_id, root (the class), class_id (its least doc_id), stays (one row of each
    class)."""
    with scratch():
        parts = signed(docs, text, row)
        roots = components(links(parts, gain))
        named = row_heads(parts).join(roots.withColumnRenamed("uid", "head"), "head", "left").select("uid", "row", "doc_id", F.coalesce("root", "head").alias("root"))
        named = written(named, "near-named", lasting=True)
    # stored, so that the join below reads two plain exchanges and a class that holds a third of all rows can be split
    first = written(named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")), "near-first")
    return named.join(first, "root").select("row", "doc_id", "root", F.col("first.doc_id").alias("class_id"), (F.col("uid") == F.col("first.uid")).alias("stays"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one of least doc_id."""
    rows = keyed(docs, "near-rows")
    stays = classes(rows, row=ROW).where("stays").select(F.col("row").alias(ROW))
    return rows.join(stays, ROW).select(*docs.columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id")
