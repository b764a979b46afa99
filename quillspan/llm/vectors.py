"""Vector search over blocks: an exact pivot-distance index and an approximate stable-projection index.

Both indexes deal the rows to cells (the nearest pivot; a cell of a kd-tree over projections) and cut each cell into
blocks of BLOCK rows. A directory of the cells, of bounded size, tells each block of the stated queries which cells it
must visit; a cell's blocks are dealt to slices, and a query block meets a block by an equi-join on cell and slice, so
a cell that holds a third of all rows is many keys. Each visit returns a query's best few, which a window ranks by
(score, smaller vec_id). No block, query set or group is held whole anywhere.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
with a null vec_id or of another length than `dimension` (if that isn't given: than most; of equally many, the longer);
ties go to the smaller vec_id, then to the row read first; a repeated row is a row of its own (only the query's own row
is left out); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

PIVOTS = 64
#: Rows from whose scores a query's first threshold comes.
SEED_ROWS = 2048
BLOCK = 2048
QUERY_BLOCK = 256
#: Rows of a cell in one slice, about.
SLICE = 4 * BLOCK

PROJECTED = 24
#: Cells of the kd-tree at most, and projected rows that it is built from.
CELLS = 1024
TREE_ROWS = 16_384
LEAF = 64
#: A row as near as a query's k-th would have been projected within the radius that is searched with this probability.
CONFIDENCE = 0.83
#: Rows of a cell, about, while there are no more than CELLS.
CELL_ROWS = 2048
#: The share of all rows, in a query's nearest cells, that the rounds of the search have reached.
REACHES = (0.05, 0.2, 1.0)

_LEAST = np.iinfo(np.int64).min


def vector_rows(table: DataFrame, scale: float | None = None, zero: bool = True, dimension: int | None = None) -> DataFrame:
    """vec_id, uid, vec (binary float64) of the rows that take part, stored. scale: components are floor(scale * x), and
    rows in which one leaves the doubles take no part; zero: whether zero vectors take part."""
    uid = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("uid"), F.col("embedding").cast("array<double>").alias("e"))
    sound = uid.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) * (scale or 1.0) < float("inf"))))
    if dimension is None:
        common = sound.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
        dimension = common[0].n if common else 0
    sound = sound.where(F.size("e") == dimension)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if scale is not None:
                values = np.floor(values * scale)
            keep = np.flatnonzero((values != 0).any(axis=1)) if not zero else np.arange(len(values))
            picked = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array([v.tobytes() for v in values[keep]], pa.binary())], ["vec_id", "uid", "vec"])

    return written(sound.mapInArrow(pack, "vec_id bigint, uid bigint, vec binary"), "vectors")


def matrix(column) -> np.ndarray:
    """Rows of float64 from a binary column."""
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of one query, ties to the smaller id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, query_uid, rank, vec_id, uid, score: the k best of each query row, from the best of its visits."""
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# ---------------------------------------------------------------- cells, blocks and visits

_HELD = "block bigint, cell bigint, rows bigint, ids binary, uids binary, vecs binary, keys binary"
_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(", ")])


def blocks_of(celled: DataFrame, order: list[str], keys: Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Index rows of _HELD, stored: BLOCK rows of one cell at most, with what keys(vectors, rows) makes of them: their
    order, and an array. celled: vec_id, uid, vec, cell and what the order needs."""
    n = max(1, -(-celled.count() // (8 * BLOCK)))
    schema = arrow_schema(_HELD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
            for a, b in zip(edges, edges[1:], strict=False):
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(b, i + BLOCK) - i)
                    vecs = matrix(part.column("vec"))
                    at, held = keys(vecs, part)
                    ids, uids = part.column("vec_id").to_numpy()[at], part.column("uid").to_numpy()[at]
                    out = {"block": block, "cell": int(cell[i]), "rows": len(at), "ids": ids.tobytes(), "uids": uids.tobytes(), "vecs": vecs[at].tobytes(), "keys": held.tobytes()}
                    block += 1
                    yield pa.RecordBatch.from_pylist([out], schema)

    return written(celled.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(cut, _HELD), "vector-blocks")


def sliced(index: DataFrame) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """(the index with slice, slices of each cell, rows of each cell)."""
    per = index.groupBy("cell").agg(F.ceil(F.sum("rows") / SLICE).alias("slices"), F.sum("rows").alias("n"))
    cells = per.collect()  # PIVOTS or CELLS rows at most
    slice_of = F.pmod(F.xxhash64("block"), F.col("slices"))
    return index.join(F.broadcast(per.select("cell", "slices")), "cell").withColumn("slice", slice_of).drop("slices"), {c.cell: c.slices for c in cells}, {c.cell: c.n for c in cells}


def visits(queries: DataFrame, slices: dict[int, int], wants: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """cell, slice and the queries of a block that must visit it: q_id, q_uid, q_vec, q_extra. wants(rows, vectors) gives
    a matrix queries x cells (by rising cell), and an array whose rows go along."""
    ddl = "cell bigint, slice bigint, q_id binary, q_uid binary, q_vec binary, q_extra binary"
    schema, cells = arrow_schema(ddl), sorted(slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(i, QUERY_BLOCK)
                vecs = matrix(part.column("vec"))
                ids, uids = part.column("vec_id").to_numpy(), part.column("uid").to_numpy()
                wanted, extra = wants(part, vecs)
                for c, cell in enumerate(cells):
                    who = np.flatnonzero(wanted[:, c])
                    if len(who):
                        row = {"cell": cell, "q_id": ids[who].tobytes(), "q_uid": uids[who].tobytes(), "q_vec": vecs[who].tobytes(), "q_extra": extra[who].tobytes()}
                        for s in range(slices[cell]):
                            yield pa.RecordBatch.from_pylist([row | {"slice": s}], schema)

    return queries.mapInArrow(run, ddl)


class Visit:
    """A query block and a block that meet."""

    def __init__(self, batch: pa.RecordBatch, r: int):
        raw = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)
        self.cell = batch.column("cell")[r].as_py()
        self.ids, self.uids, self.q_id, self.q_uid = (raw(c, np.int64) for c in ("ids", "uids", "q_id", "q_uid"))
        self.vecs, self.q = raw("vecs", np.float64).reshape(len(self.ids), -1), raw("q_vec", np.float64).reshape(len(self.q_id), -1)
        self.keys = raw("keys", np.float64).reshape(len(self.ids), -1)
        self.extra = raw("q_extra", np.float64).reshape(len(self.q_id), -1)


class Best:
    """The k best so far of each query of a block, over the blocks that it has met, and the scores to reach."""

    def __init__(self, v: Visit, k: int, kind: type):
        n = len(v.q_id)
        self.k, self.kind, self.q_id, self.q_uid = k, kind, v.q_id.copy(), v.q_uid.copy()
        self.floor = v.extra[:, 0].copy()
        self.ids, self.uids, self.scores = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, kind)] * n

    def add(self, i: int, ids: np.ndarray, uids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, uids, scores = np.r_[self.ids[i], ids], np.r_[self.uids[i], uids], np.r_[self.scores[i], scores]
        order = np.lexsort((uids, ids, -scores))[: self.k]
        self.ids[i], self.uids[i], self.scores[i] = ids[order], uids[order], scores[order]
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], float(self.scores[i][-1]))

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.ids]
        cols = [np.repeat(self.q_id, n), np.repeat(self.q_uid, n), *(np.concatenate([np.zeros(0, np.int64), *c]) for c in (self.ids, self.uids))]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(np.concatenate([np.zeros(0, self.kind), *self.scores]))], ["query_id", "query_uid", "vec_id", "uid", "score"])


def met(visiting: DataFrame, index: DataFrame, search: Callable[[Visit, Best], None], k: int, kind: type) -> DataFrame:
    """query_id, query_uid, vec_id, uid, score: what search finds where query blocks and blocks meet. The blocks of a
    slice come one after another to a query block, which carries its best from each to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for r in range(batch.num_rows):
                v = Visit(batch, r)
                if held is None or not np.array_equal(held.q_uid, v.q_uid):
                    if held is not None:
                        yield held.rows()
                    held = Best(v, k, kind)
                search(v, held)
        if held is not None:
            yield held.rows()

    pairs = visiting.hint("merge").join(index.select("cell", "slice", "ids", "uids", "vecs", "keys"), ["cell", "slice"])
    return pairs.mapInArrow(run, f"query_id bigint, query_uid bigint, vec_id bigint, uid bigint, score {'bigint' if kind is np.int64 else 'double'}")


# ---------------------------------------------------------------- exact: pivots and annuli


def nearest(vecs: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (vecs**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * vecs @ pivots.T
    at = d2.argmin(axis=1)
    return at, np.sqrt(((vecs - pivots[at]) ** 2).sum(axis=1))


def pivot_index(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of the rows by nearest pivot, each an annulus sorted by distance; keys: the distances."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dist = nearest(matrix(batch.column("vec")), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(dist)], ["vec_id", "uid", "vec", "cell", "dist"])

    celled = rows.mapInArrow(near, "vec_id bigint, uid bigint, vec binary, cell bigint, dist double")
    # the uid parts the copies of one vector
    return blocks_of(celled, ["cell", "dist", "uid"], lambda vecs, part: (np.arange(len(vecs)), part.column("dist").to_numpy()))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly, as 64-bit integers. In doubles while they stay below 2**53, in 64-bit
    integers below 2**63, else in whole numbers of any size; a product beyond the range of a long is told as its end."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, _LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def within_reach(q2: np.ndarray, longest2: float, floor: np.ndarray) -> np.ndarray:
    """How far from a query a row of the score `floor` can be: |q - x|^2 = |q|^2 + |x|^2 - 2 q x. With room for rounding."""
    return np.sqrt(np.maximum((q2 + longest2) * (1 + 1e-9) - 2 * floor * (1 - 1e-9 * np.sign(floor)) + 2.0, 0)) * (1 + 1e-9) + 1e-6


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (long) of the k largest integer inner products. rows and queries come from
    vector_rows, with whole components."""
    some = rows.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(SEED_ROWS).collect()  # bounded
    if not some:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    seeds, seed_uids = matrix([r.vec for r in some]), np.array([r.uid for r in some])
    pivots = seeds[:PIVOTS]
    index, slices, _ = sliced(pivot_index(rows, pivots))
    cells = sorted(slices)
    place = {c: i for i, c in enumerate(cells)}
    sent = rows.sparkSession.sparkContext.broadcast((pivots[cells], seeds, seed_uids))  # SEED_ROWS vectors

    def wants(part: pa.RecordBatch, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All cells: which annuli are in reach is told by their distances. With each query its threshold and distances."""
        pivots, seeds, seed_uids = sent.value
        scores = products(vecs, seeds)
        scores[part.column("uid").to_numpy()[:, None] == seed_uids[None]] = _LEAST
        least = np.partition(scores, -k, axis=1)[:, -k].astype(float) if scores.shape[1] > k else np.full(len(vecs), -np.inf)
        far = np.stack([np.sqrt(((vecs - p) ** 2).sum(axis=1)) for p in pivots], 1)
        return np.ones(far.shape, bool), np.hstack([least[:, None], far])

    def search(v: Visit, held: Best) -> None:
        # the triangle inequality: of the annulus only rows whose distance from the pivot is near the query's are in reach
        dists, floor, q_dist = v.keys[:, 0], held.floor.copy(), v.extra[:, 1 + place[v.cell]]
        reach = within_reach((v.q**2).sum(axis=1), float((v.vecs**2).sum(axis=1).max()), np.maximum(floor, -1e300))
        reach[np.isneginf(floor)] = np.inf
        a, b = np.searchsorted(dists, q_dist - reach, "left"), np.searchsorted(dists, q_dist + reach, "right")
        use = np.flatnonzero(b > a)
        if not len(use):
            return
        lo, hi = int(a[use].min()), int(b[use].max())
        for i, s in zip(use.tolist(), products(v.q[use], v.vecs[lo:hi]), strict=True):
            open_ = np.arange(a[i], b[i])[v.uids[a[i] : b[i]] != v.q_uid[i]]
            if np.isfinite(floor[i]):
                open_ = open_[s[open_ - lo] >= floor[i] * (1 - 1e-9 * np.sign(floor[i])) - 1]
            best = open_[top(s[open_ - lo], v.ids[open_], k)]
            held.add(i, v.ids[best], v.uids[best], s[best - lo])

    found = met(visits(queries, slices, wants), index, search, k, np.int64)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=1024.0)
    return exact_top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


# ---------------------------------------------------------------- approximate: stable projections and kd-trees


def chi_square_quantile(p: float, m: int) -> float:
    """x at which a chi-square variable of m (even) degrees stays below x with probability p."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < p else (low, x)
    return (low + high) / 2


def kd_order(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[int]]:
    """Order of the points leaf by leaf, and the leaves' edges: each node is halved at the median of its widest axis."""
    done, edges, todo = [], [0], [np.arange(len(points))]
    while todo:
        node = todo.pop()
        if len(node) <= leaf:
            done.append(node)
            edges.append(edges[-1] + len(node))
            continue
        own = points[node]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(node) // 2
        parted = node[np.argpartition(own[:, axis], half)]
        todo += [parted[half:], parted[:half]]
    return np.concatenate(done), edges


def kd_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A balanced tree of about so many leaves: the (axis, value) of each node, the children of node i at 2i + 1 and
    2i + 2. Rows up to the value go left."""
    depth = max(0, int(np.log2(max(leaves, 1))))
    out: list[tuple[int, float]] = []
    level = [np.arange(len(points))]
    for _ in range(depth):
        below = []
        for node in level:
            own = points[node]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            value = float(np.median(own[:, axis])) if len(own) else 0.0
            out.append((axis, value))
            right = own[:, axis] > value if len(own) else np.zeros(0, bool)
            below += [node[~right], node[right]]
        level = below
    return out


def kd_cell(tree: list[tuple[int, float]], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    axis, value = np.array([a for a, _ in tree], np.int64), np.array([v for _, v in tree])
    at = np.zeros(len(points), np.int64)
    while len(at) and at.min() < len(tree):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] > value[at])
    return at - len(tree)


def projection(dim: int, m: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(9).standard_normal((dim + 1, m))


def lifted(vecs: np.ndarray, longest: float) -> np.ndarray:
    """Vectors on a sphere of one more dimension, where the largest inner product is the smallest distance."""
    return np.hstack([vecs, np.sqrt(np.maximum(longest**2 - (vecs**2).sum(axis=1), 0))[:, None]])


def projected_queries(q: np.ndarray, longest: float) -> np.ndarray:
    unit = q / np.sqrt((q**2).sum(axis=1, keepdims=True)) * longest
    return np.hstack([unit, np.zeros((len(q), 1))]) @ projection(q.shape[1])


def radius2(q: np.ndarray, kth: np.ndarray, longest: float, limit: float) -> np.ndarray:
    """The squared projected distance at which the chi-square test stops a query: a row as near as its k-th would, with
    the given confidence, have been projected nearer."""
    dist2 = 2 * longest**2 - 2 * longest * kth / np.sqrt((q**2).sum(axis=1))
    return np.where(np.isneginf(kth), np.inf, limit * np.maximum(dist2, 1e-12) * (1 + 1e-9))


def box_distance2(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes, points x boxes."""
    out = np.zeros((len(p), len(low)))
    for m in range(p.shape[1]):
        out += np.maximum(np.maximum(low[None, :, m] - p[:, None, m], p[:, None, m] - high[None, :, m]), 0) ** 2
    return out


def projected_neighbours(q: np.ndarray, kth: np.ndarray, points: np.ndarray, longest: float, limit: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of a block that are projected within its radius, nearest first, and their squared
    projected distances. The block's rows are in the order of its kd-tree's leaves; only leaves whose boxes come within
    some query's radius are looked into."""
    p, r2 = projected_queries(q, longest), radius2(q, kth, longest, limit)
    edges = np.r_[np.arange(0, len(points), LEAF), len(points)]
    low, high = np.minimum.reduceat(points, edges[:-1]), np.maximum.reduceat(points, edges[:-1])
    wanted = (box_distance2(p, low, high) <= r2[:, None]).any(axis=0)
    some = np.flatnonzero(np.repeat(wanted, np.diff(edges)))
    own = points[some]
    d2 = (p**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None] - 2 * p @ own.T
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(d2[i] <= r2[i])
        near = near[np.argsort(d2[i, near], kind="stable")]
        out.append((some[near], d2[i, near]))
    return out


def verified(q: np.ndarray, own: int, kth: float, near: tuple[np.ndarray, np.ndarray], vecs: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int, longest: float, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of the k best by exact inner products that reach the k-th so far, and the rows verified. Rows
    come by rising projected distance, ever more at a time; the search stops when the next is beyond the radius that the
    k-th best so far leaves."""
    rows, away = near
    keep = uids[rows] != own
    rows, away = rows[keep], away[keep]
    best, scores, seen, step = np.zeros(0, np.int64), np.zeros(0), 0, 4 * k
    while seen < len(rows) and away[seen] <= radius2(q[None], np.array([kth]), longest, limit)[0]:
        some = rows[seen : seen + step]
        best, scores = np.r_[best, some], np.r_[scores, (vecs[some] * q).sum(axis=1)]
        keep = top(scores, ids[best], k)
        best, scores = best[keep], scores[keep]
        if len(best) == k:
            kth = max(kth, float(scores[-1]))
        seen, step = seen + len(some), step * 2
    keep = scores >= kth
    return best[keep], scores[keep], seen


def projection_index(rows: DataFrame, longest: float, cells: int = CELLS) -> DataFrame:
    """Blocks of the rows by cell of a kd-tree over their projections; within a block by the leaves of another. The tree
    is built from TREE_ROWS rows and only deals the rows; keys: the projections."""
    n = rows.count()
    some = rows.orderBy(F.xxhash64("uid"), "uid").limit(TREE_ROWS).collect()  # bounded
    vecs = matrix([r.vec for r in some])
    tree = kd_tree(lifted(vecs, longest) @ projection(vecs.shape[1]), min(cells, max(1, n // CELL_ROWS)))
    sent = rows.sparkSession.sparkContext.broadcast(tree)  # CELLS nodes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = matrix(batch.column("vec"))
            cell = kd_cell(sent.value, lifted(vecs, longest) @ projection(vecs.shape[1])) if len(vecs) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["vec_id", "uid", "vec", "cell"])

    def keys(vecs: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        points = lifted(vecs, longest) @ projection(vecs.shape[1])
        order = kd_order(points)[0]
        return order, points[order]

    return blocks_of(rows.mapInArrow(deal, "vec_id bigint, uid bigint, vec binary, cell bigint"), ["cell", "uid"], keys)


def boxes(index: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The least box around the projections of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                points = np.frombuffer(raw).reshape(n, -1)
                axes = pa.array(np.arange(points.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(axes), cell)), axes, pa.array(points.min(axis=0)), pa.array(points.max(axis=0))], ["cell", "axis", "low", "high"])

    sides = index.select("cell", "rows", "keys").mapInArrow(run, "cell bigint, axis bigint, low double, high double")
    out: dict[int, list] = {}
    for r in sides.groupBy("cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell", "axis").toLocalIterator():  # CELLS * PROJECTED
        out.setdefault(r.cell, []).append((r.low, r.high))
    return {c: (np.array([x for x, _ in s]), np.array([x for _, x in s])) for c, s in out.items()}


def approximate_top_k(rows: DataFrame, queries: DataFrame, k: int, confidence: float = CONFIDENCE, reaches: tuple[float, ...] = REACHES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found by largest inner product. A round visits the cells nearest to
    a query that hold the next share of all rows; its k-th score is carried to the next, whose visits it narrows."""
    spark = rows.sparkSession
    longest = rows.mapInArrow(lengths, "length double").agg(F.max("length")).first()[0]
    if not longest:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index, slices, held = sliced(projection_index(rows, longest))
    cells = sorted(slices)
    sides = boxes(index)
    sent = spark.sparkContext.broadcast((np.stack([sides[c][0] for c in cells]), np.stack([sides[c][1] for c in cells]), np.array([held[c] for c in cells])))  # CELLS boxes
    limit = chi_square_quantile(confidence, PROJECTED)
    found, before = None, 0.0

    def wants_of(least: float, most: float):
        def wants(part: pa.RecordBatch, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low, high, size = sent.value
            kth = part.column("kth").to_numpy(zero_copy_only=False)
            away = box_distance2(projected_queries(vecs, longest), low, high)
            order = np.argsort(away, axis=1, kind="stable")
            reached = np.cumsum(size[order], axis=1) - size[order]  # rows in nearer cells
            turn = np.empty(order.shape)
            np.put_along_axis(turn, order, reached / size.sum(), axis=1)
            return (turn >= least) & (turn < most) & (away <= radius2(vecs, kth, longest, limit)[:, None]), kth[:, None]

        return wants

    def search(v: Visit, held: Best) -> None:
        near = projected_neighbours(v.q, held.floor, v.keys, longest, limit)
        for i in range(len(v.q)):
            best, scores, _ = verified(v.q[i], v.q_uid[i], held.floor[i], near[i], v.vecs, v.ids, v.uids, k, longest, limit)
            held.add(i, v.ids[best], v.uids[best], scores)

    for reach in reaches:
        asked = queries.withColumn("kth", F.lit(float("-inf")))
        if found is not None:
            kth = found.where(F.col("rank") == k).select(F.col("query_uid").alias("uid"), F.col("score").alias("kth"))
            asked = queries.join(kth, "uid", "left").select("vec_id", "uid", "vec", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
        hits = met(visits(asked, slices, wants_of(before, reach)), index, search, k, np.float64)
        found = hits if found is None else hits.unionByName(found.drop("rank"))
        found = written(ranked(found, k), "vector-found")
        before = reach
    return found.select("query_id", "rank", "vec_id", "score")


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch (vec_id, uid, vec) the length of its longest vector."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((matrix(batch.column(2)) ** 2).sum(axis=1)).max())])], ["length"])


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), zero=False)
    return approximate_top_k(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
