"""Best-fit packing by a grouping genetic algorithm.

Documents become token ids; a document longer than a sequence is cut into full pieces, its first piece being
the shorter rest. Full pieces are sequences of their own. All other pieces are dealt by hash to shards of about
SHARD pieces; every shard is evolved on ISLANDS islands, in tasks of their own. A solution is a set of bins;
crossover injects whole well-filled bins of the other parent, drops the bins that hold a repeated piece, swaps smaller
pieces of the kept bins for displaced ones that fill them better, and best-fits the rest. Plain best fit by falling size
is one of the first solutions, and evolution goes on until the bound that no packing can pass, or until PLATEAU
generations in a row bring nothing. Between rounds each island's elite migrates to the next island. The shards' poorly
filled bins, and LOOSE others for small pieces, are opened and evolved once more together, in shards that end level by
level, until one shard holds them or nothing is gained.

Defined results: null text is empty and becomes the lone end token; repeated rows are packed apart; equal sizes go by
uid; extra columns are ignored; an empty table gives an empty result; very long texts are cut, never dropped.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, frugal, scratch, with_fields, written

LENGTH = 1024
END = 2
SHARD = 4096
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 24
PLATEAU = 5
POPULATION = 6
#: Bins of a shard below this fill are opened for the common rounds at the end, and this share of the others.
POOR = 0.97
LOOSE = 0.02
#: Common rounds at most; each deals the opened bins to fewer shards.
COMMON = 4

#: How a byte-level vocabulary of this family parts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else
    the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES = _byte_letters()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. The vocabulary's ranks drive a byte-pair encoder that
    gives the same ids as the tokenizer file; a text that spells out a special token, or that this encoder can't part
    (a very long run of blanks outgrows its stack), goes to the tokenizer itself."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [t["content"] for t in content["added_tokens"]]
        ranks = {bytes(map(_BYTES.__getitem__, token)): rank for token, rank in content["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """Few texts need it, and it takes as much memory as the ranks."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass  # the tokenizer takes any text
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, uid, piece, start, length, ids_crc32 and, if asked for, ids (binary) of every piece."""
    cols = docs.select("doc_id", F.col(text).alias("__text"))
    schema = with_fields(docs.select("doc_id").schema, "uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids)
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1)
            for first in range(0, batch.num_rows, 500):
                at, piece, start, size, crc, raw = [], [], [], [], [], []
                for row in range(first, min(first + 500, batch.num_rows)):
                    own = encoder.encode(texts[row].as_py() or "") + closing
                    n = len(own) // 4
                    cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        at.append(row)
                        piece.append(k)
                        start.append(a)
                        size.append(b - a)
                        part = own[4 * a : 4 * b]
                        crc.append(zlib.crc32(part))
                        if ids:
                            raw.append(part)
                out = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(range(uid, uid + len(at)), pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                uid += len(at)
                yield pa.RecordBatch.from_arrays(out + [pa.array(raw, pa.binary())] * ids, schema.names)

    return cols.mapInArrow(frugal(run), schema)


# ---------------------------------------------------------------- the genetic algorithm


def best_fit(order: np.ndarray, sizes: np.ndarray, bins: np.ndarray, room: list[int], length: int) -> None:
    """Puts the pieces of order into the fullest bins that have room, or new ones; changes bins and room."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room[r].append(b)
            open_rooms |= 1 << r
    for i in order.tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(room), length
            room.append(length)
        bins[i] = b
        r -= size
        room[b] = r
        if r > 0:
            by_room[r].append(b)
            open_rooms |= 1 << r


def largest_first(sizes: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
    """Pieces by falling size; with rng, slightly out of order."""
    return np.argsort(-(sizes + (rng.normal(0, 12, len(sizes)) if rng is not None else 0)), kind="stable")


def from_scratch(sizes: np.ndarray, length: int, rng: np.random.Generator | None = None) -> np.ndarray:
    bins = np.full(len(sizes), -1, np.int64)
    best_fit(largest_first(sizes, rng), sizes, bins, [], length)
    return bins


def swapped(child: np.ndarray, displaced: np.ndarray, sizes: np.ndarray, room: list[int]) -> np.ndarray:
    """Displaced pieces take the places of smaller ones in bins that they fill better; changes child and room, and
    returns what is displaced then."""
    free = sorted((int(sizes[i]), i) for i in displaced.tolist())
    spare = np.array(room)
    held = np.flatnonzero(child >= 0)
    held = held[spare[child[held]] > 0]
    for i in held[np.argsort(-spare[child[held]], kind="stable")].tolist():
        r = room[child[i]]
        if r <= 0 or not free:
            continue
        size = int(sizes[i])
        at = bisect.bisect_right(free, (size + r, len(sizes))) - 1
        if at >= 0 and free[at][0] > size:
            larger, j = free.pop(at)
            child[j], child[i] = child[i], -1
            room[child[j]] = r - (larger - size)
            bisect.insort(free, (size, i))
    return np.array([i for _, i in free], np.int64)


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with well-filled bins of b."""
    fill = np.bincount(b, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill[fill > 0], rng.uniform(0.3, 0.9)))
    chosen = np.zeros(len(fill), bool)
    chosen[good[rng.random(len(good)) < rng.uniform(0.1, 1.0)]] = True
    injected = chosen[b]
    # bins of a that hold an injected piece go; so do some of its poorest, which is the mutation
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    own = np.bincount(a, weights=sizes)
    broken[np.argsort(own, kind="stable")[: int(rng.integers(1, 2 + len(own) // 20))]] = True
    kept = ~injected & ~broken[a]
    key = np.where(injected, b, np.where(kept, a + len(fill), -1))
    used, renamed = np.unique(key, return_inverse=True)
    shift = int(used[0] == -1)
    child = renamed - shift
    room = (length - np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=len(used) - shift)).astype(int).tolist()
    displaced = swapped(child, np.flatnonzero(child < 0), sizes, room)
    best_fit(displaced[largest_first(sizes[displaced])], sizes, child, room, length)
    return child


def worth(bins: np.ndarray, sizes: np.ndarray, length: int) -> float:
    """Fewer bins first; among equals, the more unevenly filled leave better gaps. The emptier the poorest bins, the
    nearer is a solution with one less."""
    fill = np.bincount(bins, weights=sizes) / length
    return -len(fill) + float((fill**4).sum()) / max(len(fill), 1)


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], length: int, generations: int, rng: np.random.Generator) -> np.ndarray:
    """The best solution after some generations; it ends early at the bound that no packing can pass."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    bound = -(-int(sizes.sum()) // length)
    pool = [*seeds]
    if not pool:
        pool.append(from_scratch(sizes, length))
    while len(pool) < POPULATION and max(pool[0].max(), 0) + 1 > bound:
        pool.append(from_scratch(sizes, length, rng))
    scored = sorted(((worth(p, sizes, length), k, p) for k, p in enumerate(pool)), key=lambda x: (-x[0], x[1]))
    count, still = len(scored), 0
    for _ in range(generations):
        best = scored[0]
        if int(best[2].max()) + 1 <= bound or still >= PLATEAU:
            break
        for _ in range(POPULATION // 2):
            i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
            child = crossover(scored[i][2], scored[j][2], sizes, length, rng)
            scored.append((worth(child, sizes, length), count, child))
            count += 1
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION]
        still = 0 if scored[0][0] > best[0] + 1e-9 else still + 1
    return scored[0][2]


def offsets_in(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each piece's place in its bin, gapless from 0."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    begins = ends - sizes[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
    out = np.empty(len(bins), np.int64)
    out[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
    return out


_EVOLVED = "shard bigint, island int, uid bigint, length bigint, bin bigint, fill bigint"


def islands(items: DataFrame, length: int, rounds: int = ROUNDS) -> DataFrame:
    """items (shard, uid, length) evolved; shard, uid, length, bin and the bin's fill, of each shard's best island."""

    def epoch(number: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[pdf["origin"] == 0].sort_values("uid")
            sizes = own["length"].to_numpy(np.int64)
            rng = np.random.default_rng([int(key[0]), int(key[1]), number])
            seeds = []
            if number:
                for origin in (0, 1):
                    seed = pdf[pdf["origin"] == origin].sort_values("uid")["bin"].to_numpy(np.int64)
                    if len(seed):
                        seeds.append(seed)
            bins = evolve(sizes, seeds, length, GENERATIONS, rng)
            fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
            return pd.DataFrame({"shard": key[0], "island": key[1], "uid": own["uid"], "length": sizes, "bin": bins, "fill": fill})

        return run

    state = items.select("shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "uid", "length", F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("origin"))
    for number in range(rounds):
        if number:
            moves = F.explode(F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("origin")), F.struct(((F.col("island") + 1) % ISLANDS).alias("to"), F.lit(1).alias("origin"))))
            state = state.select("shard", "uid", "length", "bin", moves.alias("m"), "island").select("shard", F.col("m.to").alias("island"), "uid", "length", "bin", "m.origin")
        state = state.groupBy("shard", "island").applyInPandas(epoch(number), _EVOLVED)
    scored = written(state, "pack-islands")
    best = scored.groupBy("shard", "island").agg(F.max("bin").alias("bins")).groupBy("shard").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    return scored.join(best, ["shard", "island"]).select("shard", "uid", "length", "bin", "fill")


def pack(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """uid, sequence_id, offset for each row of pieces (uid, length); pieces must be a stored table."""
    short = pieces.where(F.col("length") < length)
    n = short.count()
    alone = pieces.where(F.col("length") >= length).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = short.select(F.pmod(F.xxhash64("uid"), F.lit(-(-n // shard) or 1)).alias("shard"), "uid", "length")
    with scratch():
        current = written(islands(dealt, length), "pack-first", lasting=True)
    done = []
    many = n > shard  # a single shard has been evolved whole
    for turn in range(1, COMMON + 1) if many else ():
        open_ = (F.col("fill") < POOR * length) | (F.pmod(F.xxhash64("shard", "bin", F.lit(turn)), F.lit(1000)) < int(1000 * LOOSE))
        opened = current.where(open_)
        left = opened.count()
        shards = -(-left // shard) or 1
        again = opened.select((F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(shards)) + F.lit(turn << 24)).alias("shard"), "uid", "length")
        done.append(current.where(~open_).select("shard", "uid", "length", "bin"))
        with scratch():
            current = written(islands(again, length), f"pack-common{turn}", lasting=True)
        if shards == 1:
            break
    packed = current.select("shard", "uid", "length", "bin")
    for rows in done:
        packed = packed.unionByName(rows)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        return pd.DataFrame({"uid": pdf["uid"], "sequence_id": pdf["shard"] * (1 << 20) + pdf["bin"], "offset": offsets_in(pdf["bin"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64))})

    return packed.groupBy("shard").applyInPandas(place, "uid bigint, sequence_id bigint, offset bigint").unionByName(alone)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    pieces = written(tokenized_pieces(docs, path, length, end, ids=ids), "pack-pieces")
    return pieces.join(pack(pieces.select("uid", "length"), length), "uid").drop("uid")


def packed_sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The sequences themselves: sequence_id, tokens (binary, little-endian unsigned 32-bit)."""
    rows = pack_documents(docs, path, length, end, ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))  # at most `length` tokens
    return rows.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("tokens"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())
