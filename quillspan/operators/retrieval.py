"""Vector retrieval: top-k by cosine with a threshold, for one question or many, and what is made of the hits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions.vectors import cosine_to

TOP_K = 15
THRESHOLD = 0.30
#: Questions and vectors in one row, and slices that the vectors are dealt to.
QUESTIONS = 256
VECTORS = 2048
SLICES = 16


def top_k(vectors: DataFrame, query: Sequence[float], k: int = TOP_K, threshold: float | None = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The vectors' other columns with similarity and rank, best first; ties to the smaller key."""
    scored = vectors.withColumn("similarity", cosine_to(F.col(vector), query)).drop(vector)
    if threshold is not None:
        scored = scored.where(F.col("similarity") >= threshold)
    best = scored.orderBy(F.desc("similarity"), key).limit(k)  # at most k rows from here on
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))


def top_k_by_group(vectors: DataFrame, query: Sequence[float], group: str, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    scored = vectors.withColumn("similarity", cosine_to(F.col(vector), query)).drop(vector)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("similarity"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def packed_vectors(rows: DataFrame, size: int) -> DataFrame:
    """number, ids, vecs (unit vectors, float64) of rows (id, vector), at most so many a row. Vectors that are null, zero,
    or hold null or non-finite components take no part; a row holds vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                some = batch.filter(pa.array(lengths == n))
                values = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(some.num_rows, int(n))
                norm = np.sqrt((values**2).sum(axis=1))
                sound = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                ids = some.column(0).to_numpy()[sound]
                unit = values[sound] / norm[sound, None]
                for i in range(0, len(sound), size):
                    columns = [[number], [int(n)], [ids[i : i + size].tobytes()], [unit[i : i + size].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["number", "n", "ids", "vecs"])
                    number += 1

    id_, vector = rows.columns
    sound = rows.select(F.col(id_).cast("long"), F.col(vector).cast("array<double>").alias("v")).where(F.col(id_).isNotNull() & (F.size("v") > 0))
    return sound.mapInArrow(run, "number bigint, n bigint, ids binary, vecs binary")


def top_k_batch(vectors: DataFrame, questions: DataFrame, k: int = TOP_K, threshold: float | None = THRESHOLD, key: str = "vec_id", vector: str = "embedding", slices: int = SLICES) -> DataFrame:
    """query_id, key, similarity, rank for each question (query_id, vector).

    Questions and vectors travel as rows of many, and meet by slice of the vectors: nothing is gathered on the driver.
    Each meeting answers with its best k for each question, and a window ranks those."""
    asked = packed_vectors(questions.select("query_id", vector), QUESTIONS).select("n", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    held = packed_vectors(vectors.select(key, vector), VECTORS).withColumn("slice", F.pmod(F.xxhash64("number"), F.lit(slices)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, q_ids = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("ids", "q_ids"))
                v, q = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(len(i), -1) for c, i in (("vecs", ids), ("q_vecs", q_ids)))
                s = q @ v.T
                if threshold is not None:
                    s = np.where(s >= threshold, s, -np.inf)
                if s.shape[1] > k:
                    s = np.where(s >= np.partition(s, -k, axis=1)[:, [-k]], s, -np.inf)
                i, j = np.nonzero(s > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(s[i, j])], ["query_id", key, "similarity"])

    found = asked.join(held, ["slice", "n"]).select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(run, f"query_id bigint, {key} bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_per_document(hits: DataFrame, document: str, by: list[str]) -> DataFrame:
    """The best hit of each document for each question, first rank wins ties, with the document's number of hits."""
    group = Window.partitionBy(*by, document)
    rank = F.row_number().over(group.orderBy(F.desc("similarity"), "rank"))
    return hits.withColumn("n_hits", F.count(F.lit(1)).over(group)).withColumn("place", rank).where("place = 1").drop("place")


def append_vectors(stored: DataFrame, new: DataFrame, key: str = "provenance_id", idempotent: bool = True) -> DataFrame:
    """Rows to append: all of new, or only those whose key isn't stored."""
    return new.join(stored.select(key), key, "left_anti") if idempotent else new


def without_documents(stored: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """What stays when documents are deleted; deleting none is no error."""
    return stored.join(gone.select(key), key, "left_anti")
