"""Continuous ingestion: every micro-batch of documents goes through the ingest plan and is appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_stream(source: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "provenance_id", name: str = "ingest") -> StreamingQuery:
    """Runs over what is there and ends. Each batch writes a partition of its own, by the stream's name and the batch's
    number, so a batch that is tried again after a failure replaces what it had written, and none reads the target. Of
    the rows of a batch with one key the least stays; a document that comes again in a later batch is told apart by
    ingested()."""

    def append(batch: DataFrame, number: int) -> None:
        rows = plan(batch)
        least = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct("document_id", "chunk_index")).alias("row")).select("row.*")
        least.write.mode("overwrite").parquet(f"{target}/stream={name}/batch={number}")

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(stored: DataFrame, key: str = "provenance_id") -> DataFrame:
    """What a target holds, each key once: the row of the earliest batch."""
    rows = [c for c in stored.columns if c not in ("stream", "batch")]
    first = stored.groupBy(key).agg(F.min_by(F.struct(*rows), F.struct("batch", "stream", "document_id", "chunk_index")).alias("row"))
    return first.select("row.*")


def paced(spark: SparkSession, path: str, schema: StructType | str, files: int) -> DataFrame:
    """A stream of Parquet uploads of which a micro-batch takes at most so many files: what comes in faster waits in the
    folder, so a batch's memory is bounded whatever the backlog."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
