"""What a session measured, kept as facts that are only ever added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row for each stage of an upload or a question.
FACTS = "run string, kind string, stage string, ms double, tokens bigint, at timestamp"


def record(facts: DataFrame, target: str, session: str) -> None:
    """Adds the facts to the session's folder."""
    wanted = [f.strip().split(" ")[0] for f in FACTS.split(",")]
    facts.select(*wanted, F.lit(session).alias("session")).write.mode("append").partitionBy("session").parquet(target)


def recorded(spark: SparkSession, target: str, session: str | None = None) -> DataFrame:
    """The facts of one session or of all; a session's folder alone is read."""
    rows = spark.read.schema(FACTS + ", session string").parquet(target)
    return rows if session is None else rows.where(F.col("session") == session)
