"""Stage times and generation rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_TOTAL = 0.001
TOP = 10


def stage_shares(facts: DataFrame, run: str, stage: str, ms: str, order: str) -> DataFrame:
    """run, stage, ms, share (percent of the run) and bottleneck. facts: a row per run and stage; order: the stages'
    order in a run, whose last wins a tie."""
    own = Window.partitionBy(run)
    worst = F.max(F.struct(ms, order)).over(own)
    return facts.select(run, stage, ms, (F.col(ms) / F.greatest(F.sum(ms).over(own), F.lit(LEAST_TOTAL)) * 100).alias("share"), (F.struct(ms, order) == worst).alias("bottleneck"))


def top_stages(facts: DataFrame, ms: str, order: list[str], n: int = TOP) -> DataFrame:
    return facts.orderBy(F.desc(ms), *order).limit(n)


def stage_means(facts: DataFrame, stage: str, ms: str) -> DataFrame:
    """Mean time of each stage, 0 where no run has one, longest first."""
    return facts.groupBy(stage).agg(F.coalesce(F.avg(ms), F.lit(0.0)).alias("mean_ms"), F.count(ms).alias("runs")).orderBy(F.desc("mean_ms"), stage)


def decode_rate(tokens: Column, first_ms: Column, total_ms: Column) -> Column:
    """Tokens a second after the first; null for fewer than two tokens or no time."""
    seconds = (total_ms - first_ms) / 1000
    return F.when((tokens >= 2) & (seconds > 0), (tokens - 1) / seconds)


def mean_decode_rate(rates: DataFrame, rate: str = "rate") -> DataFrame:
    return rates.agg(F.avg(rate).alias("mean_rate"), F.count(rate).alias("measured"), F.count(F.lit(1)).alias("runs"))


def gauge(events: DataFrame, key: str, order: list[str], change: Column, enabled: bool = True) -> DataFrame:
    """events with in_flight, the running sum of change, and gated, whether questions wait meanwhile."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumn("in_flight", F.sum(change).over(w))
    return out.withColumn("gated", F.lit(enabled) & (F.col("in_flight") > 0))


def folded_tokens(tokens: DataFrame, stream: str = "stream_id", order: str = "seq", token: str = "token", time: str | None = None) -> DataFrame:
    """stream, n_tokens, first (time or order of the first token) and answer, the tokens joined."""
    parts = F.array_sort(F.collect_list(F.struct(order, token)))
    return tokens.groupBy(stream).agg(F.count(F.lit(1)).alias("n_tokens"), F.min(time or order).alias("first"), F.array_join(F.transform(parts, lambda p: p[token]), "").alias("answer"))
