"""Token streams as text: newline-delimited JSON from a model, and server-sent events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def complete_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The body's lines (pos, line), without a last one that no newline ends."""
    lines = F.split(F.col(body), "\n")
    return bodies.select("*", F.posexplode(F.slice(lines, 1, F.size(lines) - 1)).alias("pos", "line")).drop(body)


def ndjson_tokens(bodies: DataFrame, stream: str = "stream_id", body: str = "body") -> DataFrame:
    """stream, seq, token up to the first done; blank and unreadable lines are skipped."""
    said = complete_lines(bodies, body).select(stream, "pos", F.from_json("line", "response string, done boolean", {"mode": "PERMISSIVE"}).alias("m"))
    said = said.where(F.col("m.response").isNotNull() | F.col("m.done").isNotNull())
    return _until_done(said.select(stream, "pos", F.col("m.response").alias("token"), F.coalesce("m.done", F.lit(False)).alias("done")), stream)


def sse_tokens(bodies: DataFrame, stream: str = "stream_id", body: str = "body") -> DataFrame:
    """stream, seq, token of server-sent events: blocks between blank lines, of each its first `data: ` line."""
    blocks = bodies.select(stream, F.posexplode(F.split(F.col(body), "\n\n")).alias("pos", "block"))
    data = blocks.withColumn("data", F.get(F.filter(F.split("block", "\n"), lambda x: x.startswith("data: ")), F.lit(0)))
    said = data.where("data is not null").select(stream, "pos", F.from_json(F.substring("data", 7, 1 << 30), "token string, done boolean").alias("m"))
    said = said.where(F.col("m.token").isNotNull() | F.col("m.done").isNotNull())
    return _until_done(said.select(stream, "pos", F.col("m.token").alias("token"), F.coalesce("m.done", F.lit(False)).alias("done")), stream)


def sse_events(tokens: DataFrame, ends: DataFrame, stream: str = "stream_id") -> DataFrame:
    """stream, seq, event: each token as a server-sent event, then the end with the answer's sources. tokens: stream, seq,
    token; ends: stream, sources (JSON)."""
    data = lambda body: F.concat(F.lit("data: "), body, F.lit("\n\n"))
    said = tokens.select(stream, F.lit(0).alias("part"), "seq", data(F.to_json(F.struct("token"))).alias("event"))
    end = ends.select(stream, F.lit(1).alias("part"), F.lit(0).alias("seq"), data(F.concat(F.lit('{"done":true,"sources":'), "sources", F.lit("}"))).alias("event"))
    place = F.row_number().over(Window.partitionBy(stream).orderBy("part", "seq")) - 1
    return said.unionByName(end).select(stream, place.alias("seq"), "event")


def _until_done(said: DataFrame, stream: str) -> DataFrame:
    w = Window.partitionBy(stream).orderBy("pos")
    over = F.coalesce(F.max(F.col("done").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = said.withColumn("over", over).where((F.col("over") == 0) & (F.coalesce("token", F.lit("")) != ""))
    return kept.select(stream, (F.row_number().over(w) - 1).alias("seq"), "token")
