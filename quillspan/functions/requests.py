"""Bodies of a model server's requests, as JSON by expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generate_request(prompt: Column, model: str, stream: bool, keep_alive: int, context: int, most: int, penalty: float, last: int) -> Column:
    """JSON of a raw completion at temperature 0: context tokens, most new tokens, repeat penalty over the last tokens."""
    options = F.struct(
        F.lit(0.0).alias("temperature"), F.lit(context).alias("num_ctx"), F.lit(most).alias("num_predict"), F.lit(float(penalty)).alias("repeat_penalty"), F.lit(last).alias("repeat_last_n"),
    )
    body = F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(stream).alias("stream"), F.lit(keep_alive).alias("keep_alive"), F.lit(True).alias("raw"), options.alias("options"))
    return F.to_json(body)


def embed_request(texts: Column, model: str, keep_alive: str | None = None) -> Column:
    """JSON of an embedding request for an array of texts; a single text is sent bare. keep_alive is left out if null."""
    common = F.lit(model).alias("model"), F.lit(keep_alive).cast("string").alias("keep_alive")
    one = F.to_json(F.struct(common[0], F.get(texts, F.lit(0)).alias("input"), common[1]))
    return F.when(F.size(texts) == 1, one).otherwise(F.to_json(F.struct(common[0], texts.alias("input"), common[1])))
