"""Installable components: selection by target, exclusions, space and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions.text import version_parts


def selected(components: DataFrame, targets: list[str]) -> DataFrame:
    """One component for each destination: of the first target in the list, the first listed; then those for any
    target. components: name, dest, target, listed."""
    ranked = components.withColumn("priority", F.when(F.col("target").isNull(), len(targets)).otherwise(F.array_position(F.array(*map(F.lit, targets)), F.col("target")) - 1))
    ranked = ranked.where(F.col("priority") >= 0)
    place = F.row_number().over(Window.partitionBy("dest").orderBy("priority", "listed"))
    return ranked.withColumn("place", place).where("place = 1").drop("place")


def without(components: DataFrame, names: list[str]) -> DataFrame:
    return components.where(~F.col("name").isin(names)) if names else components


def needed_bytes(components: DataFrame, present: DataFrame, free: int) -> DataFrame:
    """One row: missing, needed (bytes of the components that aren't present), fits."""
    missing = components.join(present.select("dest"), "dest", "left_anti")
    out = missing.agg(F.count(F.lit(1)).alias("missing"), F.coalesce(F.sum("size"), F.lit(0)).alias("needed"))
    return out.withColumn("fits", F.col("needed") <= free)


def at_least(version: Column, least: Column) -> Column:
    return version_parts(version) >= version_parts(least)
