"""Snapshots: a manifest of member digests, its verification, and restore by shared columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def manifest_of(members: DataFrame, member: str, content: str) -> DataFrame:
    """member, size, sha256. content: text or binary."""
    raw = F.col(content).cast("binary")
    return members.select(F.col(member).alias("member"), F.length(raw).alias("size"), F.sha2(raw, 256).alias("sha256"))


def mismatches(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """member, problem (missing, size, digest) of the promised members that aren't there as promised."""
    there = found.select("member", F.col("size").alias("own_size"), F.col("sha256").alias("own_sha"))
    problem = F.when(F.col("own_size").isNull(), "missing").when(F.col("own_size") != F.col("size"), "size").when(F.col("own_sha") != F.col("sha256"), "digest")
    return manifest.join(there, "member", "left").select("member", problem.alias("problem")).where(F.col("problem").isNotNull())


def restored(live: DataFrame, saved: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame | None:
    """The saved rows in the live table's columns and types: shared columns from the save, others their default or
    null; columns that only the save has are left out. None if they share no column."""
    defaults = defaults or {}
    if not set(live.columns) & set(saved.columns):
        return None
    pick = lambda f: F.col(f.name) if f.name in saved.columns else defaults.get(f.name, F.lit(None))
    return saved.select(*(pick(f).cast(f.dataType).alias(f.name) for f in live.schema.fields))


def restorable_tables(names: list[str], migrations: str = "_migrations") -> list[str]:
    return [n for n in names if not n.startswith("sqlite_") and n != migrations]


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under folder, and a manifest of the digests of its files."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    members = [_files(spark, folder, name) for name in tables]
    lines = spark.createDataFrame([(json.dumps({"format": FORMAT}),)], "value string")
    for m in members:
        lines = lines.unionByName(m.select(F.to_json(F.struct("table", "member", "size", "sha256")).alias("value")))
    lines.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def _files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """table, member (file), size, sha256 of each file of a saved table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}")
    own = files.withColumn("file", F.regexp_extract("path", r"[^/]*$", 0))
    return manifest_of(own.select(F.concat(F.lit(f"{name}/"), "file").alias("file"), "content"), "file", "content").withColumn("table", F.lit(name))


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot whose files are all as the manifest promises, and no others."""
    lines = spark.read.text(f"{folder}/manifest")
    heads = lines.select(F.from_json("value", "format int").alias("h")).where("h.format is not null").collect()  # one line
    if not heads or heads[0].h.format > FORMAT:
        raise ValueError(f"snapshot format {heads[0].h.format if heads else None} isn't {FORMAT}")
    promised = lines.select(F.from_json("value", "table string, member string, size long, sha256 string").alias("m")).where("m.member is not null").select("m.*")
    out = {}
    for name in sorted(r.table for r in promised.select("table").distinct().collect()):  # the tables' names
        mine, found = promised.where(F.col("table") == name).drop("table"), _files(spark, folder, name).drop("table")
        wrong = mismatches(mine, found).select("member").unionByName(found.join(mine, "member", "left_anti").select("member")).head()
        if wrong:
            raise ValueError(f"member {wrong.member} differs from the manifest")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def archives(names: DataFrame, name: str = "name") -> DataFrame:
    return names.where(F.col(name).endswith(".tar.gz")).orderBy(F.desc(name))
