"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source's target, divided by its size, is the expected number of copies of each of its documents. The whole
part is given; the fractional part is rounded by the pivotal method: two documents trade words, at random but
with unchanged expectation, until one of them is whole, and the other goes on with the rest. Trades move words,
not probabilities, so a source's total stays exact up to its last document. A task folds up to about FAN
documents of one source into one residual; residuals are folded likewise, level by level, so a source of any
size takes log_FAN(n) levels and no group outgrows a task.

Defined results: null text has size 0 and takes no words; a null source is a source of its own, weighed last;
repeated rows are mixed apart; extra columns are ignored; an empty table gives an empty result; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, documents, keyed, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
FAN = 256
SEED = 10
_COPIES = "__quillspan_copies"

_ITEM = "struct<h:bigint,doc_id:bigint,rid:bigint,size:bigint,mass:double,toss:double>"
_DONE = "array<struct<doc_id:bigint,rid:bigint,size:bigint,up:int>>"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, n, source_size, target of each source. Capping sources and resharing their excess by weight ends at
    target = least(most * size, level * weight); the level is the first, in order of most * size / weight, under
    which no further source is capped."""
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    # the windows below run over one row for each source
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    cap = most * F.col("source_size")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    so_far, rest, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    per = per.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(so_far), F.lit(0))) / F.sum("w").over(rest))
    per = per.withColumn("place", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") * F.col("w") <= cap, F.struct("place", "level"))
    per = per.withColumn("level", F.min(fits).over(every)["level"])
    return per.select("source", "n", "source_size", F.coalesce(F.least(cap.cast("double"), F.col("level") * F.col("w")), cap.cast("double")).alias("target"))


def _trade(state: Column, x: Column) -> Column:
    """One step of the pivotal method between the residual and x."""
    a = state["carry"]
    step = F.struct(
        F.least(a["size"] - a["mass"], x["mass"]).alias("gain"),
        F.least(a["mass"], x["size"] - x["mass"]).alias("loss"),
    )

    def decide(s: Column) -> Column:
        up = x["toss"] * (s["gain"] + s["loss"]) < s["loss"]
        whole = F.when(up, a["size"] - a["mass"] <= x["mass"]).otherwise(a["mass"] <= x["size"] - x["mass"])
        return F.struct(whole.alias("whole"), F.when(up == whole, 1).otherwise(0).alias("up"))

    def settle(s: Column) -> Column:
        done = F.when(s["whole"], a).otherwise(x)
        other = F.when(s["whole"], x).otherwise(a)
        left = a["mass"] + x["mass"] - s["up"] * done["size"]
        carry = F.struct(other["h"], other["doc_id"], other["rid"], other["size"], F.greatest(F.lit(0.0), F.least(left, other["size"].cast("double"))), other["toss"])
        return F.struct(carry.cast(_ITEM).alias("carry"), F.concat(state["done"], F.array(F.struct(done["doc_id"], done["rid"], done["size"], s["up"])).cast(_DONE)).alias("done"))

    traded = F.transform(F.transform(F.array(step), decide), settle)[0]
    return F.when(a.isNull(), F.struct(x.cast(_ITEM).alias("carry"), state["done"].alias("done"))).otherwise(traded)


def _random(seed: int) -> Column:
    """From 0 to 1, by the document and the seed."""
    return F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def round_copies(sized: DataFrame, per: DataFrame, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """rid, doc_id, source, size, source_size, target, copies for each row of sized (rid, doc_id, source, size)."""
    per = per.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = per.withColumn("base", F.floor("share")).withColumn("part", F.col("share") - F.floor("share"))
    rows = sized.alias("d").join(per.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.n", "p.source_size", "p.target", "p.base", "p.part")
    open_ = (F.col("part") > 0) & (F.col("size") > 0)
    most = per.agg(F.max("n")).first()[0] or 0
    settled = rows.where(~open_).select("rid", F.lit(0).alias("up"))
    pending = rows.where(open_).select(
        "source", "doc_id", "rid", "size", (F.col("part") * F.col("size")).alias("mass"),
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.ceil(F.col("n") / fan)).alias("chunk"),
    )
    folds = max(1, -(-most // fan))
    counts = pending.groupBy("source", "chunk").count().where(F.col("count") > 4 * fan)
    over = written(counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.ceil(F.col("count") / fan).alias("pieces")), "mix-over")
    widest = over.agg(F.max("pieces")).first()[0] or 1
    if widest > 1:
        apart = pending.join(over.hint("merge"), pending["source"].eqNullSafe(over["s"]) & (pending["chunk"] == over["c"]), "left")
        piece = F.pmod(F.xxhash64("rid", F.lit(seed)), F.coalesce("pieces", F.lit(1)))
        pending = apart.select("source", "doc_id", "rid", "size", "mass", (F.col("chunk") + F.lit(folds) * piece).alias("chunk"))
    level, chunks = 0, folds * widest
    while True:
        # larger documents trade first, so that the last residual is a small one
        order = -F.col("size") * (1 << 20) - F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1 + level)), F.lit(1 << 20))
        item = F.struct(order.alias("h"), "doc_id", "rid", "size", "mass", _random(seed + 1001 + level).alias("toss"))
        items = F.array_sort(F.collect_list(item.cast(_ITEM)))
        start = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast(_DONE).alias("done"))
        folded = written(pending.groupBy("source", "chunk").agg(items.alias("items")).select("source", "chunk", F.aggregate("items", start, _trade).alias("r")), f"mix-level{level}")
        settled = settled.unionByName(folded.select(F.explode("r.done").alias("x")).select("x.rid", "x.up"))
        if chunks <= 1:
            break
        pending = folded.select("source", "r.carry.doc_id", "r.carry.rid", "r.carry.size", "r.carry.mass", F.floor(F.col("chunk") / fan).alias("chunk"))
        level, chunks = level + 1, -(-chunks // fan)
    final = folded.select("r.carry.*").select("rid", F.when(_random(seed + 2001) * F.col("size") < F.col("mass"), 1).otherwise(0).alias("up"))
    settled = settled.unionByName(final)
    return rows.join(settled, "rid").select("rid", "doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("up")).cast("int").alias("copies"))


def mix(docs: DataFrame, text: str = "text", row: Column | None = None) -> DataFrame:
    """The decision for each row of docs: rid (its number, or row if given), doc_id, source, size, source_size, target,
    copies."""
    rid = F.monotonically_increasing_id() if row is None else row
    sized = written(docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(text).alias("size")), "mix-sizes")
    per = written(targets(sized), "mix-targets")
    return round_copies(sized, per)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    rows = keyed(docs, "mix-rows")
    taken = mix(rows, row=F.col(ROW)).where("copies > 0").select(F.col("rid").alias(ROW), F.sequence(F.lit(1), F.col("copies")).alias(_COPIES))
    return rows.join(taken, ROW).withColumn(_COPIES, F.explode(_COPIES)).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
