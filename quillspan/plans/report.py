"""The bench report as Markdown lines. Runs are folded by stage before anything is rendered, so the report stays as
long as its list of stages, however many runs a session had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.operators.metrics import LEAST_TOTAL, TOP, stage_means

#: Least slice of a pie chart, in milliseconds.
LEAST_SLICE = 0.1


def rounded(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.round(value, places))


def report_lines(facts: DataFrame, stage: str, ms: str, title: str) -> DataFrame:
    """part, place, line: a table of mean stage times with shares and total, a pie chart, the bottleneck and the TOP
    slowest runs of a stage. facts: a row per run and stage. Equal times go by name. Without facts, no line."""
    means = stage_means(facts, stage, ms).drop("runs")
    every = Window.partitionBy(F.lit(0))  # a row a stage
    means = means.withColumn("total", F.greatest(F.sum("mean_ms").over(every), F.lit(LEAST_TOTAL)))
    means = means.withColumn("place", F.row_number().over(every.orderBy(F.desc("mean_ms"), stage)))
    share = rounded(F.col("mean_ms") / F.col("total") * 100, 1)
    rows = means.select(F.lit(2).alias("part"), "place", F.format_string("| %s | %s | %s%% |", stage, rounded(F.col("mean_ms"), 1), share).alias("line"))
    slices = means.select(F.lit(5).alias("part"), "place", F.format_string('    "%s" : %s', stage, rounded(F.greatest("mean_ms", F.lit(LEAST_SLICE)), 1)).alias("line"))
    worst = means.where("place = 1")
    total = worst.select(F.lit(3).alias("part"), "place", F.format_string("| **Total** | **%s** | **100%%** |", rounded(F.col("total"), 1)).alias("line"))
    last = worst.select(F.lit(7).alias("part"), "place", F.format_string("**Bottleneck**: %s (%s%% of total time)", stage, share).alias("line"))
    slowest = facts.select(stage, ms).orderBy(F.desc(ms), stage).limit(TOP)
    slowest = slowest.withColumn("place", F.row_number().over(every.orderBy(F.desc(ms), stage)))
    slow = slowest.select(F.lit(9).alias("part"), "place", F.format_string("| %s | %s |", stage, rounded(F.col(ms), 1)).alias("line"))
    fixed = [(1, f"# {title}"), (1, ""), (1, "| Stage | Mean time (ms) | % of total |"), (1, "|---|---|---|"), (4, ""), (4, "```mermaid"), (4, "pie title Mean time per stage"), (6, "```"), (6, ""), (8, ""), (8, "| Slowest stages | Time (ms) |"), (8, "|---|---|")]
    listed = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(i).alias("place"), F.lit(line).alias("line")) for i, (p, line) in enumerate(fixed, 1)))
    out = worst.select(F.inline(listed))
    for more in (rows, total, slices, last, slow):
        out = out.unionByName(more)
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """The report as one text file in the folder; it is as long as the list of stages."""
    lines.coalesce(1).sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)
