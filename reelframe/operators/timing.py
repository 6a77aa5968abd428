"""Regularity of gaps: histogram, dominant and weighted-median gap, steady share, class.

Everything works on runs (gap, count), so equal gaps are never expanded to rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares for the two classes in thousandths, tolerance in hundredths of the gap and in ticks.
STEADY, NEARLY_STEADY, TOLERANCE_PERCENT, TOLERANCE_TICKS = 995, 950, 1, 2


def histogram(runs: DataFrame, key: str = "key", delta: str = "delta", count: str = "n", order: str = "ord") -> DataFrame:
    """(key, delta, c, first, runs): rows of each gap, where it comes first, and in how many runs; runs without rows are left out."""
    return runs.where(F.col(count) > 0).groupBy(key, delta).agg(F.sum(count).alias("c"), F.min(order).alias("first"), F.count(F.lit(1)).alias("runs"))


def summarize(hist: DataFrame, key: str = "key", delta: str = "delta") -> DataFrame:
    """One row a key: n, gaps, dominant (first of the most frequent), dom, low, high, reference, steady, mode.

    reference is the weighted lower median over positive gaps, with zero gaps counted in the weight it has to reach;
    without a positive gap it is the dominant one.
    """
    whole = Window.partitionBy(key)
    rising = whole.orderBy(delta).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positive = F.col(delta) > 0
    rows = hist.withColumn("n", F.sum("c").over(whole)).withColumn("cum", F.sum(F.when(positive, F.col("c")).otherwise(0)).over(rising))
    rows = rows.withColumn("median", F.min(F.when(positive & (2 * F.col("cum") >= F.col("n")), F.col(delta))).over(whole))
    rows = rows.withColumn("top", F.max_by(delta, F.struct("c", (-F.col("first")).alias("f"))).over(whole))
    rows = rows.withColumn("ref", F.coalesce("median", "top"))
    near = positive & (100 * F.abs(F.col(delta) - F.col("ref")) <= F.greatest(F.col("ref") * TOLERANCE_PERCENT, F.lit(100 * TOLERANCE_TICKS)))
    out = rows.groupBy(key).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("gaps"), F.max("top").alias("dominant"), F.max("c").alias("dom"),
        F.min(F.when(positive, F.col(delta))).alias("low"), F.max(F.when(positive, F.col(delta))).alias("high"), F.max("ref").alias("reference"),
        F.sum(F.when(near, F.col("c")).otherwise(0)).alias("steady"),
    )
    share = 1000 * F.col("steady")
    return out.withColumn("mode", F.when(share >= STEADY * F.col("n"), "cfr").when(share >= NEARLY_STEADY * F.col("n"), "near-cfr").otherwise("vfr"))


def run_counts(hist: DataFrame, key: str = "key") -> DataFrame:
    """One row a key: runs, different gaps, and the share of rows with the most frequent one."""
    share = F.max("c").cast("double") / F.sum("c").cast("double")
    return hist.groupBy(key).agg(F.sum("runs").alias("runs"), F.count(F.lit(1)).alias("gaps"), share.alias("dominant_share"))


def gaps(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, ord, delta, n): the gaps between neighbours along `at` within each key."""
    line = Window.partitionBy(key).orderBy(at)
    moved = rows.select(F.col(key).alias("key"), F.row_number().over(line).alias("ord"), (F.col(at) - F.lag(at).over(line)).alias("delta"))
    return moved.where("delta IS NOT NULL").withColumn("n", F.lit(1).cast("long"))


def run_lengths(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, n): neighbouring equal values along `order` as one run."""
    line = Window.partitionBy(key).orderBy(order)
    turns = rows.withColumn("_turn", (~F.col(value).eqNullSafe(F.lag(value).over(line))) | (F.row_number().over(line) == 1))
    runs = turns.withColumn("run", F.sum(F.col("_turn").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))
