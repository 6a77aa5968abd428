"""Sums of products beyond 64 bits, with limits whose breach is a row and not a failure.

Numbers of samples and ticks are unsigned 32-bit fields, so a product has up to 20 digits and a sum of them more than
any long; all of it is DECIMAL.

Defined results: `error` says why there is no value, and is null where there is one; a null field counts as out of
range; a key without rows has no row; null keys are a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest 32-bit number, and the largest that a double holds with all before it.
MOST_FIELD, MOST_EXACT = (1 << 32) - 1, (1 << 53) - 1
RANGE, EMPTY, LARGE, CLOCK = "field out of range", "empty", "too large", "no duration or clock"
WIDE = "decimal(38,0)"


def wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def timelines(runs: DataFrame, key: str, count: str = "count", delta: str = "delta") -> DataFrame:
    """(key, ticks, error) of runs (key, count, delta): the exact length in ticks, from 1 to MOST_EXACT."""
    good = F.coalesce(F.col(count).between(0, MOST_FIELD) & F.col(delta).between(0, MOST_FIELD), F.lit(False))
    field = [F.when(good, F.col(c)).otherwise(0).cast("decimal(10,0)") for c in (count, delta)]
    sums = runs.groupBy(key).agg(F.sum(field[0] * field[1]).cast(WIDE).alias("_sum"), F.bool_and(good).alias("_good"))
    error = F.when(~F.col("_good"), RANGE).otherwise(timeline_error(F.col("_sum")))
    return sums.select(key, F.when(error.isNull(), F.col("_sum").cast("long")).alias("ticks"), error.alias("error"))


def timeline_error(ticks: Column) -> Column:
    return F.when(ticks <= 0, EMPTY).when(ticks > MOST_EXACT, LARGE)


def timeline_of(runs: Column) -> Column:
    """The exact length in ticks of an array of struct(count, delta), as DECIMAL(38,0)."""
    return F.aggregate(runs, F.lit(0).cast(WIDE), lambda a, r: (a + wide(r["count"]).cast("decimal(10,0)") * wide(r["delta"]).cast("decimal(10,0)")).cast(WIDE))


def bitrate_over(amount: Column, timescale: Column, duration: Column) -> tuple[Column, Column]:
    """(bits a second, error) of `amount` bytes over duration ticks: 8 * amount * timescale div duration, in 32 bits."""
    bits = amount.cast("decimal(18,0)") * F.lit(8).cast("decimal(1,0)") * timescale.cast("decimal(10,0)")
    over = duration.cast("decimal(20,0)")
    error = F.when(F.coalesce((timescale <= 0) | (duration <= 0), F.lit(True)), CLOCK).when(bits >= over * F.lit(1 << 32).cast("decimal(10,0)"), LARGE)
    return F.when(error.isNull(), F.call_function("div", F.when(error.isNull(), bits), F.when(error.isNull(), over))), error


def maximum_bitrates(samples: DataFrame, key: str, size: str, timescale: Column, duration: Column) -> DataFrame:
    """(key, bytes, bitrate, error) of samples, a row each: timescale and duration are aggregates, such as F.max of a column."""
    good = F.coalesce(F.col(size).between(0, MOST_FIELD), F.lit(False))
    sums = samples.groupBy(key).agg(F.sum(F.when(good, F.col(size)).otherwise(0).cast("decimal(10,0)")).cast("decimal(18,0)").alias("bytes"), F.bool_and(good).alias("_good"), timescale.alias("_scale"), duration.alias("_over"))
    value, error = bitrate_over(F.col("bytes"), F.col("_scale"), F.col("_over"))
    return sums.select(key, F.col("bytes").cast("long").alias("bytes"), F.when(F.col("_good"), value).alias("bitrate"), F.when(~F.col("_good"), RANGE).otherwise(error).alias("error"))
