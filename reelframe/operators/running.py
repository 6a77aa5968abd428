"""Running sums and numbers along an order, however few the groups are.

Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks.  A range is an expression of the
row: bounds are drawn from a few thousand rows once, and a row is compared with them in a tree, so every use of the
range agrees with every other, whatever is run again or coalesced.  The partial sums of a group that reaches over
several ranges are summed before; there are fewer of these than bounds, and they are broadcast.

Defined results: rows with equal orders count in the order of a hash of their other columns (maps aside), and in any
order where they are equal in all; null orders come first; null values count as zero; null groups are a group; an empty
table gives an empty result.  A column of rows with the name that is asked for is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RANGE_ROWS, MOST_RANGES, DRAWN = 500_000, 1024, 16


def _range_of(key: Column, bounds: list[Column], first: int = 0) -> Column:
    """The number of bounds that key is not below, by halves."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(key < bounds[half], _range_of(key, bounds[:half], first)).otherwise(_range_of(key, bounds[half + 1 :], first + half + 1))


def _literal(value: object, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


def _bounds(rows: DataFrame, ranges: int, total: int) -> list[Column]:
    """At most ranges - 1 values of _key that cut rows into ranges of about equal size; only the time depends on which."""
    share = min(1.0, DRAWN * ranges / max(1, total))
    drawn = rows.select("_key").where(F.rand(17) < share).distinct().orderBy("_key").collect() if ranges > 1 else []  # about DRAWN rows a range
    step = max(1, len(drawn) // max(1, ranges))
    return [_literal(r["_key"], rows.schema["_key"].dataType) for r in drawn[step::step]]


def running_sum(rows: DataFrame, group: str, order: str, value: Column, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with `name`: the sum of value over the rows of its group that come before."""
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, T.MapType)])
    keyed = rows.withColumn("_value", F.coalesce(value, F.lit(0)).cast("long")).withColumn("_key", F.struct(F.col(group).alias("g"), F.col(order).alias("o"), tie.alias("t")))
    total = rows.count()
    bounds = _bounds(keyed, min(MOST_RANGES, -(-total // range_rows)), total)
    ranged = keyed.withColumn("_range", _range_of(F.col("_key"), bounds))
    parts = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.sum("_value").alias("_sum"))
    along = Window.partitionBy("_group").orderBy("_of")
    bases = parts.withColumn("_base", F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1))).where("_base IS NOT NULL").drop("_sum")
    inside = Window.partitionBy("_range", group).orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_here", F.sum("_value").over(inside) - F.col("_value"))
    met = summed.join(F.broadcast(bases), (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return met.select(*[f"`{c}`" for c in rows.columns if c != name], (F.coalesce("_base", F.lit(0).cast("long")) + F.col("_here")).alias(name))


def numbered(rows: DataFrame, group: str, order: str, name: str = "ord") -> DataFrame:
    """rows with `name`: their number within the group, from one."""
    return running_sum(rows, group, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def primary(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The row of each group with the largest value, the first along the order of equals; by aggregation alone."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o"), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(group).agg(best.alias("b")).select("b.row.*")


def rate(rows: DataFrame, group: str, amount: Column, seconds: Column) -> DataFrame:
    """(group, amount, seconds, bitrate): sums, and eight times the amount over the seconds if there are any."""
    sums = rows.groupBy(group).agg(F.sum(amount).alias("amount"), F.sum(seconds).alias("seconds"))
    return sums.withColumn("bitrate", F.when(F.col("seconds") > 0, (8 * F.col("amount")).cast("double") / F.col("seconds").cast("double")))


def tail(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group along the order."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")
