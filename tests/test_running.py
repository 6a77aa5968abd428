"""Running sums and numbers at sizes where a group reaches over several ranges, with adaptive execution on and off."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelframe.operators import running


@pytest.fixture(scope="module", params=[200_000, 2_000_000])
def wide(request, spark, tmp_path_factory):
    """Five groups, one of them null, in hashed order, with a wide column, in eleven files."""
    n, path = request.param, str(tmp_path_factory.mktemp("running") / "rows")
    k = F.pmod(F.xxhash64("id"), F.lit(1 << 62))
    rows = spark.range(n).select(F.when(k % 5 != 0, (k % 5).cast("string")).alias("group"), k.alias("order"), F.when(k % 7 != 0, k % 1000).alias("v"), F.repeat(F.sha2(k.cast("string"), 256), 2).alias("wide"))
    rows.repartition(11).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_sums_and_numbers_of_large_groups(spark, wide, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        before = Window.partitionBy("group").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
        want = wide.select("order", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"), F.row_number().over(Window.partitionBy("group").orderBy("order")).alias("r"))
        got = running.running_sum(running.numbered(wide, "group", "order", "n"), "group", "order", F.col("v"), "start", range_rows=20_000)
        bad = got.join(want, "order").where((F.col("s") != F.col("start")) | (F.col("r") != F.col("n")) | (F.length("wide") != 128))
        assert got.count() == wide.count() and bad.isEmpty() and got.join(want, "order").count() == wide.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_hot_order_spreads_and_edges(spark):
    rows = spark.range(4000).select(F.lit("g").alias("group"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("order"), "id", F.lit(1).alias("n"))
    got = running.running_sum(rows, "group", "order", F.lit(1), "n", range_rows=100)
    assert got.columns == ["group", "order", "id", "n"] and sorted(r["n"] for r in got.collect()) == list(range(4000))
    assert [r["n"] for r in got.orderBy(F.col("order").asc_nulls_first(), "n").collect()] == list(range(4000))
    assert running.running_sum(rows.limit(0), "group", "order", F.lit(1), "n").count() == 0
    same = spark.createDataFrame([("a", 1, 5)] * 50 + [(None, None, None)] * 50, "group string, order int, v int")
    assert sorted(r["s"] for r in running.running_sum(same, "group", "order", F.col("v"), "s", range_rows=7).where("group = 'a'").collect()) == [5 * k for k in range(50)]
    kinds = spark.createDataFrame([(True, 1.5, "x"), (False, None, "y")], "group boolean, order double, other string")
    assert running.numbered(kinds, "group", "order").count() == 2
