"""Trees put together by one shuffle, payloads replaced by file, and edit lists told by their paths alone."""

import pytest
from pyspark.sql import functions as F
from test_trees import written

from reelframe import media_queries
from reelframe.sources import containers, trees

SF = "/root/testdata/sf0.001"
MOOV = (b"moov", [(b"mvhd", b"12"), (b"trak", [(b"edts", [(b"elst", b"e")]), (b"\xa9\\oo", b"x")]), (b"udta", [(b"meta", [(b"ilst", [])], bytes(4), b"abc"), (b"edts", [(b"elst", b"stays")])])])


@pytest.fixture(scope="module")
def nodes(spark):
    files = spark.createDataFrame([(str(k), written(MOOV)) for k in range(5)] + [("n", None), ("bad", written((b"moov", b"\0\0\0\4free")))], "file_id string, content binary")
    return trees.parts(files).localCheckpoint()


def test_bytes_come_together_in_one_shuffle(nodes):
    made = trees.assembled(nodes)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {r["file_id"]: bytes(r["content"]) for r in made.collect()} == {str(k): written(MOOV) for k in range(5)}
    assert trees.assembled(nodes.limit(0)).count() == 0


def test_changes_meet_rows_by_file(nodes):
    change = nodes.where("type = 'mvhd' AND file_id < '2'").select("file_id", "path", F.lit(b"new").alias("payload"))
    nothing = nodes.where("type = 'mvhd'").select("file_id", F.lit(None).cast("string").alias("path"), F.lit(b"lost").alias("payload"))
    out = trees.replaced(nodes, change.unionByName(nothing))
    assert out.count() == nodes.count()
    assert {(r["file_id"], bytes(r["payload"])) for r in out.where("type = 'mvhd'").collect()} == {("0", b"new"), ("1", b"new"), ("2", b"12"), ("3", b"12"), ("4", b"12")}
    assert "file_id" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join") == 1


def test_edit_lists_go_without_a_join(nodes):
    out = trees.without_edit_lists(nodes)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    same = trees.without(nodes, trees.edit_lists(nodes))
    assert sorted(r["path"] for r in out.collect()) == sorted(r["path"] for r in same.collect()) and out.where("type = 'edts'").count() == 5


def test_sounding_containers_are_made_by_many_tasks_and_only_tops_are_rows(spark):
    files = media_queries._sounding(spark, SF)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    tops = containers.boxes(files, deepest=0)
    assert sorted(tops.collect()) == sorted(containers.boxes(files).where("depth = 0").collect())
