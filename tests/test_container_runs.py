"""Neighbours with one header are read as one run, and small rows that become files are dealt to all cores."""

import random
import struct

import pytest
from test_rewrites import box, placed, two_tracks

from reelframe import registry
from reelframe.sources import containers, rewrites

SF = "/root/testdata/sf0.001"


def one_by_one(data, start, end):
    """Neighbouring boxes by a plain loop."""
    out = []
    while end - start >= 8 and (found := containers.header(data[start : min(end, start + 16)], end - start)):
        out.append((found[0], start, *found[1:]))
        start += found[1]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_runs_are_the_boxes_one_by_one(seed):
    draw = random.Random(seed)
    data = b"".join(box(draw.choice([b"free", b"skip"]), bytes(draw.choice([0, 1, 9]))) * draw.choice([1, 2, 3, 40]) for _ in range(20)) + draw.choice([b"", bytes(5), box(b"free") + struct.pack(">I4s", 0, b"free") + bytes(9), struct.pack(">I4sQ", 1, b"free", 16) * 3])
    assert list(containers.headers(data, 0, len(data))) == one_by_one(data, 0, len(data))
    assert list(containers.headers(data, 0, len(data), 7)) == one_by_one(data, 0, len(data))[:7]
    runs = list(containers.runs(data, 0, len(data)))
    assert sum(r[-1] for r in runs) == len(one_by_one(data, 0, len(data))) and len(runs) <= 25


def test_a_file_of_many_paddings_is_read_in_few_steps(spark):
    """Rows of runs: a dozen for 5013 boxes, with the same sums as the boxes one by one."""
    source = two_tracks(box(b"free") * 5000)
    files = spark.createDataFrame([("a", source), ("b", two_tracks(b"\0\0\0\4free")), ("c", None), ("d", b"")], "file_id string, content binary")
    rows = containers.boxes(files).groupBy("file_id", "type", "error").count().collect()
    runs = containers.boxes(files, columns=("file_id", "type", "error", "boxes"), runs=True)
    assert {tuple(r) for r in runs.groupBy("file_id", "type", "error").sum("boxes").collect()} == {tuple(r) for r in rows}
    assert runs.columns == ["file_id", "type", "error", "boxes"] and runs.where("file_id = 'a'").count() < 40
    kept = containers.boxes(files, payloads=True, kinds=("stco",))
    assert sorted(kept.collect()) == sorted(containers.boxes(files, payloads=True).where("type = 'stco'").collect()) and kept.count() == 2


def test_rewriting_many_paddings_takes_few_steps(monkeypatch):
    source, steps = two_tracks(box(b"free") * 5000), []
    plain = containers.header
    monkeypatch.setattr(containers, "header", lambda *a: steps.append(1) or plain(*a))
    made, moved, _ = rewrites.rewritten(source)
    assert placed(made) == placed(source) == [[b"AAAA"], [b"BBBB"]] and moved == 2 and made.count(box(b"free")) == 5000
    assert len(steps) < 500


def test_odd_containers_are_made_by_many_tasks(spark):
    assert registry._odd_containers(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
