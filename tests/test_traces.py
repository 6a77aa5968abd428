"""What is read of rewritten files, made once; tracks without the timing of videos."""

from pyspark.sql import functions as F
from test_observed import frame, source

from reelframe import media_queries
from reelframe.operators import analysis
from reelframe.sources import containers

SF = "/root/testdata/sf0.001"


def test_rewritten_files_are_made_once(spark):
    """The plan reads the finished files instead of making them again for each thing that is looked for."""
    plan = media_queries.observed_traces(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "offset_shift" not in plan and "pad_samples" not in plan and plan.count("LogicalRDD") >= 4


def test_tracks_without_timing_are_the_same_otherwise(spark):
    files = frame(spark, {"a": source(), "b": source(n=8, edts=False), "c": None})
    whole = analysis.tracks(containers.boxes(files, payloads=True))
    few = containers.boxes(files, payloads=True, kinds=analysis.TRACK_TYPES, columns=analysis.TRACK_COLUMNS)
    part = analysis.tracks(few, timed=False)
    assert few.columns == ["file_id", "node_id", "path", "payload"] and set(part.columns) < set(whole.columns) and part.count() == 4
    names = [F.col(c) for c in ("file_id", "ord", "kind", "samples", "bytes", "chunks", "seconds", "offsets_kind", "format")]
    assert sorted(part.select(*names).collect()) == sorted(whole.select(*names).collect())
    assert "Generate" not in part._jdf.queryExecution().optimizedPlan().toString()
