"""Evidence of findings, steps of plans, comparisons of reports, and files by ranges."""

import pytest
from pyspark.sql import functions as F
from test_analysis import FILES
from test_rewrites import chunks, movie

from reelframe.operators import analysis, compare, rules
from reelframe.plans import steps
from reelframe.sources import containers, ranges, rewrites

FILES = {k: v for k, v in FILES.items() if k != "null"} | {"movie": movie()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("media")
    for name, data in FILES.items():
        (path / f"{name}.mp4").write_bytes(data)
    return path


@pytest.fixture(scope="module")
def reports(spark, folder):
    files = ranges.list_files(spark, str(folder))
    return analysis.reports(files, ranges.boxes(files, payloads=True)).withColumn("name", F.regexp_extract("file_id", r"([^/]*)\.mp4$", 1)).cache()


def test_ranges_find_what_whole_files_hold(spark, folder):
    by_range = ranges.boxes(ranges.list_files(spark, str(folder)), payloads=True)
    whole = containers.boxes(containers.read_files(spark, str(folder)), payloads=True)
    plain = [sorted(map(str, df.select([F.hex(c).alias(c) if t == "binary" else c for c, t in df.dtypes]).where(df["type"].isin("mdat", "free") == F.lit(False)).collect())) for df in (by_range, whole)]
    assert plain[0] == plain[1] and by_range.count() == whole.count()


def test_rewrites_by_ranges(spark, folder, tmp_path):
    files = ranges.list_files(spark, str(folder))
    done = {r["file_id"].rsplit("/", 1)[1]: r for r in ranges.write_rewrites(files, str(tmp_path), retag=True).collect()}
    data = (tmp_path / "movie_remuxed.mp4").read_bytes()
    assert data == rewrites.rewritten(FILES["movie"], retag=True)[0] and chunks(data) == [b"AAAA", b"BBBB"]
    assert done["movie.mp4"]["bytes"] == len(data) and done["late.mp4"]["error"].startswith("2 mdat") and done["junk.mp4"]["error"] and "empty.mp4" not in done
    assert sorted(p.name for p in tmp_path.glob("*mp4*")) == ["movie_remuxed.mp4"]


def test_explained_findings(reports):
    rows = {(r["name"], r["id"]): r for r in rules.explained(reports.where("error is null"), "name").collect()}
    said = {k: r["evidence"] for k, r in rows.items()}
    assert said["whole", "hdr-source"] == "transfer PQ (HDR10), primaries BT.709, 10-bit"
    assert said["whole", "low-source-bitrate"] == "0.2 Mbps measured, at least 3.7 Mbps expected for 1080x1920 at 30 fps"
    assert said["late", "vfr"] == "gaps vary by 50.0% (10 fps to 20 fps), 25.0% of frames on the reference gap"
    assert said["late", "untagged-color"] == "no colr box" and said["late", "hevc-source"] == "HEVC / H.265 in an hvc1 sample entry"
    assert said["late", "resolution-off-target"] == "640x361 landscape, nearest rung 1280 x 720 (16:9)" and rows["late", "high-bit-depth"]["title"] == "10-bit SDR source"
    assert all(r["evidence"] is not None and r["title"] and r["detail"] for r in rows.values())


def test_plans(reports):
    rows = {(r["name"], r["mode"]): r for r in steps.plans(reports.where("error is null"), "name").collect()}
    assert len(rows) == 4 * 4
    labels = {k: [s["label"] for s in r["steps"] or []] for k, r in rows.items()}
    assert labels["movie", "retag"] == [steps.INDEX, steps.TAG, steps.REFERENCE, steps.SILENT] and rows["movie", "retag"]["engine"] == "native"
    assert labels["late", "remux"] == [steps.ENGINE, steps.COPY, steps.FRONT, steps.SILENT] and rows["late", "remux"]["fallback"] == "media is split across 2 mdat boxes"
    assert labels["whole", "master"] == ["Encode H.264 High at 30 fps", steps.SOUND, steps.FRONT] and not rows["whole", "master"]["lossless"]
    assert rows["fragments", "master"]["fallback"] == steps.NO_VIDEO and rows["fragments", "master"]["args"] is None
    assert rows["whole", "observed"]["fallback"] is None and rows["movie", "observed"]["fallback"] == "there is no AAC audio track to clone" and rows["late", "observed"]["fallback"].endswith("mdat box; found 2")


def test_comparison(reports):
    whole = [c for c in reports.columns if c != "name"]
    one = {n: reports.where(F.col("name") == n).select(F.lit(1).alias("k"), F.struct(*whole).alias(side)) for n, side in (("late", "before"), ("movie", "after"))}
    rows = {r["label"]: (r["before"], r["after"], r["improved"]) for r in compare.report_comparison(one["late"].join(one["movie"], "k"), "k").collect()}
    assert list(rows)[:3] == ["Size", "Index", "Frame timing"] and len(rows) == 9
    assert rows["Index"] == ("end of file", "end of file", False) and rows["Frame timing"] == ("variable", "constant", True)
    assert rows["Frame size"] == ("640 x 361", "1920 x 1080", None) and rows["Video payload"] == ("0 B", "8 B", False)


def test_bytes_and_tails(spark):
    cases = [(b"abcdef", b"abXdef"), (b"abc", b"abcd"), (b"", b"x"), (b"Xbc", b"abc"), (b"abX", b"abc"), (b"same", b"same"), (bytes(1000) + b"1" + bytes(99), bytes(1100))]
    rows = compare.byte_comparison(spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, before binary, after binary"), "k").orderBy("k").collect()
    assert [r["first_difference"] for r in rows] == [2, None, None, 0, 2, None, 1000] and [r["identical"] for r in rows] == [a == b for a, b in cases]
    tails = spark.createDataFrame([(b"\0\0\0\4\0\0\0\0" * 9,), (b"\0" * 7,), (b"",), (b"12345678" + b"12345679",), (None,)], "t binary")
    assert [r[0] for r in tails.select(compare.repeated_pattern(F.col("t"))).collect()] == [9, None, None, None, None]
    tracks = "file_id string, kind string, ord int, samples long"
    a, b = spark.createDataFrame([("f", "audio", 1, 443), ("g", "audio", 1, 5)], tracks), spark.createDataFrame([("f", "audio", 1, 443), ("f", "audio", 2, 4430), ("g", "audio", 1, 5)], tracks)
    assert [tuple(r) for r in compare.cloned_sound(a, b).collect()] == [("f", 10.0)]
