"""Containers made byte by byte: what the decoders, tracks and reports say of them."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from reelframe.functions import decoders
from reelframe.operators import analysis, rules
from reelframe.sources import containers


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I", len(data) + 8) + kind + data


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def tkhd(number, degrees=0, w=640, h=360):
    r = math.radians(-degrees)
    a, b = round(math.cos(r) * 65536), round(math.sin(r) * 65536)
    return full(b"tkhd", u32(0, 0, number, 0, 0, 0, 0, 0, 0), struct.pack(">9i", a, b, 0, -b, a, 0, 0, 0, 1 << 30), u32(w << 16, h << 16))


def mdhd(scale, ticks, language="eng", version=0):
    code = 0
    for c in language:
        code = code << 5 | ord(c) - 0x60
    body = u32(0, 0, scale, ticks) if version == 0 else struct.pack(">QQIQ", 0, 0, scale, ticks)
    return full(b"mdhd", body, struct.pack(">HH", code, 0), version=version)


def hdlr(kind):
    return full(b"hdlr", u32(0), kind, bytes(13))


AVC = bytes([1, 100, 0, 40, 255, 0xE1]) + b"\0\x03abc" + b"\x01\0\x02de" + bytes([0xFD, 0xFA, 0xF8, 0])
COLR = box(b"colr", b"nclx", struct.pack(">HHHB", 1, 16, 9, 0x80))
ESDS = full(b"esds", b"\x03\x80\x80\x80\x22\0\1\0", b"\x04\x80\x80\x80\x14\x40\x15\0\0\0", u32(128000, 96000), b"\x05\x80\x80\x80\x02\x11\x90")


def visual(kind=b"avc1", *inner, w=1920, h=1080):
    body = bytes(6) + b"\0\1" + bytes(16) + struct.pack(">HH", w, h) + bytes(50)
    return full(b"stsd", u32(1), box(kind, body, *inner))


def sound(kind=b"mp4a", *inner, channels=2, rate=44100, version=0):
    body = bytes(6) + b"\0\1" + struct.pack(">HHI", version, 0, 0) + struct.pack(">HHHH", channels, 16, 0, 0) + u32(rate << 16)
    return full(b"stsd", u32(1), box(kind, body, bytes({0: 0, 1: 16, 2: 36}[version]), *inner))


def trak(head, media, handler, entry, runs, sizes, edits=b""):
    stts = full(b"stts", u32(len(runs)), *[u32(*r) for r in runs])
    stsz = full(b"stsz", u32(0, len(sizes), *sizes))
    return box(b"trak", head, edits, box(b"mdia", media, hdlr(handler), box(b"minf", box(b"stbl", entry, stts, stsz, full(b"stco", u32(1, 40))))))


def elst(*entries):
    return box(b"edts", full(b"elst", u32(len(entries)), *[struct.pack(">Iihh", 5, t, r, 0) for t, r in entries]))


TAG = box(b"udta", full(b"meta", hdlr(b"mdir"), box(b"ilst", box(b"\xa9too", box(b"data", u32(1, 0), b"Tool \xff 1 \0\0")))))
FTYP = box(b"ftyp", b"isom", u32(512), b"isomiso5")
MVHD = full(b"mvhd", u32(0, 0, 1000, 4000), bytes(80))
VIDEO = trak(tkhd(1, 90), mdhd(15360, 61440), b"vide", visual(b"avc1", box(b"avcC", AVC), COLR), [(120, 512)], [1000] * 120, elst((1024, 1)))
AUDIO = trak(tkhd(2), mdhd(48000, 192000, version=1), b"soun", sound(b"mp4a", ESDS, version=1), [(188, 1024)], [300] * 188)
FILES = {
    "whole": FTYP + box(b"moov", MVHD, VIDEO, AUDIO, TAG) + box(b"mdat", bytes(50)),
    "late": FTYP + box(b"mdat", bytes(5)) + box(b"mdat", b"") + box(b"moov", MVHD, trak(tkhd(7), mdhd(600, 600), b"vide", visual(b"hvc1", box(b"hvcC", bytes([1, 0x22] + [0] * 10 + [123, 0, 0, 0, 1, 2, 0])), w=640, h=361), [(10, 0), (5, 30), (5, 60)], []), box(b"trak", tkhd(9))),
    "fragments": FTYP + box(b"moov", MVHD, box(b"mvex"), AUDIO) + box(b"moof"),
    "index": FTYP + box(b"mdat", b"abc"),
    "junk": b"A" * 4096,
    "empty": b"",
    "null": None,
}


@pytest.fixture(scope="module")
def made(spark):
    files = spark.createDataFrame([(k, len(v or b""), v) for k, v in FILES.items()], "file_id string, file_size long, content binary")
    boxes = containers.boxes(files, payloads=True).cache()
    return files, boxes, {(r["file_id"], r["track_id"]): r for r in analysis.tracks(boxes).collect()}, {r["file_id"]: r for r in analysis.reports(files, boxes).collect()}


def test_tracks(made):
    v, a, h = (made[2][k] for k in (("whole", 1), ("whole", 2), ("late", 7)))
    assert len(made[2]) == 4
    assert (v["kind"], v["codec"], v["language"], v["seconds"], v["samples"], v["bytes"], v["bitrate"]) == ("video", "H.264 / AVC", "eng", 4.0, 120, 120000, 240000.0)
    assert (v["coded_width"], v["coded_height"], v["rotation"], v["width"], v["height"], v["display_width"]) == (1920, 1080, 90, 1080, 1920, 640)
    assert (v["profile"], v["level"], v["chroma"], v["bit_depth"], v["timing_mode"], v["fps"]) == ("High", "4.0", "4:2:0", 10, "cfr", 30.0)
    assert (v["color"]["transfer_label"], v["color"]["hdr"], v["color"]["full_range"], v["color"]["unspecified"]) == ("PQ (HDR10)", True, True, False)
    assert (v["edit"]["entries"], v["edit"]["non_trivial"], v["edit"]["first_time"]) == (1, False, 1024)
    assert (a["channels"], a["rate"], a["audio_profile"], a["declared_bitrate"], a["seconds"], a["timing_mode"]) == (2, 48000, "AAC-LC", 96000, 4.0, "unknown")
    assert (h["profile"], h["level"], h["chroma"], h["bit_depth"], h["timing_mode"], h["color"]["present"]) == ("Main 10 (High tier)", "4.1", "4:2:0", 10, "vfr", False)
    assert h["fps"] == 10.0 and h["min_fps"] == 10.0 and h["max_fps"] == 20.0 and h["bitrate"] is None and h["edit"] is None


def test_reports(made):
    r = made[3]
    w = r["whole"]
    assert (w["faststart"], w["fragmented"], w["duration"], w["overall_bitrate"], w["encoder"]) == (True, False, 4.0, len(FILES["whole"]) * 2.0, "Tool � 1")
    assert w["notes"] == ["brand of a streaming layout"] and w["types"] == ["ftyp", "moov", "mdat"] and w["brand"]["compatible"] == ["isom", "iso5"]
    assert not r["late"]["faststart"] and r["late"]["notes"] == ["skipped a track", "brand of a streaming layout", "media in parts: 2"]
    assert r["fragments"]["fragmented"] and r["fragments"]["faststart"] and not r["fragments"]["has_video"]
    assert [r[k]["error"] for k in ("whole", "index", "junk", "empty", "null")] == [None, "no moov box", "no boxes", "no boxes", "no boxes"]


def test_reports_feed_the_rules(spark, made):
    files, boxes, _, _ = made
    said = {r["file_id"]: r["ids"].split(",") for r in rules.diagnosis(analysis.reports(files, boxes).where("error IS NULL")).collect()}
    assert said["whole"] == ["hdr-source", "low-source-bitrate"]
    assert said["late"] == ["odd-dimensions", "no-faststart", "vfr", "untagged-color", "no-audio", "hevc-source", "high-bit-depth", "resolution-off-target"]
    assert said["fragments"] == ["fragmented"]


@pytest.mark.parametrize(("entries", "non_trivial", "empty", "rate"), [([], False, False, False), ([(0, 1), (5, 1)], True, False, False), ([(-1, 1)], True, True, False), ([(0, 2)], True, False, True)])
def test_edit_lists(spark, entries, non_trivial, empty, rate):
    data = elst(*entries)[16:]
    r = spark.createDataFrame([(data,)], "d binary").select(decoders.edit_list(F.col("d")).alias("e")).first()["e"]
    assert (r["non_trivial"], r["empty_edit"], r["rate_change"]) == (non_trivial, empty, rate)


@pytest.mark.parametrize("degrees", [0, 90, 180, 270])
def test_rotations(spark, degrees):
    assert spark.createDataFrame([(tkhd(1, degrees)[8:],)], "d binary").select(decoders.track_header(F.col("d"))["rotation"].alias("r")).first()["r"] == degrees


def test_short_payloads_give_nulls(spark):
    rows = spark.createDataFrame([(bytes(n),) for n in range(0, 30, 3)] + [(None,)], "d binary")
    every = [f(F.col("d")).alias(f.__name__) for f in (decoders.brand, decoders.clock, decoders.track_header, decoders.edit_list, decoders.color, decoders.avc_config, decoders.hevc_config, decoders.audio_config, decoders.declared_bitrate)]
    got = rows.select("d", *every, decoders.sample_entry(F.col("d"), F.lit("video")).alias("e")).collect()
    assert len(got) == 11 and all(r["audio_config"] is None or r["audio_config"]["profile"] is None for r in got)


def test_navigation_and_intake(spark, made):
    boxes = made[1].where("file_id = 'whole'")
    assert containers.children(boxes, "moov").count() == 4 and containers.children(boxes, "moov", "trak").count() == 2
    assert containers.first_child(boxes, "moov", "trak").first()["path"] == "moov[1]/trak[1]" and containers.find_all(boxes, "stts").count() == 2
    names = spark.createDataFrame([("u", k, n) for k, n in enumerate(["a.MP4", "b.txt", "c.mov", "d.m4v"])], "u string, k int, n string")
    taken = containers.intake(names.where(containers.accepted(F.col("n"))), "u", "k", room=2).where("taken")
    assert [r["n"] for r in taken.orderBy("k").collect()] == ["a.MP4", "c.mov"]


def test_read_files(spark, tmp_path):
    (tmp_path / "x.mp4").write_bytes(FILES["whole"])
    (tmp_path / "x.txt").write_bytes(b"no")
    files = containers.read_files(spark, str(tmp_path))
    assert files.count() == 1 and containers.boxes(files).where("depth = 0").count() == 3


def test_intake_of_one_long_queue(spark):
    """Nine tenths of the rows are one queue; the largest task of the ranking has its share of them only."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 != 0, "q").alias("u"), F.col("id").alias("k"), F.lit(1).alias("taken"))
    out = containers.intake(rows, "u", "k", room=8)
    assert out.columns == ["u", "k", "taken"] and out.count() == 20_000
    assert sorted(r["k"] for r in out.where("taken AND u = 'q'").collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert sorted(r["k"] for r in out.where("taken AND u IS NULL").collect()) == list(range(0, 80, 10))
    few = spark.createDataFrame([("a", 5), ("a", 5), ("b", 1)], "u string, k long")
    assert containers.intake(few, "u", "k", room=8).where("taken").count() == 3 and containers.intake(few.limit(0), "u", "k").count() == 0


def test_the_library_as_a_zip(spark, tmp_path):
    import subprocess
    import sys

    from reelframe.session import package_zip, ship

    path = package_zip(str(tmp_path))
    said = subprocess.run([sys.executable, "-c", "import reelframe.sources.trees as t; print(t.__file__)"], env={"PYTHONPATH": path, "PATH": "/usr/bin"}, cwd="/", capture_output=True, text=True)
    assert "reelframe.zip" in said.stdout, said.stderr
    ship(spark)
