"""Rewrites: media bytes stay, offsets point to the same bytes, colours are tagged, odd files are declined."""

import struct

import pytest
from pyspark.sql import functions as F
from test_analysis import AUDIO, AVC, FTYP, MVHD, box, full, hdlr, mdhd, tkhd, u32, visual

from reelframe.operators import analysis
from reelframe.sources import containers, rewrites


def movie(*inner, wide=False):
    """ftyp, free, mdat, moov: two chunks of 4 bytes in mdat."""
    media = len(FTYP) + 16 + 8
    table = full(b"co64", u32(2), struct.pack(">QQ", media, media + 4)) if wide else full(b"stco", u32(2, media, media + 4))
    stbl = box(b"stbl", visual(b"avc1", box(b"avcC", AVC), *inner), full(b"stts", u32(1, 2, 512)), full(b"stsz", u32(4, 2)), table)
    trak = box(b"trak", tkhd(1), box(b"mdia", mdhd(15360, 1024), hdlr(b"vide"), box(b"minf", stbl)))
    return FTYP + box(b"free", bytes(8)) + box(b"mdat", b"AAAABBBB") + box(b"moov", MVHD, trak, box(b"udta", bytes(4)))


def chunks(data):
    (row,) = [r for r in containers.walk(data) if r[5] in ("stco", "co64")]
    return [data[o : o + 4] for o in rewrites.offsets(data[row[6] + row[8] : row[9]], row[5] == "co64")]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("retag", [False, True])
@pytest.mark.parametrize("old", [b"", box(b"colr", b"nclc", struct.pack(">HHH", 2, 2, 2))])
def test_rewritten(wide, retag, old):
    source = movie(old, wide=wide)
    made, moved, passes = rewrites.rewritten(source, retag)
    assert [h[0] for h in containers.headers(made, 0, len(made))] == ["ftyp", "moov", "mdat"]
    assert chunks(made) == [b"AAAA", b"BBBB"] and moved == 2 and passes <= 3
    assert (b"colr" in made) == (retag or bool(old)) and b"\0\0\0\0" in made
    assert len(made) - len(source) == -16 - 8 * wide + retag * (19 - len(old))
    again, *_ = rewrites.rewritten(made, retag)
    assert again == made


@pytest.mark.parametrize(
    ("data", "reason"),
    [
        (FTYP + box(b"moov", MVHD, box(b"mvex")) + box(b"mdat"), "fragmented"),
        (FTYP + box(b"uuid", bytes(16)) + box(b"moov", MVHD) + box(b"mdat"), "unexpected top-level box(es): uuid"),
        (FTYP + box(b"moov", MVHD) + box(b"mdat") * 2, "2 mdat"),
        (FTYP + box(b"moov", MVHD, AUDIO) + box(b"mdat", bytes(9)), "outside the media"),
        (FTYP + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", full(b"stco", u32(5, 1))))))) + box(b"mdat"), "cut short"),
        (b"", "0 mdat"),
    ],
)
def test_declined(data, reason):
    with pytest.raises(rewrites.Declined) as why:
        rewrites.rewritten(data)
    assert reason in str(why.value)


def test_rewrite_over_a_frame(spark):
    files = spark.createDataFrame([("a", movie()), ("b", b"junk"), ("c", None)], "file_id string, content binary")
    made = rewrites.rewrite(files, retag=True)
    rows = {r["file_id"]: r for r in made.collect()}
    assert rows["a"]["error"] is None and rows["b"]["content"] is None and rows["c"]["error"] == "no content" and rewrites.rewrite(files.limit(0)).count() == 0
    track = analysis.tracks(containers.boxes(made.where("error IS NULL"), payloads=True)).first()
    assert track["color"]["rec709"] and track["samples"] == 2 and track["timing_mode"] == "cfr"


def two_tracks(between, filler=0):
    """Two videos whose chunks lie in one mdat, with bytes between their traks; returns the file and where its media begins."""
    def trak(number, place):
        stbl = box(b"stbl", visual(b"avc1", box(b"avcC", AVC)), full(b"stts", u32(1, 1, 512)), full(b"stsz", u32(4, 1)), full(b"stco", u32(1, place)))
        return box(b"trak", tkhd(number), box(b"mdia", mdhd(15360, 512), hdlr(b"vide"), box(b"minf", stbl)))

    media = len(FTYP) + 8
    return FTYP + box(b"mdat", b"AAAABBBB") + box(b"moov", MVHD, trak(1, media), between, trak(2, media + 4))


def placed(data):
    (moov,) = [data[s : s + n] for kind, s, n, _, _ in containers.headers(data, 0, len(data)) if kind == "moov"]
    return [[data[o : o + 4] for o in table] for table in rewrites.offset_tables(moov)]


def test_many_boxes_within_moov_are_all_rewritten(spark):
    source = two_tracks(box(b"free") * 4200)
    made, moved, _ = rewrites.rewritten(source)
    assert placed(made) == placed(source) == [[b"AAAA"], [b"BBBB"]] and moved == 2
    frame = spark.createDataFrame([("f", len(source), source)], "file_id string, file_size long, content binary")
    assert analysis.tracks(containers.boxes(frame, payloads=True)).count() == 2


@pytest.mark.parametrize("between", [b"\0\0\0\4free", b"\x7f\xff\xff\xfffree", b"\0\0\0\1free"])
def test_a_malformed_index_is_declined_and_reported(spark, between):
    source = two_tracks(between)
    with pytest.raises(rewrites.Declined, match="malformed 'free' box at offset"):
        rewrites.rewritten(source)
    frame = spark.createDataFrame([("f", len(source), source)], "file_id string, file_size long, content binary")
    boxes = containers.boxes(frame, payloads=True)
    report = analysis.reports(frame, boxes).first()
    assert report["error"].startswith("malformed 'free' box at offset") and report["tracks"] == 0
    assert analysis.tracks(boxes).count() == 0 and boxes.where("error is not null").select("type").collect() == [("moov",)]
    assert analysis.tracks(containers.boxes(frame, payloads=True, strict=False)).count() == 1


def test_deep_nesting(spark):
    def nested(n):
        inner = b""
        for _ in range(n):
            inner = box(b"udta", inner)
        return FTYP + box(b"moov", inner)

    rows = spark.createDataFrame([(n, nested(n)) for n in (32, 33, 60)], "file_id int, content binary")
    found = {r["file_id"]: (r["n"], r["e"]) for r in containers.boxes(rows).groupBy("file_id").agg(F.count("*").alias("n"), F.min("error").alias("e")).collect()}
    assert found["32"] == (34, None) and found["33"][1].startswith("boxes are nested") and found["60"][0] == 2


@pytest.mark.parametrize("kind", [b"saio", b"iloc"])
def test_other_offsets_are_declined(kind):
    with pytest.raises(rewrites.Declined, match=kind.decode()):
        rewrites.rewritten(two_tracks(box(kind, u32(0, 1, 24))))
