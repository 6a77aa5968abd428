"""The rewrite with samples outside any box, against files that are built whole by a plain writer."""

import struct

import pytest
from pyspark.sql import functions as F

from reelframe.sources import containers, observed, trees
from test_trees import written

FTYP, MEDIA = written((b"ftyp", b"isom0000")), b"VVVVVVVVaaaaaaaaaaaabbbbbbbbbbbb"


def u32(*values):
    return b"".join(struct.pack(">I", v) for v in values)


def table(kind, *values, head=0):
    return (kind, u32(head, *values))


def esds(rate):
    inner = b"\4\x11\x40\x15\0\0\0" + u32(rate, 64_000) + b"\5\2\x11\x90"
    return (b"esds", bytes(4) + b"\3\x80\x80\x1a\0\1\0" + inner)


def track(number, handler, entry, tables, clock, edts=None):
    stbl = (b"stbl", [(b"stsd", [entry], u32(0, 1), b""), *tables])
    mdia = (b"mdia", [(b"mdhd", u32(0, 0, 0, *clock) + bytes(4)), (b"hdlr", bytes(8) + handler + bytes(13)), (b"minf", [stbl])])
    return (b"trak", [(b"tkhd", u32(0, 0, 0, number) + bytes(68)), *([(b"edts", [table(b"elst", 1, 5, 0)])] if edts else []), mdia])


def sound(number, sizes, chunks, clock, rate, pad=0, last=None, edts=None, version=0, runs=None):
    n = len(sizes)
    entry = (b"mp4a", [esds(rate), (b"btrt", u32(1, rate, 3))], bytes(8) + struct.pack(">H", version) + bytes(18 + {0: 0, 1: 16, 2: 36}[version]), b"")
    runs = runs or [(n, 1024)]
    stts = table(b"stts", len(runs) + bool(pad), *[x for r in runs for x in r], *((pad, 1) if pad else ()))
    stsz = table(b"stsz", 0, n + pad, *sizes, *[8] * pad)
    stsc = table(b"stsc", 1 + bool(pad), 1, n // len(chunks), 1, *((len(chunks) + 1, pad, 1) if pad else ()))
    stco = table(b"stco", len(chunks) + bool(pad), *chunks, *((last,) if pad else ()))
    return track(number, b"soun", entry, [stts, stsz, stsc, stco], clock, edts)


def made(tag=None, *, after=False, n=4, free=b"", edts=True, shift=0, clone=False, ilst=True, end=0, runs=None, version=0, sound_number=2):
    """A file, or what it becomes: with a clone, offsets moved by shift, and no edit lists."""
    sizes, ticks = [3] * n, sum(a * b for a, b in (runs or [(n, 1024)]))
    rate = 8 * sum(sizes) * 44100 // 5000 if clone else 9
    start = shift
    video = track(1, b"vide", (b"avc1", [(b"avcC", b"x")], bytes(78), b""), [table(b"stts", 1, 2, 512), table(b"stsz", 4, 2), table(b"stsc", 1, 1, 2, 1), table(b"stco", 1, start)], (600, 1024), edts and not clone)
    chunks = [start + 8, start + 20]
    plain = sound(sound_number, sizes, chunks, (44100, ticks if clone else 5000), rate, edts=edts and not clone, runs=runs, version=version)
    copy = [sound(sound_number + 1, sizes, chunks, (44100, ticks + 9 * n), rate, 9 * n, end, runs=runs, version=version)] if clone else []
    tags = [(b"\xa9too", [(b"data", u32(1, 0) + tag.encode())])] if clone and tag is not None else [(b"\xa9too", [(b"data", u32(1, 0) + b"old")])]
    udta = [(b"udta", [(b"meta", [(b"hdlr", bytes(25)), (b"ilst", tags)], bytes(4), b"")])] if ilst else []
    mvhd = (b"mvhd", bytes(96) + u32(sound_number + 2 if clone else 77))
    return (b"moov", [mvhd, video, plain, *copy, *udta])


def source(free=b"", after=False, media=MEDIA, **options):
    """The bytes of a file: index before or behind the media."""
    begins = len(FTYP) + 8 + (len(free) if not after else 0) + (0 if after else len(written(made(**options))))
    index = written(made(shift=begins, **options))
    mdat = written((b"mdat", media))
    return FTYP + (mdat + index + free if after else free + index + mdat)


def target(tag=None, n=4, **options):
    index = len(written(made(tag, n=n, clone=True, **options)))
    begins = len(FTYP) + index + 8
    return FTYP + written(made(tag, n=n, clone=True, shift=begins, end=begins + len(MEDIA), **options)) + written((b"mdat", MEDIA)) + bytes.fromhex("0000000400000000") * (9 * n)


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file_id string, content binary")


CASES = [({}, {}), ({"after": True}, {}), ({"free": written((b"free", b"123")) + written((b"wide", b""))}, {}), ({"n": 8}, {"n": 8}), ({"edts": False}, {"edts": False}), ({"ilst": False}, {"ilst": False}), ({"runs": [(1, 5), (3, 7)]}, {"runs": [(1, 5), (3, 7)]}), ({"version": 1}, {"version": 1}), ({"version": 2}, {"version": 2}), ({"sound_number": 90_000}, {"sound_number": 90_000})]


@pytest.mark.parametrize("tag", [None, "a tag"])
def test_bytes_of_whole_files(spark, tag):
    files = frame(spark, {str(k): source(**a) for k, (a, _) in enumerate(CASES)})
    rows = observed.transform(files, tag)
    out = {r["file_id"]: bytes(r["content"]) for r in observed.whole(rows, files).collect()}
    for k, (_, b) in enumerate(CASES):
        assert out[str(k)] == target(tag, **b), k
    said = {r["file_id"]: r for r in rows.drop("front").collect()}
    assert all((r["classification"], r["compliant"], r["validation"], r["error"]) == ("OBSERVED", False, "NOT APPROVED", None) for r in said.values())
    assert said["0"]["pad_samples"] == 36 and said["0"]["pad_bytes"] == 288 and said["0"]["cloned_track"] == 3 and said["0"]["edit_lists_removed"] == 2 and said["4"]["edit_lists_removed"] == 0
    assert said["2"]["dropped"] == ["free", "wide"] and said["0"]["dropped"] == []
    assert said["1"]["offset_shift"] > 0 and said["9"]["cloned_track"] == 90_001


def _with(data, old, new, count=1):
    assert data.count(old) >= 1
    return data.replace(old, new, count)


def test_reasons_for_declining(spark):
    good = source()
    stsz = u32(0, 0, 4, 3, 3, 3, 3)
    files = {
        "unknown-boxes": good + written((b"uuid", b"x")), "not-one-of-each": good + written((b"mdat", b"x")), "trailing-bytes": good + b"1234", "damaged-index": _with(good, u32(24) + b"elst", u32(250) + b"elst"),
        "wide-offsets": _with(good, b"stco", b"co64"), "inexact-offsets": _with(good, b"stco" + u32(0, 1), b"stco" + u32(0, 0)), "no-video": _with(good, b"vide", b"text"), "not-one-audio": _with(good, b"soun", b"text"), "not-aac": _with(good, b"mp4a", b"ac-3"),
        "uniform-sizes": _with(good, stsz, u32(0, 3, 4, 3, 3, 3, 3)), "no-samples": _with(good, stsz, u32(0, 0, 0, 3, 3, 3, 3)), "inexact-sizes": _with(good, stsz, u32(0, 0, 2**32 - 1, 3, 3, 3, 3)),
        "inexact-runs": _with(good, b"stts" + u32(0, 1, 4, 1024), b"stts" + u32(0, 2, 4, 1024)), "empty-timeline": _with(good, u32(4, 1024), u32(4, 0)), "no-clock": _with(good, u32(44100, 5000), u32(0, 5000)),
        "no-sample-table": _with(good, b"stsc" + u32(0, 1, 1, 2, 1) + u32(24), b"free" + u32(0, 1, 1, 2, 1) + u32(24)), "no-header": _with(good, b"mvhd", b"free"), "no-number-left": source(sound_number=2**32 - 2), "offset-outside-media": _with(good, b"stco" + u32(0, 1) + u32(len(good) - len(MEDIA)), b"stco" + u32(0, 1) + u32(3)),
        "high-bitrate": _with(good, u32(44100, 5000), u32(2**32 - 1, 1)), "null": None,
    }
    got = {r["file_id"]: (r["error"], r["front"], r["pad_samples"]) for r in observed.transform(frame(spark, files)).collect()}
    assert got.pop("null")[0] == "not-one-of-each"
    assert {k: v[0] for k, v in got.items()} == {k: k for k in got} and all(v[1:] == (None, None) for v in got.values())
    assert observed.transform(frame(spark, {"a": good}).limit(0)).count() == 0


def test_limits_before_any_table_is_unpacked(spark):
    """A payload that declares 2^32-1 entries is judged by its length alone."""
    rows = spark.createDataFrame([(n, e, u32(0, e, n) + bytes(length)) for n, e, length in ((2**32 - 1, 0, 0), (2**32 - 1, 5, 0), (0, 0, 0), (3, 0, 12), (3, 0, 11), (3, 0, 16), (300_000, 0, 1_200_000))], "n long, e long, data binary")
    assert [r[0] for r in rows.select(observed.size_error(F.col("data"))).collect()] == ["inexact-sizes", "uniform-sizes", "no-samples", None, "inexact-sizes", "inexact-sizes", "too-many-samples"]
    tables = {"n": u32(0, 2**32 - 1), "m": u32(0, 0, 2**32 - 1)}
    got = {k: v for k, v in frame(spark, tables).select("file_id", F.size(observed.binary.read_stts(F.col("content")))).collect()}
    assert got == {"n": 0, "m": 0}


@pytest.mark.parametrize("n", [1, 2, 1000, 100_000])
def test_tables_grow_by_closed_forms(spark, n):
    sizes = [k % 50 + 1 for k in range(n)]
    row = spark.createDataFrame([(u32(0, 2, n - 1, 5, 1, 6), u32(0, 0, n, *sizes), u32(0, 1, 1, n, 1), u32(0, 1, 99))], "stts binary, stsz binary, stsc binary, stco binary")
    pad = F.lit(9 * n).cast("long")
    got = row.select(observed.grown_runs(F.col("stts"), pad), observed.grown_sizes(F.col("stsz"), pad), observed.grown_chunks(F.col("stsc"), F.lit(1).cast("long"), pad), observed.grown_offsets(F.col("stco"))).first()
    assert [bytes(x) for x in got] == [u32(0, 3, n - 1, 5, 1, 6, 9 * n, 1), u32(0, 0, 10 * n, *sizes, *[8] * (9 * n)), u32(0, 2, 1, n, 1, 2, 9 * n, 1), u32(0, 2, 99, 0)]


def test_chunks_lead_to_the_same_bytes(spark):
    files = frame(spark, {"a": source(after=True)})
    (out,) = [bytes(r["content"]) for r in observed.whole(observed.transform(files), files).collect()]
    nodes = trees.parts(frame(spark, {"a": out})).where("type = 'stco'").orderBy("path").collect()
    places = [struct.unpack(f">{(len(r['payload']) - 8) // 4}I", bytes(r["payload"])[8:]) for r in nodes]
    assert [out[p : p + 3] for t in places for p in t[:2]][1:5] == [b"aaa", b"bbb", b"aaa", b"bbb"] and max(t[-1] for t in places) == len(out) - 288
    assert [h[0] for h in containers.headers(out, 0, len(out))] == ["ftyp", "moov", "mdat"]
