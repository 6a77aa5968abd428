"""Trees of boxes as rows against a plain writer of nested lists."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from reelframe.sources import trees


def written(node):
    """The bytes of (type, payload or list of nodes[, bytes before them, bytes behind them])."""
    kind, body, *edges = node
    if isinstance(body, list):
        before, after = edges or (b"", b"")
        body = before + b"".join(map(written, body)) + after
    return struct.pack(">I4s", len(body) + 8, kind) + body


def generated(rng, depth=0):
    kinds = [b"trak", b"mdia", b"edts", b"udta", b"minf"] if depth < 6 else []
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice([*kinds, b"free", b"stts", b"a\xa9\x01b", b"stco"])
        if kind in kinds:
            out.append((kind, generated(rng, depth + 1), b"", bytes(rng.randint(0, 7))))
        else:
            out.append((kind, rng.randbytes(rng.randint(0, 30))))
    return out


def edited(nodes, drop, tag=None, inside=b"moov"):
    """A tree without the boxes `drop` in a trak, and with a tag in each ilst."""
    out = []
    for kind, body, *edges in nodes:
        if kind == drop and inside == b"trak":
            continue
        if isinstance(body, list):
            body = edited(body, drop, tag, kind)
            if tag is not None and kind == b"ilst":
                new = (b"\xa9too", [(b"data", b"\0\0\0\1\0\0\0\0" + tag)])
                body = [new if k == b"\xa9too" else (k, *r) for k, *r in body] if any(k == b"\xa9too" for k, *_ in body) else [*body, new]
        out.append((kind, body, *edges))
    return out


def frame(spark, contents):
    return spark.createDataFrame([(str(k), c) for k, c in enumerate(contents)], "file_id string, content binary")


def bytes_of(nodes):
    return {r["file_id"]: bytes(r["content"]) for r in trees.assembled(nodes).collect()}


def test_apart_and_together_and_without_edit_lists(spark):
    rng = random.Random(4)
    made = [(b"moov", generated(rng)) for _ in range(40)] + [(b"moov", [])]
    nodes = trees.parts(frame(spark, [written((b"ftyp", b"isom")) + written(m) for m in made]))
    assert bytes_of(nodes) == {str(k): written(m) for k, m in enumerate(made)}
    assert bytes_of(trees.without_edit_lists(nodes)) == {str(k): written((b"moov", edited(m[1], b"edts"))) for k, m in enumerate(made)}
    sizes = {(r["file_id"], r["path"]): r["size"] for r in trees.measured(nodes).collect()}
    assert len(sizes) == nodes.count() and all(sizes[str(k), "moov[1]"] == len(written(m)) for k, m in enumerate(made))


@pytest.mark.parametrize("tag", ["", "Größe 1"])
def test_encoder_tags(spark, tag):
    def meta(*tags, before=b"\0\0\0\0"):
        return (b"moov", [(b"udta", [(b"meta", [(b"hdlr", bytes(25)), (b"ilst", list(tags))], before, b"")])])

    old, other = (b"\xa9too", [(b"data", b"\0\0\0\1\0\0\0\0old")]), (b"\xa9nam", [(b"data", b"x")])
    made = [meta(old, other), meta(other), meta(), meta(old, other, old), (b"moov", [(b"udta", [(b"free", b"")])]), meta(other, old, before=b"")]
    nodes = trees.tagged_encoder(trees.parts(frame(spark, map(written, made))), tag)
    want = {str(k): written((b"moov", edited(m[1], None, tag.encode()))) for k, m in enumerate(made)}
    assert bytes_of(nodes) == want


def test_insert_replace_copy(spark):
    trak = (b"trak", [(b"tkhd", b"1234"), (b"mdia", [(b"free", b"")])])
    nodes = trees.parts(frame(spark, [written((b"moov", [(b"mvhd", b"v"), trak, (b"udta", [(b"free", b"")])]))]))
    roots = spark.createDataFrame([("0", "moov[0]/trak[1]", "moov[0]/trak[+]", 1.5)], "file_id string, path string, copy string, place double")
    nodes = nodes.unionByName(trees.copied(nodes, roots))
    nodes = trees.replaced(nodes, spark.createDataFrame([("0", "moov[0]/trak[+]/tkhd[0]", b"5678")], "file_id string, path string, payload binary"))
    nodes = trees.added(nodes, spark.createDataFrame([("0", "moov[0]/udta[2]", "skip", -1.0, b"s")], "file_id string, parent string, type string, place double, payload binary"))
    copy = (b"trak", [(b"tkhd", b"5678"), trak[1][1]])
    assert bytes_of(nodes) == {"0": written((b"moov", [(b"mvhd", b"v"), trak, copy, (b"udta", [(b"skip", b"s"), (b"free", b"")])]))}
    inside = trees.within(nodes, spark.createDataFrame([("0", "moov[0]/trak[+]")], "file_id string, path string"))
    assert inside.count() == 4


def test_large_boxes_are_measured_without_their_bytes(spark):
    rows = [("f", "mdat[0]", "", 0, 0.0, "mdat", None, None, None, None, 2**32 - 9), ("f", "mdat[1]", "", 0, 1.0, "mdat", None, None, None, None, 2**32 - 8), ("f", "moov[2]", "", 0, 2.0, "moov", None, None, None, None, None), ("f", "moov[2]/free[0]", "moov[2]", 1, 0.0, "free", None, None, None, None, 2**33)]
    nodes = spark.createDataFrame(rows, trees.NODES + ", length long")
    sizes = {r["path"]: r["size"] for r in trees.measured(nodes).collect()}
    assert sizes == {"mdat[0]": 2**32 - 1, "mdat[1]": 2**32 + 8, "moov[2]/free[0]": 2**33 + 16, "moov[2]": 2**33 + 32}


def test_damaged_and_empty(spark):
    files = spark.createDataFrame([("a", written((b"moov", b"\0\0\0\4free"))), ("b", None), ("c", b"")], "file_id string, content binary")
    nodes = trees.parts(files)
    assert [(r["file_id"], r["error"][:9]) for r in nodes.collect()] == [("a", "malformed")]
    for edit in (trees.without_edit_lists, lambda n: trees.tagged_encoder(n, "x")):
        assert edit(nodes).count() == 1 and trees.assembled(edit(nodes)).count() == 0
    assert trees.assembled(nodes.limit(0)).count() == 0 and trees.measured(nodes.limit(0)).count() == 0


def test_entries_of_sample_descriptions(spark):
    def stsd(*entries):
        return (b"moov", [(b"stbl", [(b"stsd", struct.pack(">II", 0, len(entries)) + b"".join(map(written, entries)))])])

    esds, btrt = (b"esds", b"e" * 20), (b"btrt", b"b" * 12)
    sound = [(b"mp4a", [esds, btrt], bytes(8) + struct.pack(">H", v) + bytes(18 + extra), b"") for v, extra in ((0, 0), (1, 16), (2, 36))]
    made = [stsd(s) for s in sound] + [stsd((b"avc1", [(b"avcC", b"x")], bytes(78), b"123")), stsd((b"tx3g", b"whole")), stsd((b"mp4a", b"short")), stsd()]
    nodes = trees.parts(frame(spark, map(written, made)), entries=True)
    assert bytes_of(nodes) == {str(k): written(m) for k, m in enumerate(made)}
    kinds = {r["file_id"]: r["n"] for r in nodes.where(F.col("type").isin("esds", "btrt", "avcC")).groupBy("file_id").count().withColumnRenamed("count", "n").collect()}
    assert kinds == {"0": 2, "1": 2, "2": 2, "3": 1}
