"""Wide sums and descriptors against plain Python."""

import random
import struct
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.functions import descriptors
from reelframe.operators import exact


def test_timelines(spark):
    most = 2**32 - 1
    groups = {"a": [(1000, 512), (1, 7)], "wide": [(most, most)] * 5, "edge": [(2**26, 2**27 - 1), (2**26 - 1, 1)], "over": [(2**26, 2**27)], "none": [(0, 5), (5, 0)], "bad": [(most + 1, 1)], "minus": [(-1, 5), (9, 9)], "null": [(None, 1)]}
    rows = spark.createDataFrame([(k, *r) for k, runs in groups.items() for r in runs], "key string, count long, delta long")
    got = {r["key"]: (r["ticks"], r["error"]) for r in exact.timelines(rows, "key").collect()}
    want = {"a": (512007, None), "wide": (None, "too large"), "edge": (2**53 - 1, None), "over": (None, "too large"), "none": (None, "empty"), **dict.fromkeys(("bad", "minus", "null"), (None, "field out of range"))}
    assert got == want and exact.timelines(rows.limit(0), "key").count() == 0
    arrays = rows.where("key in ('a', 'wide', 'none')").groupBy("key").agg(F.collect_list(F.struct("count", "delta")).alias("runs"))
    assert {r["key"]: r["t"] for r in arrays.select("key", exact.timeline_of(F.col("runs")).alias("t")).collect()} == {k: Decimal(sum(a * b for a, b in groups[k])) for k in ("a", "wide", "none")}


def test_maximum_bitrates(spark):
    rng = random.Random(2)
    cases = [(k, [rng.randrange(2**32) for _ in range(5)], rng.choice([1, 44100, 2**32 - 1]), rng.choice([1, 48000, 2**40, 2**53 - 1])) for k in range(40)]
    cases += [(100, [2**32 - 1], 1, 8), (101, [2**29], 1, 1), (102, [2**29 - 1], 1, 1), (103, [5], 0, 5), (104, [5], 5, 0), (105, [-1], 1, 1), (106, [2**32], 1, 1), (107, [5], None, 1)]
    rows = spark.createDataFrame([(k, s, t, d) for k, sizes, t, d in cases for s in sizes], "key int, size long, t long, d long")
    got = {r["key"]: (r["bitrate"], r["error"]) for r in exact.maximum_bitrates(rows, "key", "size", F.max("t"), F.max("d")).collect()}
    for k, sizes, t, d in cases:
        if any(not 0 <= s < 2**32 for s in sizes):
            want = (None, "field out of range")
        elif not t or not d:
            want = (None, "no duration or clock")
        else:
            rate = 8 * sum(sizes) * t // d
            want = (rate, None) if rate < 2**32 else (None, "too large")
        assert got[k] == want, k


def length(n, form):
    return bytes([n >> 7 * k & 127 | (128 if k else 0) for k in reversed(range(form))])


def place(data):
    """Where the four bytes are, by a walk over the bytes; None if they are not there."""
    at = 4
    try:
        for tag in (3, 4):
            if data[at] != tag:
                return None
            at += 1
            for k in range(4):
                at += 1
                if data[at - 1] < 128:
                    break
                if k == 3:
                    return None
            if tag == 3:
                flags = data[at + 2]
                at += 3 + 2 * bool(flags & 128)
                at += 1 + data[at] if flags & 64 else 0
                at += 2 * bool(flags & 32)
    except IndexError:
        return None
    return at + 5 if at + 9 <= len(data) else None


def test_descriptors_of_every_form(spark):
    rows = []
    for one in (1, 2, 3, 4):
        for other in (1, 2, 3, 4):
            for flags in (0, 128, 64, 32, 224):
                body = struct.pack(">HB", 1, flags) + (b"dd" if flags & 128 else b"") + (b"\3url" if flags & 64 else b"") + (b"oo" if flags & 32 else b"")
                inner = b"\4" + length(23, other) + b"\x40\x15\0\0\0" + struct.pack(">II", 777, 888) + b"\5\2\x11\x90" + b"zz"
                whole = bytes(4) + b"\3" + length(len(body + inner), one) + body + inner
                rows += [whole, whole[: len(whole) // 2], whole[:-12]]
    rows += [b"", bytes(4), bytes(4) + b"\3\x80\x80\x80\x80\1" + bytes(30), bytes(4) + b"\5" + bytes(30), bytes(4) + b"\3\x80"]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, data binary")
    made = frame.select("k", descriptors.maximum_bitrate(F.col("data")).alias("old"), descriptors.with_maximum_bitrate(F.col("data"), F.lit(4_000_000_000)).alias("new"))
    for r in made.collect():
        data, at = rows[r["k"]], place(rows[r["k"]])
        assert r["old"] == (None if at is None else struct.unpack_from(">I", data, at)[0])
        assert bytes(r["new"]) == (data if at is None else data[:at] + struct.pack(">I", 4_000_000_000) + data[at + 4 :])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=60, max_size=60))
def test_descriptors_of_any_bytes(spark, tails):
    rows = [bytes(4) + b"\3" + t for t in tails]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, data binary")
    for r in frame.select("k", descriptors.maximum_bitrate_at(F.col("data")).alias("at")).collect():
        assert r["at"] == place(rows[r["k"]])


def test_box_bitrates(spark):
    frame = spark.createDataFrame([(bytes(range(12)),), (b"short",)], "data binary")
    assert [bytes(r[0]) for r in frame.select(descriptors.with_box_bitrate(F.col("data"), F.lit(258))).collect()] == [bytes(range(4)) + b"\0\0\1\2" + bytes(range(8, 12)), b"short"]
