"""Every query with SQL against DuckDB, and timing by hand-made runs."""

import duckdb
import pandas as pd
import pytest

from reelframe import media_queries, registry
from reelframe.functions import binary
from reelframe.operators import timing
from reelframe.sources import containers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    """A value as text; whole numbers alike whether or not a null in their column has made them floats."""
    if pd.isna(v):
        return "N"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def plain(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(map(shown, row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize(
    ("runs", "mode", "reference", "dominant"),
    [
        ([(60, 512)], "cfr", 512, 512),
        ([(96, 512), (4, 2048)], "near-cfr", 512, 512),
        ([(199, 512), (1, 9000)], "cfr", 512, 512),
        ([(95, 512), (5, 9000)], "near-cfr", 512, 512),
        ([(1, 100), (1, 300), (1, 900)], "vfr", 300, 100),
        ([(10, 0), (10, 512)], "vfr", 512, 0),
        ([(5, 0)], "vfr", 0, 0),
        ([(5, 100), (5, 200)], "vfr", 100, 100),
        ([(1, 33), (2, 34), (0, 5)], "cfr", 34, 34),
    ],
)
def test_timing_cases(spark, runs, mode, reference, dominant):
    df = spark.createDataFrame([("f", k, d, n) for k, (n, d) in enumerate(runs)], "key string, ord long, delta long, n long")
    r = timing.summarize(timing.histogram(df)).first()
    assert (r["mode"], r["reference"], r["dominant"]) == (mode, reference, dominant)


def test_declared_counts_beyond_the_payload(spark):
    row = spark.createDataFrame([(bytes.fromhex("00000000" "000003e8" "00000002" "00000010"), bytes.fromhex("00000000" "00000000" "000003e8" "00000007"))], "a binary, b binary")
    r = row.select(binary.read_stts(row["a"]).alias("a"), binary.read_stsz(row["b"]).alias("b")).first()
    assert [(x["count"], x["delta"]) for x in r["a"]] == [(2, 16)] and (r["b"]["count"], r["b"]["total"]) == (1000, 7)


def test_box_sizes():
    free = b"\0\0\0\x08free"
    assert [h[0] for h in containers.headers(free + b"\0\0\0\0mdatxx", 0, 18)] == ["free", "mdat"]
    large = b"\0\0\0\x01mdat" + (18).to_bytes(8, "big") + b"xx"
    assert list(containers.headers(large, 0, 18)) == [("mdat", 0, 18, 16, True)]
    assert list(containers.headers(b"\0\0\0\x07free", 0, 8)) == [] and list(containers.headers(b"\0\0\0\xffmdat", 0, 8)) == []
