"""All operators on ids beyond 2^53 with nulls in one batch, and on very many rows of one id."""

from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from reelframe.llm import bit_planes, block_max, char_models, exact_dedup, hashed_bpe, quality_trees, ring_shards, secret_scan, simhash_trees, tier_packing, transducer_bpe

IDS = [2**53 + 1, 2**63 - 1, None, 2**53 + 3, None, -(2**63), 2**53]
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {k} of this table with some words", "en", i) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, other long").coalesce(1)


def ids_of(frame, column="doc_id"):
    return Counter(r[0] for r in frame.select(column).collect())


def test_every_operator_keeps_ids(spark, docs):
    want = Counter(IDS)
    assert ids_of(exact_dedup.mark_duplicates(docs)) == want
    encoded = transducer_bpe.encode(docs, WORDS, decoded=True)
    assert ids_of(encoded) == want and ids_of(encoded, "other") == want
    named = char_models.identify(docs, char_models.train(docs, F.lit(True)))
    assert ids_of(named) == want and ids_of(named, "other") == want
    assert ids_of(tier_packing.pack(docs, BYTES).where("start = 0")) == want
    near = simhash_trees.near_duplicates(docs)
    assert ids_of(near) == want and ids_of(near, "component_id") == want
    assert ids_of(secret_scan.scan(docs)) == want
    assert ids_of(ring_shards.assign_shards(docs, 3)) == want
    trees = quality_trees.train(docs, spark.createDataFrame([(i, 1, 0) for i in IDS], "doc_id long, quality int, toxic int"), F.lit(True))
    scored = quality_trees.score(docs, trees)
    assert ids_of(scored) == want and ids_of(scored, "other") == want
    assert ids_of(hashed_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)) == want
    found = block_max.search(block_max.build_index(docs), spark.createDataFrame([(2**53 + 1, "text")], "item_id long, text string"))
    assert ids_of(found) == want and ids_of(found, "item_id") == Counter({2**53 + 1: 7})


def test_near_fingerprints_are_not_joined_by_rounded_ids(spark):
    pair = spark.createDataFrame([(2**53, "one text of its own"), (2**53 + 1, "another with other words here"), (None, "a third one")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in simhash_trees.near_duplicates(pair).collect()}
    assert got == {2**53: 2**53, 2**53 + 1: 2**53 + 1, None: None}


def test_token_files_in_order(spark, docs, tmp_path):
    bit_planes.write_tokens(docs, str(tmp_path / "store"), WORDS, end_id=2)
    rows = sorted(bit_planes.read_tokens(spark, str(tmp_path / "store")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, *sorted(i for i in IDS if i is not None)]


def test_token_files_of_one_id_spread(spark, tmp_path):
    """Nine tenths of the rows have no id and one text; no task writes more than its share."""
    rows = [(None if k % 10 else k, None if k % 10 else f"text {k}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins what is small
    try:
        bit_planes.write_tokens(df, str(tmp_path / "store"), WORDS, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in spark.read.parquet(str(tmp_path / "store")).groupBy("part").agg(F.sum(F.size("ids_of")).alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    found = bit_planes.read_tokens(spark, str(tmp_path / "store")).collect()
    assert ids_of(bit_planes.read_tokens(spark, str(tmp_path / "store"))) == Counter(r[0] for r in rows)
    ends = sorted((r["start"], r["start"] + len(r["ids"]) // 4) for r in found)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
