"""Ranked search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from reelframe.llm import block_max

LARGE = [2**53 + 1, 2**63 - 1, None, 0, None, -5, 2**53 + 3]


def brute(docs, queries, k=10):
    """(item, rank, id, score) by the contract's formula; docs and queries are (id, text)."""

    def terms(text):
        return re.findall(block_max.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    counted = [(name, Counter(found), len(found)) for name, text in docs if (found := terms(text))]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, times, _ in counted for t in times)
    out = []
    for item, text in queries:
        scores = []
        for name, times, n in counted:
            m = 100 - 75 + ((75 * n * n_docs) // n_words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * times[t]) // (1000 * times[t] + 8 * m)) for t in terms(text) if t in times)
            if s > 0:
                scores.append((-s, name is None, name or 0))
        out += [(item, rank, None if null else name, -s) for rank, (s, null, name) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, queries, blocks=3, **kwargs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = block_max.build_index(frame, block_documents=blocks)
    rows = block_max.search(index, spark.createDataFrame(queries, "item_id long, text string"), **kwargs).collect()
    index.remove()
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows], key=repr)


def words(rng, n, kinds=40):
    return " ".join(f"w{min(int(rng.expovariate(0.12)), kinds)}" for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_are_exact(spark, seed):
    rng = random.Random(seed)
    docs = [(k, words(rng, rng.choice([1, 5, 30, 200]))) for k in range(150)]
    docs += [(500 + k, docs[7][1]) for k in range(25)]  # ties
    queries = [(k, words(rng, rng.choice([1, 4, 12]))) for k in range(12)]
    assert found(spark, docs, queries) == brute(docs, queries)
    assert found(spark, docs, queries, k=3, cells=30, seeds=1) == brute(docs, queries, 3)


def test_edges(spark):
    docs = [*zip(LARGE, ["Alpha beta", "alpha BETA", "ÄLPHA alpha", "", None, "a-b_c\x00d alpha", "beta " * 5000]), (1, "... !"), (9, "alpha beta"), (9, "alpha beta")]
    queries = [(1, "alpha"), (1, "ALPHA alpha beta"), (2, None), (3, "??"), (None, "äLPHA"), (4, "absent"), (5, "b c"), (6, "beta")]
    assert found(spark, docs, queries) == brute(docs, queries)
    assert found(spark, docs, [(1, None)]) == [] and found(spark, [], queries) == [] and found(spark, docs, []) == []
    assert found(spark, [(k, None) for k in range(3)], queries) == []


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "alpha", 5, "x"), (2, "alpha beta", 6, "y")], "doc_id long, text string, score int, block string")
    queries = spark.createDataFrame([("q", "beta", 3, 4)], "name string, text string, rank int, query int")
    index = block_max.build_index(docs)
    rows = block_max.search(index, queries, item_col="name").collect()
    assert [(r["name"], r["rank"], r["doc_id"]) for r in rows] == [("q", 1, 2)]


def test_large_sums_use_integers():
    queries = block_max.Queries([0], [b"a"], np.array([[10**7]], np.int64))
    assert queries.weighed(np.array([1]), 10**6).dtype == np.int64
    assert block_max.Queries([0], [b"a"], np.array([[3]], np.int64)).weighed(np.array([1]), 10**6).dtype == np.float64


def test_blocks_below_the_threshold_are_not_scored(spark):
    rng = random.Random(3)
    docs = [(k, words(rng, 30) + (" needle" * 3 if k % 100 == 0 else "")) for k in range(2000)]
    index = block_max.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_documents=16)
    rows = index.blocks.toArrow()
    batch = rows.combine_chunks().to_batches()[0]
    (query,) = block_max.query_batches(spark.createDataFrame([(1, "needle")], "item_id long, text string"), "item_id", "text")
    vocab = block_max.pa.array(query.vocab, block_max.pa.binary())
    blocks = [block_max.Block(batch, k, vocab, query.weighed(np.array([20]), 2000), (index.documents, index.words)) for k in range(batch.num_rows)]
    best = block_max.Best(1, 10, np.zeros(1, np.int64))
    scored = block_max.best_first(blocks, best)
    assert len(blocks) == 125 and scored <= 20 and len(best.rows[0]) == 10


def test_bounds_hold(spark):
    rng = random.Random(5)
    docs = [(k, words(rng, rng.choice([2, 50]))) for k in range(100)]
    index = block_max.build_index(spark.createDataFrame(docs, "doc_id long, text string"), block_documents=8)
    batch = index.blocks.toArrow().combine_chunks().to_batches()[0]
    (query,) = block_max.query_batches(spark.createDataFrame([(k, words(rng, 5)) for k in range(9)], "item_id long, text string"), "item_id", "text")
    vocab = block_max.pa.array(query.vocab, block_max.pa.binary())
    for k in range(batch.num_rows):
        block = block_max.Block(batch, k, vocab, query.weighed(np.arange(1, len(query.vocab) + 1), 100), (index.documents, index.words))
        assert (block.scores(np.arange(9)).max(axis=1) <= block.bounds()).all()


def test_benchmark_of_the_tables(spark):
    docs, queries = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    index = block_max.build_index(docs)
    rows = sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in block_max.search(index, queries).collect()], key=repr)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in queries.collect()])
    assert rows == want
