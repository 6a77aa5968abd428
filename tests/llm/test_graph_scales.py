"""Neighbours of vectors with offsets, of very large and small scale, in clusters, in many cells; clashing columns."""

import numpy as np
import pytest

from reelframe.llm import pruned_graph

RNG = np.random.default_rng(5)
BASE = RNG.normal(size=(1500, 12))
CASES = {
    "plain": BASE,
    "offset": BASE + 10_000,
    "huge": BASE * 1e25,
    "beyond squares": BASE * 1e200,
    "tiny": BASE * 1e-25,
    "below squares": BASE * 1e-250,
    "one outlier": np.vstack([BASE[:-1], np.full((1, 12), 1e25)]),
    "clusters": np.repeat(BASE[:15] * 100, 100, axis=0) + BASE * 0.01,
}


def nearest(x, q, k):
    d = pruned_graph.distances(x, x[q])
    return [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]


@pytest.mark.parametrize("case", sorted(CASES))
def test_recall(spark, case):
    x = CASES[case]
    df = spark.createDataFrame([(k, v.tolist(), k % 3, "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, shard string")
    index, cells = pruned_graph.build_index(df, shard_vectors=120, fit_vectors=600)
    assert len(cells[12].points) > 4 and cells[12].ids.sum() == len(x)
    got = {}
    for r in pruned_graph.search(index, cells, df.where("vec_id % 100 = 0"), probes=2, query_block=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in range(0, len(x), 100):
        best = nearest(x, q, 10)
        assert sorted(got[q]) == list(range(1, 11))
        assert all(s == pruned_graph.distances(x[i : i + 1], x[q])[0] for i, s in got[q].values())
        hit += len({i for i, _ in best} & {i for i, _ in got[q].values()})
    assert hit >= 0.9 * 10 * len(got)


def test_fewer_candidates_than_asked_for(spark):
    x = BASE[:60]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, cells = pruned_graph.build_index(df, k=70, shard_vectors=7, fit_vectors=60)
    got = pruned_graph.search(index, cells, df.where("vec_id = 3"), k=70, probes=1).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == nearest(x, 3, 70)  # all the others, in order
