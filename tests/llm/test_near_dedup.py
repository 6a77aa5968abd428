"""The pipeline's near-duplicates against brute-force Jaccard similarity of word shingles."""

from collections import Counter

import pytest

import corpus_pipeline
from reelframe.llm import near_dedup


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows):
    """The smallest id of each id's group, by counting the shingles that every two distinct sets share."""
    ids, holders, parent = {}, {}, {}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = {i: shingle_set(t) for i, t in rows}
    for i in sorted(sets):
        parent[i] = ids.setdefault(sets[i], i)
    for i in ids.values():
        shared = Counter()
        for s in sets[i]:
            shared.update(holders.get(s, ()))
            holders.setdefault(s, []).append(i)
        for j, n in shared.items():
            if 9 * n >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_near_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == want
    left = corpus_pipeline.near(spark, docs, "")
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(want.values())


@pytest.mark.parametrize("pivots", [0, 2])
def test_near_stage_chains_and_odd_rows(spark, pivots):
    words = [f"w{k}" for k in range(200)]
    chain = [(k, " ".join(words[k * 5 : k * 5 + 100])) for k in range(12)]  # neighbours share 91 of 101 shingles, the ends few
    passage = " ".join(f"p{k}" for k in range(30))
    odd = [(100 + k, f"{passage} " + " ".join(f"d{k}x{j}" for j in range(40))) for k in range(30)]
    rows = [*chain, *odd, (200, None), (201, " \n"), (202, "two words"), (203, "Two  WORDS"), (204, "two")]
    docs = spark.createDataFrame([*rows, (None, "two words")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, pivots=pivots).collect()} == brute_groups(rows)
    left = [r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()]
    assert sorted(str(i) for i in left) == sorted(["None", "0", "200", "202", "204", *(str(i) for i, _ in odd)])
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_blocks_of_short_and_long_members(spark, monkeypatch):
    """Many holders of one passage, some near each other and some not, in blocks of four and with sets that do not fit."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    passage = " ".join(f"p{k}" for k in range(36))
    rows = [(k, f"{passage} " + " ".join(f"d{k // 3}x{j}" for j in range(3 + k % 7))) for k in range(60)]
    rows += [(500 + k, " ".join(f"q{(k * 7 + j) % 97 if j % 30 == 0 else j}" for j in range(90))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert 2 < len(set(want.values())) < len(rows)
    for whole in (2048, 38, 4):
        monkeypatch.setattr(near_dedup, "WHOLE", whole)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, small_bucket=4).collect()} == want


def test_shared_counts_and_forests():
    import numpy as np

    rng = np.random.default_rng(1)
    one, other = ([np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(n)] for n in (7, 9))
    assert near_dedup._shared(one, other).tolist() == [[len(np.intersect1d(a, b)) for b in other] for a in one]
    linked = np.zeros((4, 4), bool)
    for i, j in ((3, 0), (2, 0), (2, 1), (1, 1)):  # a path through all but row 0
        linked[i, j] = True
    row, column = near_dedup._forest(linked)
    assert row.tolist() == [0, 1, 1, 1] and column.tolist() == [1, 1, 4, 4]


@pytest.mark.parametrize(("small", "whole"), [(2, 2048), (5, 8)])
def test_pairs_that_share_rare_and_common_shingles(spark, monkeypatch, small, whole):
    """Texts of passages of very different numbers of holders, edited in some words: links meet in small and in large buckets."""
    import random

    rng = random.Random(small)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "WHOLE", whole)
    passages = [" ".join(f"p{k}w{j}" for j in range(rng.randint(6, 30))) for k in range(14)]
    bases = [[rng.choice(passages[: 1 + int(rng.expovariate(0.3))] or passages) for _ in range(rng.randint(3, 6))] for _ in range(30)]
    rows = []
    for k in range(180):
        words = " ".join(rng.choice(bases)).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(6)}"
        rows.append((k, " ".join(words + [f"t{rng.randrange(3)}"] * rng.randint(0, 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert 5 < len(set(want.values())) < 150
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, pivots=0, small_bucket=small).collect()} == want
