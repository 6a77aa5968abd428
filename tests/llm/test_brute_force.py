"""Naive counterparts of a ring, of Kneser-Ney probabilities and of a search for splits."""

import math
import random
import struct
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelframe.llm import char_models, quality_trees, ring_shards


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashed(*values):
    """Spark's xxhash64 of strings, ints and longs."""
    seed = 42
    for kind, v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack({"i": "<i", "l": "<q"}[kind], v), seed)
    return seed


@pytest.mark.parametrize(("shards", "n"), [(3, 50), (7, 1000), (24, 777)])
def test_ring_by_walking_row_by_row(spark, shards, n):
    rng = random.Random(n)
    rows = [(rng.randrange(-(1 << 62), 1 << 62), "t" * rng.randrange(40)) for _ in range(n)] + [(5, "one id"), (5, "one id"), (5, "another")]
    got = ring_shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards, vnodes=16).collect()

    nodes = {}
    for shard in range(shards):
        for replica in range(16):
            h = hashed(("s", "vnode"), ("i", shard), ("i", replica))
            cell = h >> 48
            if cell not in nodes or signed(h) < nodes[cell][0]:
                nodes[cell] = (signed(h), shard)
    ring = sorted((cell, shard) for cell, (_, shard) in nodes.items())
    cells = [cell for cell, _ in ring]
    room, taken, want = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)], [0] * shards, Counter()
    keyed = sorted((hashed(("l", i)) >> 48, signed(hashed(("l", i))), i, zlib.crc32(t.encode()), len(t.encode()) + 8) for i, t in rows)
    for cell, _, i, crc, size in keyed:
        k = bisect_left(cells, cell) % len(ring)
        while taken[ring[k][1]] >= room[ring[k][1]]:
            k = (k + 1) % len(ring)
        shard = ring[k][1]
        want[i, crc, size, shard, taken[shard]] += 1
        taken[shard] += 1
    assert Counter((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == want


def test_ring_with_very_many_rows_of_one_id(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = ring_shards.assign_shards(rows, 24).collect()
    loads = Counter(r["shard"] for r in got)
    assert len(got) == 3000 and max(loads.values()) == min(loads.values()) == 125
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(125)) for s in loads)


def naive_probability(grams, context, c, discount=0.75):
    """Of c behind context: interpolated Kneser-Ney by counting anew at each order; grams has counts of the highest order."""
    n = len(next(iter(grams)))
    levels = {n: dict(grams)}
    for k in range(n - 1, 0, -1):
        left = defaultdict(set)
        for gram in levels[k + 1]:
            left[gram[1:]].add(gram[0])
        levels[k] = {gram: len(x) for gram, x in left.items()}

    def p(k):
        level, h = levels[k], context[len(context) - k + 1 :] if k > 1 else ""
        followers = {g: v for g, v in level.items() if g[:-1] == h}
        total = sum(followers.values())
        if k == 1:
            return discount * len(followers) / total / (len(followers) + 1000) + max(followers.get(c, 0) - discount, 0) / total
        if not total:
            return p(k - 1)
        return max(followers.get(h + c, 0) - discount, 0) / total + discount * len(followers) / total * p(k - 1)

    return p(n)


def test_cross_entropies_by_naive_probabilities():
    rng = random.Random(3)
    for alphabet in ("abc", "abcdefghij", "añé"):
        texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(8)) for _ in range(6)]
        counts = Counter()
        for text in texts:
            padded = "   " + text + " "
            counts.update(padded[k : k + 4] for k in range(len(padded) - 3))
        models = char_models.Identifier(4, {"x": char_models.fit(dict(counts))}, {}, {})
        asked = [*texts[:2], "cab bac", "zzz a", "q", alphabet * 3]
        got, sizes = models.cross_entropies(asked)
        for k, text in enumerate(asked):
            padded = "   " + text + " "
            logs = [math.log(naive_probability(counts, padded[j - 3 : j], padded[j])) for j in range(3, len(padded))]
            assert sizes[k] == len(logs) and got[k, 0] == pytest.approx(-sum(logs) / len(logs), rel=1e-9)


def test_equal_languages_go_to_the_first(spark):
    rows = [(k, "some words that both have", lang) for k, lang in enumerate(["b", "a"] * 40)]
    docs = spark.createDataFrame([*rows, (900, "some words", "b"), (900, "some words", "b")], "doc_id long, text string, lang string")
    models = char_models.train(docs, F.lit(True))
    got = char_models.identify(docs, models).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and len(got) == 82
    again = [(r["score"], r["cross_entropy"]) for r in got if r["doc_id"] == 900]
    assert len(again) == 2 and again[0] == again[1]
    assert char_models.identify(docs.limit(0), models).count() == 0
    nothing = char_models.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in char_models.identify(docs, nothing).collect()} == {"und"}


def naive_tree(b, g, h, depth):
    """(feature, cut) of each node and the members of each leaf, by trying every cut of every feature."""
    nodes, here = {}, {0: list(range(len(b)))}
    for _ in range(depth):
        below = {}
        for node, members in here.items():
            best = (1e-9, 0, quality_trees.BINS)
            for f in range(b.shape[1]):
                for c in range(quality_trees.BINS):
                    left, right = [i for i in members if b[i, f] <= c], [i for i in members if b[i, f] > c]
                    if len(left) < quality_trees.LEAST or len(right) < quality_trees.LEAST:
                        continue
                    parts = [sum(g[i] for i in m) ** 2 / (sum(h[i] for i in m) + quality_trees.RIDGE) for m in (left, right, members)]
                    gain = parts[0] + parts[1] - parts[2]
                    if gain > best[0] + 1e-12:
                        best = (gain, f, c)
            nodes[node] = best
            below[2 * node + 1] = [i for i in members if b[i, best[1]] <= best[2]]
            below[2 * node + 2] = [i for i in members if b[i, best[1]] > best[2]]
        here = below
    return nodes, here


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_by_trying_all(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(160, 3)).round(1)
    y = (x[:, 0] + 0.7 * x[:, 1] * (x[:, 2] > 0) + rng.normal(size=160) * 0.4 > 0).astype(float)
    model = quality_trees.fit(x, y, trees=2, depth=2)
    b, raw = model.binned(x).astype(int), np.full(len(y), model.base)
    for t in range(2):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        nodes, leaves = naive_tree(b, g, h, 2)
        for node, (_, f, c) in nodes.items():
            mine = b[:, model.feature[t, node]] <= model.cut[t, node]
            assert (mine == (b[:, f] <= c)).all(), (t, node)  # two cuts may part the rows alike
        for leaf, members in leaves.items():
            value = -quality_trees.RATE * sum(g[i] for i in members) / (sum(h[i] for i in members) + quality_trees.RIDGE)
            assert model.value[t, leaf - 3] == pytest.approx(value, abs=1e-9)
            raw[members] += value
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(k, "words and words. " * (k % 5 + 1), 1) for k in range(200)] + [(7, "same", 1), (7, "same", 1), (8, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 5 > 2), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    trees = quality_trees.train(docs, labels, F.lit(True))
    got = quality_trees.score(docs, trees)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 203
    same = [r["score"] for r in got.where("text = 'same'").collect()]
    assert len(same) == 2 and same[0] == same[1]
    assert quality_trees.score(docs.limit(0), trees).count() == 0
    empty = quality_trees.train(docs.limit(0), labels, F.lit(True))
    assert {r["score"] for r in quality_trees.score(docs, empty).collect()} == {0.5}
