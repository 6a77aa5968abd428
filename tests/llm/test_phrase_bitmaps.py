"""Collocations against phrases counted one by one."""

import random
import re
from collections import Counter

import pytest

from reelframe.llm import phrase_bitmaps


def brute(docs, least=10, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text), by the contract's words."""
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    rows = []
    for (lang, *words), a in candidates.items():
        cuts = [(10**6 * a * a // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if any(len(q) > len(words) + 1 and q[0] == lang and 100 * b >= 50 * a and any(list(q[i : i + len(words)]) == words for i in range(1, len(q))) for q, b in candidates.items()):
            continue
        rows.append((lang, -score, -a, " ".join(words).encode(), counts[(lang, *words[:k])], counts[(lang, *words[k:])]))
    out, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        seen[lang] += 1
        if seen[lang] <= first:
            out.append((lang, seen[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def found(spark, docs, **kwargs):
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    rows = phrase_bitmaps.collocations(frame, **kwargs).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


def made(seed):
    rng = random.Random(seed)
    kinds = ["new", "york", "city", "the", "a", "of", "Ünion", "ÉTAT", "x"]
    text = lambda n: "".join(rng.choice(kinds) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "\xa0"]) for _ in range(n))
    docs = [(rng.choice(["en", "fr", None, "und"]), text(rng.choice([0, 1, 3, 40]))) for _ in range(120)]
    return docs + [("en", "New York City new york city. " * 30), ("en", "of of of of of"), ("de", None), (None, None)]


@pytest.mark.parametrize("options", [{}, {"shard_words": 64}, {"shard_words": 300, "told": 0}, {"told": 60}, {"first": 3}, {"least": 2}])
def test_phrases_are_exact(spark, options):
    docs = made(len(options))
    want = brute(docs, options.get("least", 10), options.get("first", 2000))
    assert want and found(spark, docs, **options) == sorted(want)


def test_more_words_than_fit_half_a_long(spark, monkeypatch):
    monkeypatch.setattr(phrase_bitmaps, "PAIRED", 0)
    docs = made(9)
    assert found(spark, docs, shard_words=200) == sorted(brute(docs))


def test_bytes_and_pieces(spark):
    docs = [("en", "a" * 7 + " " + " ".join(["b c"] * 9)), ("en", "b,c" * 20), ("en", "b c " * 40 + "b"), ("fr", "q\x00r s\x85t " * 30)]
    assert found(spark, docs) == sorted(brute(docs))


def test_edges(spark):
    assert found(spark, []) == [] and found(spark, [("en", None), (None, ""), ("en", ".,;")]) == [] and found(spark, [("en", "rare words only")]) == []
    assert found(spark, [], told=0) == []
    frame = spark.createDataFrame([("en", "big deal " * 12, 3, 4, "x")] * 3, "lang string, text string, n int, rank int, word string")
    rows = phrase_bitmaps.collocations(frame).collect()
    assert {(r["phrase"], r["a"]) for r in rows} == {(p, a) for _, _, p, a, *_ in brute([("en", "big deal " * 12)] * 3)}
    long = [("en", "one two three " * 20_000)]
    assert found(spark, long, shard_words=500) == sorted(brute(long))


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9 * 10**14, 9 * 10**14, 10**15), (3_000_000_000, 4_000_000_000, 5_000_000_000), (10, 11, 12)], "a long, x long, y long")
    got = [r[0] for r in rows.select(phrase_bitmaps.score(rows["x"], rows["y"])).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in ((9 * 10**14, 9 * 10**14, 10**15), (3 * 10**9, 4 * 10**9, 5 * 10**9), (10, 11, 12))]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrase_bitmaps.collocations(docs).collect())
    assert {(x[0], x[2]): x[3] for x in rows} and len(rows) == len({x[:2] for x in rows})
