"""Byte-level BPE against the tiktoken library."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import hashed_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
LARGE = [2**53 + 1, 2**63 - 1, None, 0, None, -5, 2**53 + 3]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    cache = hashed_bpe.RankedCache.__new__(hashed_bpe.RankedCache)
    cache.__dict__ = hashed_bpe.ranked_cache(PATH, P.PATTERN).__dict__
    (coded,) = cache.encode([text])
    return [int.from_bytes(coded[k : k + 4], "little") for k in range(0, len(coded), 4)], cache.decode(coded)


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 3, 7, 5000):
        entries = [b"%d-%d" % (n, k) for k in range(n)]
        table = hashed_bpe.PerfectHash(entries)
        assert sorted(table.at.tolist()) == list(range(n))
        assert table.number(entries) == list(range(n))
        assert table.number([b"absent", b""]) == [-1, -1]
    whole = hashed_bpe.ranked_cache(PATH, P.PATTERN).whole
    assert len(whole.at) == len(whole.entries) == 50256 and whole.number(whole.entries) == list(range(50256))


def test_two_entries_with_one_hash_take_another_seed(monkeypatch):
    real = hashed_bpe.hashes
    monkeypatch.setattr(hashed_bpe, "hashes", lambda entries, seed: real([b"same"] * len(list(entries)), 0) if seed == 0 else real(entries, seed))
    table = hashed_bpe.PerfectHash([b"a", b"b", b"c"])
    assert table.seed == 1 and table.number([b"a", b"b", b"c", b"d"]) == [0, 1, 2, -1]
    with pytest.raises(ValueError, match="twice"):
        hashed_bpe.PerfectHash([b"a", b"a"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdmtlrev1Aé日\x00\x1c　\u0085😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(library, text):
    ids, back = ids_of(text)
    assert ids == library.encode_ordinary(text) and back == text.encode()


def test_long_words_and_ties(library):
    rng = random.Random(7)
    for text in ("a" * 30_000, "ab" * 5000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 3000 + "x", "\n" * 777, "'" * 500, "don't we'll I'M"):
        assert ids_of(text)[0] == library.encode_ordinary(text)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hashed_bpe.encode(docs, PATH, P.PATTERN, decoded=True).select("doc_id", "text", "ids", "decoded").collect()
    assert len(out) == 1000
    for r in out:
        want = library.encode_ordinary(r["text"] or "")
        assert [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)] == want
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_edges(spark):
    rows = [(LARGE[k], t, "x", k) for k, t in enumerate([None, "", "same text", "same text", "z" * 100_000, "  a  b ", "last"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").coalesce(1)
    out = hashed_bpe.encode(df, PATH, P.PATTERN, decoded=True)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    found = out.collect()
    assert [r["doc_id"] for r in found] == LARGE
    assert [bytes(r["decoded"]).decode() for r in found] == [t or "" for _, t, _, _ in rows]
    assert found[2]["ids"] == found[3]["ids"] and found[0]["ids"] == b""
    assert hashed_bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []
    again = hashed_bpe.decode(out.select("doc_id", "ids"), PATH, P.PATTERN).collect()
    assert [r["doc_id"] for r in again] == LARGE and bytes(again[5]["decoded"]) == b"  a  b "
