"""BPE, token files and packing against the tokenizers library."""

import hashlib
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelframe.llm import bit_planes, piece_cache, tier_packing, transducer_bpe
from reelframe.llm.common import new_path

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "\t\ttab\tbed", "It's we'll I'd they've 'S 'tis", "Ünïcödé ΣΑΣ İstanbul ß", "é café ẛ̣", "日本語 テキスト", "x<|endoftext|>y <|startoftext|> z",
    "<|endoftext|>", "a\x1cb", "a\x00b \x00", " nbsp em", "12345 67,89.0", "!!!,,,...", "word, word. word; (word)", "$$$ %%% &&&", "a," * 50, "no" * 400, "q̣́" * 60, "😀 emoji 👩‍👩‍👧", "\r\n\r\n", " .", "x .", ". x", "  line",
]


def expected(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_pieces_give_the_ids_of_whole_texts(path):
    _, ids = expected(path, ODD)
    assert [array("I", x).tobytes() for x in ids] == list(piece_cache.LibraryCache(path).encode(ODD))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list(" \n\t,.'<|>aeéΣ\x1c")), max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    for path in (WORD, BYTE):
        _, ids = expected_cached(path, texts)
        assert [array("I", x).tobytes() for x in ids] == list(piece_cache.library_cache(path).encode(texts))


def test_transducer_agrees_with_the_library_on_every_character():
    cache = transducer_bpe.TransducerCache(transducer_bpe.vocabulary(WORD), transducer_bpe.Transducer.compiled({"a": transducer_bpe.vocabulary(WORD).merged("a")}))
    library = expected(WORD, [])[0]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}b" for c in points[at : at + 50_000]]
        want = [array("I", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert want == list(cache.encode(texts))
        cache.known.clear()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list(" \n\t,.'<|>aeéΣ\x1c\u0558\u1c89\ua7cb\u0301")) | st.characters(categories=["Cn"]), max_size=40), min_size=1, max_size=4))
def test_transducer_agrees_with_the_library_on_any_text(texts):
    cache = transducer_bpe.TransducerCache(transducer_bpe.vocabulary(WORD), transducer_bpe.Transducer.compiled({"a": transducer_bpe.vocabulary(WORD).merged("a")}))
    assert [array("I", x).tobytes() for x in expected_cached(WORD, texts)[1]] == list(cache.encode(texts))


_loaded = {}


def expected_cached(path, texts):
    t = _loaded.setdefault(path, None) or expected(path, [])[0]
    _loaded[path] = t
    return t, [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(piece_cache, "KEPT", 3)
    monkeypatch.setattr(piece_cache, "BATCH_CHARS", 10)
    _, ids = expected(BYTE, ODD)
    assert [array("I", x).tobytes() for x in ids] == list(piece_cache.LibraryCache(BYTE).encode(ODD))


def test_transducer_finds_its_words_and_no_others(tmp_path):
    words = {"a": [1], "ab": [2, 3], "abcing": [4], "xbcing": [5, 6, 7], "é": [8], "zebra": [9]}
    built = transducer_bpe.Transducer.compiled(words)
    (tmp_path / "t").write_bytes(built.to_bytes())
    read = transducer_bpe.Transducer.mapped(str(tmp_path / "t"))
    assert isinstance(read.keys.base, np.memmap) or isinstance(read.keys, np.memmap)
    ranks = read.ranks([*words, "b", "abc", "", "zebras", "ê"])
    got = [read.ids[read.offsets[r] : read.offsets[r + 1]].tolist() for r in ranks[: len(words)]]
    assert got == list(words.values()) and (ranks[len(words) :] == -1).all()
    assert len(built.ends) < sum(map(len, words)) + 1  # suffixes are shared
    assert (transducer_bpe.Transducer.compiled({}).ranks(["a"]) == -1).all()


def test_merges_are_exact_for_long_words():
    v = transducer_bpe.vocabulary(WORD)
    t = Tokenizer.from_file(WORD)
    for word in ("nothing" * 30, "a" * 500, "thethethe" * 20 + "q"):
        assert v.merged(word) == t.encode(word, add_special_tokens=False).ids


def test_encode_and_decode(spark):
    rows = [(k, x, "e") for k, x in enumerate(ODD)] + [(900, None, "e"), (None, "null id", "e"), (1, "\n", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    t, ids = expected(WORD, [x or "" for _, x, _ in rows])
    out = transducer_bpe.decode(transducer_bpe.encode(df, WORD, size=20), WORD)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    want = sorted((str(k), array("I", i).tobytes(), t.decode(i, skip_special_tokens=False)) for (k, _, _), i in zip(rows, ids, strict=True))
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in out.collect()) == want
    assert transducer_bpe.encode(df.limit(0), WORD).count() == 0


def test_documents_by_the_library(spark):
    from reelframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    t, ids = expected(WORD, [d["text"] or "" for d in docs])
    want = {d["doc_id"]: (len(i), hashlib.sha256(array("I", i).tobytes()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, i in zip(docs, ids, strict=True)}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op2_transducer_bpe"](spark, sf).collect()}
    assert got == want
    start, want = 0, {}
    for d, i in sorted(zip(docs, ids, strict=True), key=lambda x: x[0]["doc_id"]):
        want[d["doc_id"]] = (start, len(i) + 1, zlib.crc32(array("I", [*i, 2]).tobytes()))
        start += len(i) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op9_bit_planes"](spark, sf).collect()} == want


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]), st.integers(1, 64))
def test_planes_round_trip(ids, kind, block):
    lengths = [len(ids) // 2, 0, len(ids) - len(ids) // 2]
    got_lengths, got = bit_planes.read_file(bit_planes.write_file(lengths, np.array(ids, "<u4"), kind, block))
    assert got_lengths.tolist() == lengths and got.tolist() == ids


def test_token_store_cases(spark):
    rows = [(5, "five"), (None, "none"), (3, None), (3, ""), (4, "long " * 3000), (4, "four")]
    df = spark.createDataFrame([(k, x, 1) for k, x in rows], "doc_id long, text string, part int").repartition(3)
    path = new_path(spark, "test-store")
    bit_planes.write_tokens(df, path, WORD, 2, kind="bit", file_ids=500)
    got = bit_planes.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 3, 3, 4, 4, 5]
    ends = np.cumsum([len(r["ids"]) // 4 for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1].tolist()]
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 2 for r in got)
    empty = new_path(spark, "test-store")
    bit_planes.write_tokens(df.limit(0), empty, WORD, 2)
    assert bit_planes.read_tokens(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=120))
def test_packed_lengths_fill_their_windows(lengths):
    pieces, sequences = tier_packing.pack_lengths(lengths)
    seen, used = {}, {}
    for d, s, n, q, o in pieces:
        seen.setdefault(d, []).append((s, n))
        used.setdefault(q, []).append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(seen[d]):
            assert s == at
            at += m
        assert at == n
    for q, parts in used.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == sequences[q][1] <= sequences[q][0]
    assert sum(tokens < tier for tier, tokens in sequences) <= 1
    groups = tier_packing.step_groups(sequences, 4096)
    loads = np.bincount(groups, [t for _, t in sequences]) if groups else np.zeros(1)
    assert loads.max() - loads.min() <= 1024


@pytest.mark.parametrize("block", [1, 2, 2048])
def test_pack_pieces(spark, block):
    rows = [(1, "a"), (2, None), (None, "null id"), (4, "many words " * 2000), (5, "again"), (5, "again"), (6, "x " * 1023), (7, "x " * 1024), (8, "x " * 2047)]
    df = spark.createDataFrame([(k, x, 7) for k, x in rows], "doc_id long, text string, offset int")
    t, ids = expected(BYTE, [x or "" for _, x in rows])
    whole = sorted((str(k), [*i, 0]) for (k, _), i in zip(rows, ids, strict=True))
    got = tier_packing.pack(df, BYTE, block_documents=block).collect()
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in whole)
    by_id = dict(whole)
    for r in got:
        part = by_id[str(r["doc_id"])][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(array("I", part).tobytes()) and r["doc_tokens"] == len(by_id[str(r["doc_id"])])
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert tier_packing.pack(df.limit(0), BYTE).count() == 0
