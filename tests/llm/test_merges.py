"""Words merged together by arrays, and words that pieces share, against merges one by one and the libraries."""

import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from reelframe.llm import hashed_bpe, piece_cache, transducer_bpe
from reelframe.llm.merges import Merges

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SHARED = ["word", "wörd", "Word", "they"]
TAILS = ["", ",", ".", "###", "!!", "**-", "'s", "_", "<", "|>", "'", "\u0301", ",'s", "9", "²"]


def drawn(n, most=70):
    rng = random.Random(n)
    return ["".join(rng.choice("aaabcdeehilnorstuvézß日😀") for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_words_are_merged_together_as_one_by_one():
    words = [*drawn(3000, 12), *drawn(200), "a" * 64, "a" * 65, "ab" * 400, "a", "é"]
    vocab = transducer_bpe.vocabulary(WORD)
    assert vocab.merged_all(words) == [array("I", vocab.merged(w)).tobytes() for w in words] and vocab.merged_all([]) == []
    cache = hashed_bpe.ranked_cache(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = [w.encode() for w in words]
    assert cache.merged_all(coded) == [array("I", cache.merged(w)).tobytes() for w in coded] and cache.merged_all([]) == []


def test_the_leftmost_of_equal_pairs_and_a_table_without_pairs():
    import numpy as np

    ids, lengths = np.array([1, 1, 1, 1, 1, 2, 1, 2, 1]), np.array([5, 3, 1])
    merged = Merges([(1, 1, 0, 3), (3, 1, 1, 4), (2, 1, 2, 5)]).merged(ids, lengths)
    assert [np.frombuffer(b, "<u4").tolist() for b in merged] == [[3, 4], [5, 2], [1]]
    assert [np.frombuffer(b, "<u4").tolist() for b in Merges([]).merged(ids, lengths)] == [[1] * 5, [2, 1, 2], [1]]


@pytest.mark.parametrize("kind", ["op9", "op4", "op2", "op13"])
def test_a_word_is_encoded_once_whatever_follows_it(kind):
    texts = [" ".join(w + t for w in SHARED for t in TAILS), " ".join(SHARED) + "\n"]
    if kind == "op13":
        cache = hashed_bpe.RankedCache(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=cache.ranks, special_tokens={})
        want = [library.encode_ordinary(t) for t in texts]
    else:
        vocab = transducer_bpe.vocabulary(WORD)
        path = BYTE if kind == "op4" else WORD
        cache = transducer_bpe.TransducerCache(vocab, transducer_bpe.Transducer.compiled({"a": vocab.merged("a")})) if kind == "op2" else piece_cache.LibraryCache(path)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(cache.encode(texts)) == [array("I", x).tobytes() for x in want]
    assert {"###", "!!", "**-"} <= set(cache.words) and not any(w.endswith("###") and len(w) > 3 for w in cache.words)
