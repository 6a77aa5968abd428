"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Spark counts the words (pre-tokens) of all texts; the most frequent, LEXICON_WORDS at most and none that is rarer than
LEAST_COUNT, are compiled with their ids into a minimal acyclic automaton whose states with equal right languages are shared.  Each arc carries the number of words
that sort before it in its state, so the sum along a word's path is its rank, which points to its ids.  The automaton
is one file of flat arrays that Spark hands to every executor, where the workers of a machine memory-map it.  Words
that are not in it are merged exactly: again and again the pair with the lowest rank, the leftmost of equals.

Files of one kind are read: NFC, white space collapsed, lower case, pre-tokens by pattern, byte-level symbols, merges
with a suffix for the end of a word and no decoder, whose decode() joins tokens with spaces.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that repeat are encoded alike; a
text of any length is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from reelframe.llm.common import cut, new_path, packed
from reelframe.llm.merges import Merges
from reelframe.llm.piece_cache import _ODD_SPACE, TAIL, PieceCache, byte_symbols, drops_spaces

OUTPUTS = ["ids", "decoded"]
LEXICON_WORDS = 60_000
LEAST_COUNT = 3
YIELD_ROWS = 256
LONG_WORD = 64


@functools.lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Matches a character that has no category in Python's Unicode tables."""
    spans: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


class Vocabulary:
    """A tokenizer file: how a text becomes words and a word becomes ids, by exact merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        if model["type"] != "BPE" or not drops_spaces(said) or said.get("decoder"):
            raise ValueError(f"{path} is not a BPE vocabulary with word ends")
        self.ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.together = Merges((left, right, rank, made) for (left, right), (rank, made) in self.merges.items())
        self.first, self.last = (np.array([self.ids[s + end] for s in byte_symbols()], np.int64) for end in ("", self.suffix))
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.table = str.maketrans({b: c for b, c in enumerate(byte_symbols())})
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}
        self.library = Tokenizer.from_file(path)
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}

    def normal_words(self, text: str) -> list[str]:
        """The words of a text without added tokens.  Lower case goes character by character, so a final sigma stays plain.

        A text with a character that Python's Unicode tables do not know is cut by the library's normaliser and
        pre-tokeniser, whose tables may be newer.
        """
        if not text.isascii() and unassigned().search(text):
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.bytes.__getitem__, symbols)).decode() for symbols, _ in cut]
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _symbols(self, word: str) -> list[int]:
        symbols = word.encode().decode("latin-1").translate(self.table)
        return [self.ids[s] for s in symbols[:-1]] + [self.ids[symbols[-1] + self.suffix]]

    def merged(self, word: str) -> list[int]:
        """The ids of a word."""
        ids = self._symbols(word)
        return self._merge(ids) if len(ids) <= LONG_WORD else self._merge_long(ids)

    def merged_all(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers; all but long words are merged together."""
        data = [word.encode() for word in words]
        short = [d for d in data if len(d) <= LONG_WORD]
        lengths = np.array([len(d) for d in short], np.int64)
        flat = np.frombuffer(b"".join(short), np.uint8)
        ids = self.first[flat]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[flat[ends]]
        coded = iter(self.together.merged(ids, lengths) if short else [])
        return [next(coded) if len(d) <= LONG_WORD else array("I", self.merged(word)).tobytes() for d, word in zip(data, words, strict=True)]

    def _merge(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        while len(ids) > 1:
            best, at, left = None, 0, ids[0]
            for k in range(1, len(ids)):
                right = ids[k]
                found = get((left, right))
                left = right
                if found is not None and (best is None or found < best):
                    best, at = found, k
            if best is None:
                break
            ids[at - 1 : at + 1] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, in n log n steps."""
        n = len(ids)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.merges.get
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(n - 1) if (found := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, made = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j < 0 or ids[j] != right:
                continue
            ids[k], ids[j], after[k] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (found := get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b], found[1]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """The automaton as flat arrays.  keys: state * 256 + byte of each arc, ascending; ends: whether a word ends in a state."""

    FIELDS = ("keys", "targets", "skips", "ends", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def compiled(cls, entries: dict[str, list[int]]) -> Transducer:
        """Words and their ids, built in byte order; finished states are replaced by equal ones made before."""
        words = sorted(word.encode() for word in entries)
        shared: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, {}]]  # along the last word: whether it is final, arcs to finished states

        def finish(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                state = (final, tuple(sorted(arcs.items())))
                if (number := shared.get(state)) is None:
                    number = shared[state] = len(states)
                    states.append(state)
                path[-1][1][last[len(path) - 1]] = number

        last = b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            finish(same, last)
            path.extend([False, {}] for _ in word[same:])
            path[-1][0] = True
            last = word
        finish(0, last)
        states.append((path[0][0], tuple(sorted(path[0][1].items()))))
        below: list[int] = []
        keys, targets, skips = [], [], []
        for number, (final, arcs) in enumerate(states):  # targets come before their sources
            total = int(final)
            for label, target in arcs:
                keys.append(number * 256 + label)
                targets.append(target)
                skips.append(total)
                total += below[target]
            below.append(total)
        lists = [entries[word.decode()] for word in words]
        return cls(
            {
                "keys": np.array(keys, "<i8"),
                "targets": np.array(targets, "<i4"),
                "skips": np.array(skips, "<i4"),
                "ends": np.array([final for final, _ in states], "<u1"),
                "offsets": np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype="<i8")]).astype("<i8"),
                "ids": np.array([i for x in lists for i in x], "<u4"),
            }
        )

    def to_bytes(self) -> bytes:
        """A line of JSON with the place of each array, then the arrays, each at a multiple of 8."""
        head, parts, at = {}, [], 0
        for name in self.FIELDS:
            data = getattr(self, name).tobytes()
            head[name] = [getattr(self, name).dtype.str, at, len(getattr(self, name))]
            parts.append(data + bytes(-len(data) % 8))
            at += len(parts[-1])
        line = json.dumps(head).encode()
        return line + b" " * (-(len(line) + 1) % 8) + b"\n" + b"".join(parts)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """The arrays of a file, memory-mapped."""
        with open(path, "rb") as file:
            line = file.readline()
        data = np.memmap(path, np.uint8, "r", offset=0)
        arrays = {}
        for name, (kind, at, n) in json.loads(line).items():
            start = len(line) + at
            arrays[name] = data[start : start + n * np.dtype(kind).itemsize].view(kind)
        return cls(arrays)

    def ranks(self, words: list[str]) -> np.ndarray:
        """The rank of each word, -1 where the lexicon does not have it; all words walk together, one byte a step."""
        coded = [word.encode() for word in words]
        lengths = np.array([len(w) for w in coded])
        state, rank = np.full(len(words), len(self.ends) - 1, np.int64), np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        flat = np.frombuffer(b"".join(coded), np.uint8)
        starts = np.cumsum(lengths) - lengths
        for k in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((lengths > k) & (state >= 0))
            if not len(on):
                break
            wanted = state[on] * 256 + flat[starts[on] + k]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[arc] == wanted
            rank[on] += np.where(found, self.skips[arc], 0)
            state[on] = np.where(found, self.targets[arc], -1)
        return np.where((state >= 0) & (self.ends[np.maximum(state, 0)] > 0), rank, -1)


class TransducerCache(PieceCache):
    """Ids of pieces by the lexicon, and by exact merges for the words it does not have."""

    def __init__(self, vocab: Vocabulary, lexicon: Transducer) -> None:
        super().__init__()
        self.vocab, self.lexicon = vocab, lexicon
        self.flat_ids, self.offsets = lexicon.ids.tobytes(), lexicon.offsets.tolist()

    def pieces(self, text: str) -> list[str]:
        return [text] if _ODD_SPACE.search(text) else text.split()

    def _parts(self, piece: str) -> list[tuple[bool, str]]:
        """(is it an added token, word or token) in order."""
        if self.vocab.split_added and "<" in piece:
            cuts = self.vocab.split_added.split(piece)
            return [part for k, cut in enumerate(cuts) for part in ([(True, cut)] if k % 2 else [(False, w) for w in self.vocab.normal_words(cut)])]
        word = piece.rstrip(TAIL)
        if word.isascii() and word.isalpha():
            return [(False, word.lower()), (False, piece[len(word) :])] if len(word) < len(piece) else [(False, word.lower())]
        return [(False, w) for w in self.vocab.normal_words(piece)]

    def ids_of(self, pieces: list[str]) -> Iterable[bytes]:
        cuts, ids = [self._parts(piece) for piece in pieces], self.words
        words = list({word for cut in cuts for added, word in cut if not added}.difference(ids))
        ranks = self.lexicon.ranks(words).tolist() if words else []
        data, offsets = self.flat_ids, self.offsets
        ids.update((word, data[4 * offsets[rank] : 4 * offsets[rank + 1]]) for word, rank in zip(words, ranks, strict=True) if rank >= 0)
        rest = [word for word, rank in zip(words, ranks, strict=True) if rank < 0]
        ids.update(zip(rest, self.vocab.merged_all(rest), strict=True))
        tokens = {t: array("I", [i]).tobytes() for t, i in self.vocab.added.items()}
        out = [b"".join([tokens[word] if added else ids[word] for added, word in cut]) for cut in cuts]
        self.forget(words)
        return out


@functools.lru_cache(maxsize=4)
def _cache(path: str, lexicon_file: str) -> TransducerCache:
    return TransducerCache(vocabulary(path), Transducer.mapped(SparkFiles.get(lexicon_file)))


def word_counts(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            pieces: Counter = Counter()
            for text in batch["_text"]:
                pieces.update([text] if _ODD_SPACE.search(text) else text.split())
            words: Counter = Counter()
            for piece, n in pieces.items():
                for word in vocab.normal_words(piece):
                    words[word] += n
            yield pd.DataFrame({"word": list(words), "n": list(words.values())})

    texts = df.select(F.coalesce(df[f"`{text_col}`"], F.lit("")).alias("_text"))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(df: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of df and hands the file to the executors; returns its name.

    Words are taken by classes of frequency, sixteen for each doubling, as many whole classes as hold `size` words at
    most.  The driver sees a row for each class, then these words.  The file goes through the shared folder.
    """
    spark = df.sparkSession
    counted = word_counts(df, path, text_col).where((F.col("n") >= LEAST_COUNT) & (F.length("word") <= LONG_WORD))
    classed = cut(counted.select("word", F.floor(F.log2("n") * 16).cast("int").alias("class")))
    least, held = None, 0
    for r in sorted(classed.groupBy("class").count().collect(), reverse=True):
        held += r["count"]
        if held > size:
            break
        least = r["class"]
    frequent = classed.where(F.col("class") >= F.lit(least))
    vocab = vocabulary(path)
    lexicon = Transducer.compiled({r["word"]: vocab.merged(r["word"]) for r in frequent.collect()})
    place = new_path(spark, "lexicon")
    _write_bytes(spark, place, lexicon.to_bytes())
    spark.sparkContext.addFile(place)
    return place.rsplit("/", 1)[1]


def _write_bytes(spark: SparkSession, place: str, data: bytes) -> None:
    """Writes one file to a store that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(place)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, lexicon: str | None = None, size: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """df with ids: the text's ids as little-endian unsigned 32-bit integers.

    lexicon: a name that compile_lexicon returned.  decoded: whether to decode the ids again in the same pass, which
    spares the ids a second way through Python.
    """
    name = lexicon or compile_lexicon(df, path, text_col, size)
    rows = packed(df, text_col, id_col, OUTPUTS, carry).select("_row", "_text")

    added = ["ids", "decoded"] if decoded else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        with _cache(path, name).task() as cache:
            for batch in batches:
                row, coded = batch.column(0), cache.encode(text.as_py() for text in batch.column(1))
                for at in range(0, len(row), YIELD_ROWS):
                    ids = list(islice(coded, min(YIELD_ROWS, len(row) - at)))
                    columns = [row.slice(at, len(ids)), pa.array(ids, pa.binary())]
                    if decoded:
                        columns.append(pa.array((vocab.decode(np.frombuffer(b, "<u4").tolist()) for b in ids), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, ["_row", *added])

    schema = T.StructType([rows.schema["_row"], T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in rows.schema["_row"].dataType.names if c != "_none"], *added)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded: the tokens of ids_col, joined with spaces as this kind of file has no decoder."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return ids.map(lambda b: None if b is None else vocab.decode(np.frombuffer(b, "<u4").tolist()))

    return df.withColumn("decoded", text(F.col(ids_col)))
