"""Byte-level BPE by a file of ranks, in two tiers.

Tier one is a minimal perfect hash of the vocabulary: a hash sends each entry to a bucket, and the bucket's displacement
to a slot of its own among exactly as many slots as entries; a bucket of one entry names its slot.  A whole pre-token is
found by one probe and one comparison, and is then a single id.  Tier two takes what the vocabulary does not have: its
bytes are merged, again and again the pair with the lowest rank, the leftmost of equals: those of many pre-tokens
together by arrays (see merges), those of long ones linked, with a heap.

Texts are cut before each single space between other characters, over which no pre-token reaches, and each distinct
piece is encoded once in a task (see piece_cache); pre-tokens are the matches of the pattern.

Defined results: a null or empty text has no ids and decodes to no bytes; rows that repeat are encoded alike; a text of
any length is encoded whole; ids of rows are never touched, null or large; an empty table gives an empty result.  Where
df has a column named ids or decoded, the result replaces it.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.llm.common import packed
from reelframe.llm.merges import Merges
from reelframe.llm.piece_cache import _DOUBLE_SPACE, TAIL, PieceCache

OUTPUTS = ["ids", "decoded"]
BUCKET_ENTRIES, TRIES, YIELD_ROWS, LONG_WORD = 3, 256, 256, 64
_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def hashes(entries: Iterable[bytes], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(e, seed) for e in entries], np.uint64)


def slots(hashed: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """The slot, below n, of each hash under a displacement."""
    z = hashed + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (((z ^ (z >> np.uint64(29))) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: number(s) finds the place of each in the list, or -1."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries, self.seed = entries, 0
        while not self._built():  # two entries with one hash
            self.seed += 1

    def _built(self) -> bool:
        n = len(self.entries)
        hashed = hashes(self.entries, self.seed)
        if len(np.unique(hashed)) < n:
            if len(set(self.entries)) < n:
                raise ValueError("an entry occurs twice")
            return False
        bucket = (hashed % np.uint64(max(1, n // BUCKET_ENTRIES))).astype(np.int64)
        sizes = np.bincount(bucket, minlength=max(1, n // BUCKET_ENTRIES))
        members, ends = np.argsort(bucket, kind="stable"), np.cumsum(sizes)
        self.displacement, self.at = np.zeros(len(sizes), np.int64), np.full(n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            own = members[ends[b] - sizes[b] : ends[b]]
            first, place = 0, None
            while place is None:  # TRIES displacements at a time
                tried = slots(hashed[own][None, :], np.arange(first, first + TRIES)[:, None], n)
                apart = np.ones(TRIES, bool)
                for i in range(len(own)):
                    for j in range(i):
                        apart &= tried[:, i] != tried[:, j]
                good = np.flatnonzero(apart & (self.at[tried] < 0).all(axis=1))
                if len(good):
                    place, self.displacement[b] = tried[good[0]], first + good[0]
                first += TRIES
            self.at[place] = own
        free = iter(np.flatnonzero(self.at < 0).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():
            slot = next(free)
            self.at[slot], self.displacement[b] = members[ends[b] - 1], ~slot
        return True

    def number(self, wanted: list[bytes]) -> list[int]:
        if not wanted or not self.entries:
            return [-1] * len(wanted)
        hashed, n = hashes(wanted, self.seed), len(self.entries)
        shift = self.displacement[(hashed % np.uint64(len(self.displacement))).astype(np.int64)]
        found = self.at[np.where(shift < 0, ~shift, slots(hashed, np.maximum(shift, 0), n))].tolist()
        return [k if self.entries[k] == w else -1 for k, w in zip(found, wanted, strict=True)]


class RankedCache(PieceCache):
    """Ids of pieces by a file of ranks and a pattern of pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        with open(path, "rb") as file:
            ranked = dict((base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, file) if token)
        self.ranks, self.pattern = ranked, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranked.items()}
        self.whole, self.rank_of = PerfectHash(list(ranked)), list(ranked.values())
        self.single = np.array([ranked.get(bytes([b]), -1) for b in range(256)], np.int64)
        halves = ((ranked.get(token[:k]), ranked.get(token[k:]), rank, rank) for token, rank in ranked.items() for k in range(1, len(token)))
        self.together = Merges(h for h in halves if h[0] is not None and h[1] is not None)

    def pieces(self, text: str) -> list[str]:
        if _DOUBLE_SPACE.search(text):
            return _SINGLE_SPACE.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")  # each single space begins a piece, a line end is one

    def ids_of(self, pieces: list[str]) -> Iterable[bytes]:
        cuts, ids = [self._parts(piece) for piece in pieces], self.words
        words = list({word for cut in cuts for word in cut}.difference(ids))
        coded = [word.encode() for word in words]
        places = self.whole.number(coded)
        rest = iter(self.merged_all([data for data, k in zip(coded, places, strict=True) if k < 0]))
        ids.update((word, next(rest) if k < 0 else self.rank_of[k].to_bytes(4, "little")) for word, k in zip(words, places, strict=True))
        out = [b"".join(map(ids.__getitem__, cut)) for cut in cuts]
        self.forget(words)
        return out

    def _parts(self, piece: str) -> list[str]:
        """The pre-tokens of a piece."""
        word = piece.rstrip(TAIL)
        if word.isascii() and word[word.startswith(" ") :].isalpha():
            return [word, piece[len(word) :]] if len(word) < len(piece) else [word]
        return self.pattern.findall(piece)

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit integers; all but long ones are merged together."""
        short = [word for word in words if len(word) <= LONG_WORD]
        ids = self.single[np.frombuffer(b"".join(short), np.uint8)]
        coded = iter(self.together.merged(ids, np.array([len(w) for w in short], np.int64)) if short else [])
        return [next(coded) if len(word) <= LONG_WORD else array("I", self.merged(word)).tobytes() for word in words]

    def merged(self, word: bytes) -> list[int]:
        """The ids of a pre-token; after[k] is where the part that begins at k ends, and so where the next one begins."""
        n, get = len(word), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, k + 1, k + 2) for k in range(n - 1) if (rank := get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, right, end = heapq.heappop(heap)
            if after[left] != right or after[right] != end:
                continue  # one of the two has grown or is gone
            after[left], after[right] = end, -1
            if end < n:
                before[end] = left
                if (rank := get(word[left : after[end]])) is not None:
                    heapq.heappush(heap, (rank, left, end, after[end]))
            first = before[left]
            if first >= 0 and (rank := get(word[first:end])) is not None:
                heapq.heappush(heap, (rank, first, left, end))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[word[k : after[k]]])
            k = after[k]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def ranked_cache(path: str, pattern: str) -> RankedCache:
    """One cache for each file, pattern and worker process."""
    return RankedCache(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """df with ids: the text's ids as little-endian unsigned 32-bit integers.

    decoded: whether to decode the ids again in the same pass, to bytes, which spares them a second way through Python.
    """
    rows = packed(df, text_col, id_col, OUTPUTS, carry).select("_row", "_text")
    names = ["_row", "ids", "decoded"] if decoded else ["_row", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ranked_cache(path, pattern).task() as cache:
            for batch in batches:
                row, coded = batch.column(0), cache.encode(text.as_py() for text in batch.column(1))
                for at in range(0, len(row), YIELD_ROWS):
                    ids = list(islice(coded, min(YIELD_ROWS, len(row) - at)))
                    columns = [row.slice(at, len(ids)), pa.array(ids, pa.binary())]
                    if decoded:
                        columns.append(pa.array(map(cache.decode, ids), pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([rows.schema["_row"], *[T.StructField(name, T.BinaryType()) for name in names[1:]]])
    carried = [F.col("_row").getField(c).alias(c) for c in rows.schema["_row"].dataType.names if c != "_none"]
    return rows.mapInArrow(run, schema).select(*carried, *names[1:])


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded: the bytes of the ids of ids_col; null stays null."""
    names = [c for c in df.columns if c.lower() != "decoded"]
    kept = df.select(F.struct(*[df[f"`{c}`"] for c in names]).alias("_row"), df[f"`{ids_col}`"].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ranked_cache(path, pattern)
        for batch in batches:
            texts = [None if (ids := value.as_py()) is None else cache.decode(ids) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["_row", "decoded"])

    out = kept.mapInArrow(run, T.StructType([kept.schema["_row"], T.StructField("decoded", T.BinaryType())]))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], "decoded")
