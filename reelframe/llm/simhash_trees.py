"""SimHash near-deduplication by BK-trees over shards.

A fingerprint has a bit for each of 64 columns of its shingles' hashes: set if more than half of them have it set.
Equal fingerprints are merged first.  Two that differ in at most RADIUS of 64 bits agree on at least `blocks` - RADIUS
of any `blocks` blocks of bits, so each fingerprint goes to one shard for each choice of that many blocks, and linked
ones meet in a shard.  A shard of one is dropped; a larger one becomes a BK-tree, whose children are keyed by their
distance to the parent; a search follows only the edges within the radius.  A tree is built in the task to which its
shard is dealt: broadcasting trees of all fingerprints would be without bound.  A shard of more than TREE_SIZE
fingerprints is split by hash into several trees, each searched for the fingerprints of the others in blocks, so no
task holds more than 2 * TREE_SIZE of them; one of more than CROWD trees is dealt into finer shards first.

A tree reports one edge for each fingerprint of a local component, not all pairs; a search ends once it has met every
local component.  The edges' connected components are the groups.

Defined results: a null text counts as empty; a text without words has the fingerprint zero, one with fewer words than
a shingle has that of its whole sequence; rows with a null id get a fingerprint and no component; rows that repeat
share a component; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import cut, meet, packed, release, small
from reelframe.llm.components import components

OUTPUTS = ["fingerprint", "component_id"]
SHINGLE_WORDS, SEED, RADIUS, BLOCKS, TREE_SIZE, CROWD, CHOICE = 4, 42, 4, 6, 2048, 32, 40
_ALL = (1 << 64) - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # of bytes: at the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return combined(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])] or [digest(joined, SEED)], np.uint64))  # noqa: B905


def combined(hashed: np.ndarray) -> int:
    """The SimHash of shingles' hashes; zero of none."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashed), 1 << 16):
        part = hashed[k : k + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashed), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["_id", "_fp"])

    rows = packed(df, text_col, id_col, OUTPUTS, []).select(F.col("_id").cast("long").alias("_id"), "_text")
    return rows.mapInArrow(run, "_id long, _fp long")


def _blocks(fp: Column, blocks: int, bits: int) -> list[tuple[Column, int]]:
    """(value, width) of each of the blocks into which the low bits of fp are cut."""
    widths = [bits // blocks + (k < bits % blocks) for k in range(blocks)]
    offsets = [0, *accumulate(widths)]
    return [(F.shiftrightunsigned(fp, offsets[k]).bitwiseAND(F.lit((1 << w) - 1)), w) for k, w in enumerate(widths)]


def _joined(parts: list[tuple[Column, int]]) -> Column:
    out = F.lit(0).cast("long")
    for value, width in parts:
        out = F.shiftleft(out, width).bitwiseOR(value)
    return out


def shard_keys(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS, bits: int = 64) -> Column:
    """An array of the keys of the shards of a fingerprint: the number of the choice of blocks above CHOICE, their bits below."""
    cut_up = _blocks(fp, blocks, bits)
    return F.array(*[F.lit(number << CHOICE).cast("long").bitwiseOR(_joined([cut_up[k] for k in chosen])) for number, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def other_bits(fp: Column, key: Column) -> Column:
    """The bits of fp that are not in the key of one of its shards."""
    cut_up = _blocks(fp, BLOCKS, 64)
    rests = [_joined([cut_up[k] for k in range(BLOCKS) if k not in chosen]) for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS)]
    return F.element_at(F.array(*rests), (F.shiftright(key, CHOICE) + 1).cast("int"))


class Tree:
    """A BK-tree with the local components of what it holds and of what was searched in it."""

    def __init__(self, radius: int = RADIUS) -> None:
        self.radius, self.prints, self.children, self.ids = radius, [], [], []
        self.parent: list[int] = []  # of the local components; entries beyond the tree are searched ones
        self.open = 0  # components among what the tree holds

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def near(self, fp: int) -> set[int]:
        """A node of each local component with a node within the radius of fp."""
        met: set[int] = set()
        stack, radius = [0] if self.prints else [], self.radius
        while stack:
            k = stack.pop()
            d = (fp ^ self.prints[k]).bit_count()
            if d <= radius:
                met.add(self.find(k))
                if len(met) == self.open:
                    break
            children = self.children[k]
            if children:
                stack.extend(c for e, c in children.items() if d - radius <= e <= d + radius)
        return met

    def insert(self, fp: int) -> None:
        k, number = 0, len(self.prints)
        self.prints.append(fp)
        self.children.append({})
        while number:
            d = (fp ^ self.prints[k]).bit_count()
            if (following := self.children[k].get(d)) is None:
                self.children[k][d] = number
                return
            k = following

    def join(self, met: set[int], number: int) -> None:
        for root in met:
            self.parent[self.find(root)] = self.find(number)

    def add(self, fp: int, name: int) -> None:
        """Searches fp, then holds it."""
        met, number = self.near(fp), len(self.parent)
        self.parent.append(number)
        self.ids.append(name)
        self.insert(fp)
        self.join(met, number)
        self.open += 1 - len(met)

    def search(self, fp: int, name: int) -> None:
        """Links fp to what the tree holds, without holding it."""
        met = self.near(fp)
        if met:
            number = len(self.parent)
            self.parent.append(number)
            self.ids.append(name)
            self.join(met, number)
            self.open += 1 - len(met)

    def edges(self) -> Iterator[tuple[int, int]]:
        """An edge from each entry to the smallest id of its local component."""
        least: dict[int, int] = {}
        for k, name in enumerate(self.ids):
            root = self.find(k)
            least[root] = min(name, least.get(root, name))
        for k, name in enumerate(self.ids):
            if name != least[self.find(k)]:
                yield name, least[self.find(k)]


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by tree, those that it holds first, to edges."""
    tree, at, found = Tree(), None, []
    for batch in batches:
        for key, low, high, asks, fp, name in zip(*(batch[c].tolist() for c in ("key", "low", "high", "asks", "fp", "rep")), strict=True):
            if (key, low, high) != at:
                found.extend(tree.edges())
                tree, at = Tree(), (key, low, high)
            (tree.search if asks else tree.add)(fp & _ALL, name)
        if len(found) > 10_000:
            yield pd.DataFrame(found, columns=["a", "b"])
            found = []
    found.extend(tree.edges())
    yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    del tree, found
    release()


def _sizes(tall: DataFrame) -> DataFrame:
    """(key, _size) of the shards that hold more than one fingerprint."""
    return cut(tall.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1"))


def _dealt(tall: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    return meet(tall, sizes.withColumn("n", F.col("_size")), "key", total).where("n is not null")


def links(prints: DataFrame, tree_size: int = TREE_SIZE, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the ids of (fp, rep) that connect all fingerprints within the radius of each other.

    A shard of more than `crowd` trees is dealt into finer ones, by a choice among blocks of the bits that are not in its
    key: two of its members differ in so many of these at most.  Keys of finer shards are hashes; if two were equal, one
    tree would hold both shards, which changes nothing.
    """
    tall = prints.select(F.explode(shard_keys(F.col("fp"))).alias("key"), "fp", "rep")
    total, sizes = prints.count() * len(list(combinations(range(BLOCKS), RADIUS))), _sizes(tall)
    met = _dealt(tall, sizes, total)
    if not sizes.where(F.col("_size") > crowd * tree_size).isEmpty():
        crowded = met.where(F.col("n") > crowd * tree_size)
        fine = crowded.select(F.explode(shard_keys(other_bits(F.col("fp"), F.col("key")), bits=44)).alias("fine"), "key", "fp", "rep").select(F.xxhash64("key", "fine").alias("key"), "fp", "rep")
        fine_sizes = _sizes(fine)
        met = met.where(F.col("n") <= crowd * tree_size).unionByName(_dealt(fine, fine_sizes, fine_sizes.agg(F.sum("_size")).first()[0] or 0))
    own = met.withColumn("trees", F.ceil(F.col("n") / tree_size).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    dealt = other.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("asks"), "fp", "rep")
    ordered = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "asks", "fp")
    return ordered.mapInPandas(_link, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of df."""
    rows = cut(with_fingerprints(df, id_col, text_col))
    prints = cut(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    groups = components(links(prints.where("rep is not null").select("fp", "rep")))
    named = prints.join(groups, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("group"), F.col("n").alias("_size"))
    joined = meet(rows, named, "_fp", rows.count())
    component = F.when(F.col("_id").isNotNull(), F.col("group"))
    return joined.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose group has a smaller id; rows with a null id stay."""
    gone = near_duplicates(df, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(small(gone), F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
