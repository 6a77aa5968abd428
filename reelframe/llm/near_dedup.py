"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash trees first, prefixes for the rest.

Texts are linked if their sets of shingles of WORDS words have a Jaccard similarity of at least 0.8; the links' connected
components are the groups.  Three steps find them, each of which leaves less to the next:

1. Equal sets, by a digest.
2. The BK-trees of simhash_trees over fingerprints of these shingles: what a tree links is compared set by set.
3. Fingerprints of texts with a similarity of 0.8 differ in some ten bits, out of reach of any tree that prunes.  So the
   rest comes from prefix filtering, which misses no pair: with all sets sorted alike, two that share `overlap` members
   share L or more of the first n - overlap + L of each, and overlap is 4/5 of n at least.  Rare shingles sort first; how
   rare they are is read off a sample of documents, on which only the time depends.  What follows the last shingle that
   two prefixes share bounds the overlap further.

The members of a large group would all be candidates of each other.  So the members of each bucket (the holders of one
shingle) of more than SMALL are first compared with PIVOTS pivots of it, and what is linked becomes one component; then
those outside a bucket's largest component are compared with all others.  That happens in blocks of about BLOCK members of
either side, to which the members bring their sets: products of matrices give what each two share, and only links leave
a block, one a member at most.  No pair is a row before it is known to be a link, unless one of its sets has more than
WHOLE members: these bring what others hold of their prefixes, by numbers, and the pairs that may be alike leave the block
of the first shingle that they share, to be compared by their texts.  For blocks the prefix that shares one member (L = 1) is enough.  So every pair that
may be alike is compared or in one component already.  A set of whose prefix too few members are held by any other has
no partner, and takes no part from the start.

Only shingles that two prefixes hold are shuffled with their holders: a first pass counts them, and a filter of the
repeated ones (see exact_dedup) is broadcast.  Pairs are compared by their texts, of which those with very many partners
are dealt out over several keys; no other text is shuffled.

Defined results: a null text counts as empty; texts without words are alike; one with fewer words than a shingle has its
whole sequence as its only shingle; rows with a null id stay; an id with several texts is linked by any of them; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm import exact_dedup
from reelframe.llm.common import batches_of, cut, meet, packed, release, small
from reelframe.llm.components import components
from reelframe.llm.simhash_trees import combined, links

WORDS, SEED, PIVOTS, SMALL, SAMPLE, COMMON = 5, 42, 1, 16, 4000, 2
SHARED = 20  # alike sets of n members share 1 + n // SHARED members of their prefixes at least
FILTER_WORDS, PARTNERS, BATCH, BLOCK, WHOLE, COLUMNS, STEP = 1 << 20, 256, 500, 512, 256, 4096, 1.26
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # of bytes: at the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[WORDS - 1 :])] or [digest(joined, SEED)], np.uint64))  # noqa: B905


def _prefix_size(n: int | np.ndarray) -> int | np.ndarray:
    """Of a set of n members; an empty one has no more than it has."""
    return n // 5 + n // SHARED + 1


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return packed(df, text_col, id_col, [], []).select(F.col("_id").cast("long").alias("_id"), "_text").where("_id is not null")


def _common(rows: DataFrame, total: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that COMMON or more documents of a sample hold, sorted, and by how many each is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["_text"]:
                yield pd.DataFrame({"h": shingles(text).view(np.int64)})

    share = min(1.0, sample / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("common"), "_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("_text")
    held = drawn.mapInPandas(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).toPandas()
    keys, counts = held["h"].to_numpy(np.int64).view(np.uint64), held["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _known(rows: DataFrame) -> DataFrame:
    """(_id, print, fp, n, prefix): a digest and the SimHash of the set, its size and its first shingles."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, rows.count()))

    def prefix(held: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(keys):
            at = np.minimum(np.searchsorted(keys, held), len(keys) - 1)
            held = held[np.lexsort((held, np.where(keys[at] == held, counts[at], 0)))]
        return held[: _prefix_size(len(held))].view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = shared.value
        for batch in batches:
            sets = [shingles(t) for t in batch["_text"]]
            prints = np.array([combined(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"_id": batch["_id"].to_numpy(), "print": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "fp": prints, "n": [len(s) for s in sets], "prefix": [prefix(s, keys, counts) for s in sets]})
        release()

    return rows.mapInPandas(run, "_id long, print binary, fp long, n int, prefix array<long>")


def _alike(shared: Column | int, n: Column | int, m: Column | int) -> Column | bool:
    """Whether sets of n and m members that share so many have a similarity of 4/5 or more."""
    return shared * 9 >= (n + m) * 4


def _candidates(met: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be alike, from a row (x, y) for each shingle that the prefixes of both hold.

    Of the shingles in `wide` buckets, which have no rows here, the two share as many as either has at most.
    """
    low, high = F.least("x", "y"), F.greatest("x", "y")  # structs of rep, n, at, wide, group
    each = met.where("x.group <> y.group").select(*[side[c].alias(c + name) for side, name in ((low, "1"), (high, "2")) for c in ("rep", "n", "at", "wide")])
    pairs = each.groupBy("rep1", "n1", "wide1", "rep2", "n2", "wide2").agg((F.count(F.lit(1)) + F.least("wide1", "wide2")).alias("c"), F.max("at1").alias("at1"), F.max("at2").alias("at2"))
    least = 1 + F.floor(F.least("n1", "n2") / SHARED)
    after = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) - 1
    likely = pairs.where((F.col("c") >= least) & _alike(F.col("c") + after, F.col("n1"), F.col("n2")))
    return likely.select(F.col("rep1").alias("a"), F.col("rep2").alias("b"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = functools.lru_cache(maxsize=4)(shingles)  # rows with one text follow each other
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            one, other = shingles(x.as_py()), seen(y.as_py())
            keep.append(_alike(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    release()


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts are alike.

    Each text goes to its pairs: once, and once more for each PARTNERS of them.
    """
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = small(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("keys")))

    def dealt(df: DataFrame, side: str, other: str) -> DataFrame:
        known = df.join(degree.withColumnRenamed("id", side), side)
        return known.withColumn("salt", F.pmod(F.xxhash64(other), F.col("keys")).cast("int")).drop("keys")

    def texts(side: str, name: str) -> DataFrame:
        asked = rows.join(degree, F.col("_id") == F.col("id"))
        return asked.select(F.col("_id").alias(side), F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("salt"), F.col("_text").alias(name))

    one = dealt(pairs, "a", "b").join(texts("a", "x"), ["a", "salt"]).drop("salt")
    both = dealt(one, "b", "a").join(texts("b", "y"), ["b", "salt"]).select("a", "b", "x", "y")
    with batches_of(rows.sparkSession, BATCH):
        return cut(both.mapInArrow(_compare, "a long, b long").distinct())


def _held(firsts: DataFrame, small_bucket: int = SMALL) -> tuple[DataFrame, int]:
    """(rep, n, at, key, size, wide, prefix) of the shingles that more than one prefix holds, and how many rows that are.

    key: a number for each of these shingles, an int where there are few enough, as sets bring many to their blocks.
    wide: of how many shingles of its prefix a set has more than small_bucket holders beside it.
    prefix: on the first row of a set that may be like a long one, all its keys in order; null on other rows.
    """
    entries = firsts.select(F.col("_id").alias("rep"), "n", F.posexplode("prefix").alias("at", "key"))
    counted = entries.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    repeated = cut(counted.withColumn("_number", F.monotonically_increasing_id()))  # a task's number, then 33 bits of a row's
    task, row = F.shiftright("_number", 33), F.col("_number").bitwiseAND((1 << 33) - 1)
    kinds, total, tasks, rows = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max(task), F.lit(0)) + 1, F.coalesce(F.max(row), F.lit(0)) + 1).first()
    number = (row * tasks + task).cast("int" if rows * tasks < 1 << 31 else "long")
    bits = exact_dedup.filter_bits(4 * kinds)
    words = cut(repeated.groupBy(exact_dedup.word_of(F.col("key"), bits).alias("word")).agg(F.bit_or(exact_dedup.bits_of(F.col("key"))).alias("mask")))
    likely = exact_dedup.in_filter(entries, "key", *exact_dedup.folded(words, bits, FILTER_WORDS)).where("_maybe").drop("_maybe")
    met = meet(likely, repeated.select("key", "_size", F.col("_size").alias("size"), number.alias("_key")), "key", total).where("size is not null")
    met = met.withColumn("key", F.col("_key")).drop("_key")
    by_set = met.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("at", "key", "size"))).alias("all"))  # no more than its prefix
    known = by_set.where(F.size("all") > F.floor(F.col("n") / (SHARED * 5 / 4)))
    wide = F.size(F.filter("all", lambda x: x["size"] > small_bucket)).cast("long").alias("wide")
    long = F.col("n") >= WHOLE * 4 // 5
    each = F.transform("all", lambda x, k: F.struct(x["at"].alias("at"), x["key"].alias("key"), x["size"].alias("size"), F.when((k == 0) & long, F.col("all.key")).alias("prefix")))
    return cut(known.select("rep", "n", wide, F.inline(each)).select("rep", "n", "at", "key", "size", "wide", "prefix")), total


def _sets(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, whole, held) of the ids in the column rep: the set of WHOLE hashes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column(1)]
            held = [s.view(np.int64) if len(s) <= WHOLE else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], ["rep", "held"])

    asked = rows.join(small(ids), F.col("_id") == F.col("rep")).select("rep", "_text")
    with batches_of(rows.sparkSession, BATCH):
        return cut(asked.mapInArrow(run, "rep long, held array<long>"))


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many members each set of one side shares with each of the other, by products of matrices of 0 and 1."""
    out = np.zeros((len(one), len(other)), np.float32)
    known, column = np.unique(np.concatenate(one + other), return_inverse=True)
    sides, at = [], 0
    for sets in (one, other):
        sizes = [len(x) for x in sets]
        sides.append((np.repeat(np.arange(len(sets)), sizes), column[at : at + sum(sizes)]))
        at += sum(sizes)
    both = np.flatnonzero(np.bincount(sides[0][1], minlength=len(known)).astype(bool) & np.bincount(sides[1][1], minlength=len(known)).astype(bool))
    place = np.full(len(known), -1)
    place[both] = np.arange(len(both))
    for first in range(0, len(both), COLUMNS):
        tables = []
        for (row, column), sets in zip(sides, (one, other), strict=True):
            c = place[column] - first
            kept = (place[column] >= 0) & (c >= 0) & (c < COLUMNS)
            table = np.zeros((len(sets), min(COLUMNS, len(both) - first)), np.float32)
            table[row[kept], c[kept]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a table of links the smallest row that they lead to; the number of rows where none."""
    n = len(linked)
    row = np.arange(n)
    while True:
        column = np.where(linked, row[:, None], n).min(axis=0, initial=n)
        lower = np.minimum(row, np.where(linked, column[None, :], n).min(axis=1, initial=n))
        if (lower == row).all():
            return row, column
        row = lower


def _block_links(key: int, block: list[tuple], whole: int = WHOLE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links, pairs to be compared by texts) of the rows (side, rep, group, n, held, prefix) of a block of holders of the shingle key.

    Side 0 meets side 1; rows of side 2 meet each other.  held is a whole set, or null if it is long; prefix has the
    shingles of a set's prefix that others hold too, or is null if a set is so short that no long one is like it.  A pair
    with a long set is given if no shingle before key, in the order of prefixes, is in both, and if what lies behind the
    prefix that ends first could make up for the rest.
    """

    def both(field: int) -> tuple[list[list[tuple]], np.ndarray, np.ndarray, np.ndarray]:
        """The rows of each side that have a field, whether their groups differ, and the larger and smaller size of each pair."""
        sides = [[r for r in block if r[0] in (k, 2) and r[field] is not None] for k in (0, 1)]
        n, m = (np.array([r[3] for r in side], np.int64) for side in sides)
        groups = [np.array([r[2] for r in side], np.int64) for side in sides]
        return sides, groups[0][:, None] != groups[1][None, :], np.maximum(n[:, None], m[None, :]), np.minimum(n[:, None], m[None, :])

    links, pairs = [], []
    sides, apart, more, less = both(4)
    if apart.size:
        shared = _shared(*[[r[4] for r in side] for side in sides])
        linked, itself = apart & (shared * 9 >= (more + less) * 4), block[0][0] == 2
        if itself:
            np.fill_diagonal(linked, True)
        row, column = _forest(linked)
        names = [[r[1] for r in side] for side in sides]
        links = [(names[0][k], names[0][to]) for k, to in enumerate(row.tolist()) if to != k]
        links += [(names[1][k], names[0][to]) for k, to in enumerate(column.tolist()) if to < len(row) and not itself]
    sides, apart, more, less = both(5)
    if apart.size and more.max() > whole:
        shared = _shared(*[[r[5] for r in side] for side in sides])
        before = _shared(*[[r[5][: int((r[5] == key).argmax())] for r in side] for side in sides])
        behind = np.maximum(more - _prefix_size(more), less - _prefix_size(less))
        likely = apart & (more > whole) & (shared >= 1 + less // SHARED) & (np.minimum(less, shared + behind) * 9 >= (more + less) * 4) & (before == 0)
        pairs = [(sides[0][i][1], sides[1][j][1]) for i, j in zip(*(x.tolist() for x in np.nonzero(likely)), strict=True)]
    return links, pairs


def _placed(mixed: DataFrame) -> DataFrame:
    """(key, window, one, other, side, x): the members of buckets in each block that they go to."""
    own = F.floor(F.log("x.n") / np.log(STEP)).cast("int")
    windows = F.when(F.col("size") > BLOCK, F.array(own, own + 1)).otherwise(F.array(F.lit(0)))
    placed = mixed.select("key", "size", "in_main", "x", F.explode(windows).alias("window"))
    sizes = placed.where(F.col("size") > BLOCK).groupBy("key", "window").agg(F.count_if("in_main").alias("m"), F.count_if(~F.col("in_main")).alias("o"))
    fits = F.col("m") + F.col("o") <= BLOCK
    parts = small(sizes.select("key", "window", F.when(fits, 0).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int").alias("mains"), F.when(fits, F.signum("o")).otherwise(F.ceil(F.col("o") / BLOCK)).cast("int").alias("others")))
    cells = placed.join(parts, ["key", "window"], "left").withColumns({"mains": F.coalesce("mains", F.lit(0)), "others": F.coalesce("others", F.lit(1))}).where("others > 0")
    stays = F.col("in_main") & (F.col("mains") > 0)
    at = F.xxhash64("x.rep")
    cells = cells.withColumn("part", F.when(stays, F.pmod(at, F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(at, F.col("others"))).cast("int"))
    met = F.explode(F.sequence(F.when(stays, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)).alias("q")
    side = F.when(F.col("part") == F.col("q"), 2).when(F.col("part") < F.col("q"), 0).otherwise(1).alias("side")
    return cells.select("key", "window", "part", "x", met).select("key", "window", F.least("part", "q").alias("one"), F.greatest("part", "q").alias("other"), side, "x")


def _in_blocks(named: DataFrame, rows: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """(a, b, sure) between members of different components that share a large bucket; those of its largest one meet only the others.

    Of shingles with the same holders, such as those of one passage, the first in the order of prefixes stands for all.
    Sets of which one is more than 5/4 of the other are not alike.  So a bucket of more than BLOCK is cut into windows of
    two neighbouring classes of sizes.  A window that still has more is cut into parts, of which each two meet in a block
    of their own, those of the largest component only parts of the others.
    sure: whether the two are known to be alike.
    """
    same = [F.bit_xor(F.xxhash64(F.lit(k), "x.rep")).alias(f"xor{k}") for k in (0, 1)]
    by_group = named.groupBy("key", F.col("x.group").alias("group")).agg(F.count(F.lit(1)).alias("c"), *same, F.min(F.struct("x.rep", "x.at")).alias("least"))
    main = by_group.groupBy("key").agg(F.max_by("group", F.struct("c", "group")).alias("main"), F.sum("c").alias("_size"), F.count(F.lit(1)).alias("groups"), *[F.bit_xor(f"xor{k}").alias(f"xor{k}") for k in (0, 1)], F.min("least").alias("least"))
    main = main.where("groups > 1").groupBy("xor0", "xor1", "_size", "least.rep").agg(F.min_by(F.struct("key", "main"), "least.at").alias("first")).select("first.key", "first.main", "_size")
    mixed = cut(meet(named, main, "key", total).where("main is not null").withColumn("in_main", F.expr("x.group = main")))
    reps = mixed.select("x.rep").distinct()
    sets = _sets(reps, rows)
    prefixes = held.where("prefix is not null").select("rep", F.col("n").alias("_n"), "prefix").join(small(reps), "rep", "left_semi")
    known = sets.join(prefixes, "rep", "left").select("rep", "held", "prefix", F.coalesce(F.size("held"), "_n").alias("n"))
    dealt = _placed(mixed).select("key", "window", "one", "other", "side", "x.rep", "x.group").join(known, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []

        def done() -> pa.RecordBatch:
            links, pairs = _block_links(at[0], block, WHOLE)
            a, b = ([r[k] for r in links + pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([True] * len(links) + [False] * len(pairs), pa.bool_())], ["a", "b", "sure"])

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("key", "window", "one", "other", "side", "rep", "group", "n")]
            held, prefix = batch.column("held"), batch.column("prefix")
            for k, (key, window, one, other, side, rep, group, n) in enumerate(zip(*columns, strict=True)):
                if (key, window, one, other) != at:
                    if block:
                        yield done()
                    at, block = (key, window, one, other), []
                block.append((side, rep, group, n, held[k].values.to_numpy() if held[k].is_valid else None, prefix[k].values.to_numpy() if prefix[k].is_valid else None))
        if block:
            yield done()
        release()

    with batches_of(rows.sparkSession, BATCH):
        ordered = dealt.repartition("key", "window", "one", "other").sortWithinPartitions("key", "window", "one", "other", "side")
        return cut(ordered.mapInArrow(run, "a long, b long, sure boolean").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pivots: int = PIVOTS, small_bucket: int = SMALL) -> DataFrame:
    """(doc_id, component_id) for each row of df whose id is not null."""
    rows = _rows(df, id_col, text_col)
    with batches_of(df.sparkSession, BATCH):
        known = cut(_known(rows))
    total = known.count()
    equal = known.groupBy("print").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("_size"))
    copies = cut(meet(known.select("_id", "print"), equal, "print", total).where("_id <> rep"))
    firsts = known.join(small(copies.select("_id", "print").distinct()), ["_id", "print"], "left_anti")
    same = copies.select(F.col("_id").alias("a"), F.col("rep").alias("b"))

    prints = cut(firsts.groupBy("fp").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("_size")))
    near = meet(firsts.select("_id", "fp"), prints, "fp", total).where("_id <> rep").select(F.col("rep").alias("a"), F.col("_id").alias("b"))
    pairs = near.unionByName(links(prints.select("fp", "rep")))
    held, entries = _held(firsts, small_bucket)
    large = held.where(F.col("size") > small_bucket)
    shortest = large.where(F.col("at") <= F.floor(F.col("n") / 5))
    alone = large.select("key", "size", F.struct("rep", "n", "at", F.lit(0).cast("long").alias("wide"), F.col("rep").alias("group")).alias("x"))
    for k in range(pivots):
        pivot = alone.groupBy("key").agg(F.min_by("x", F.xxhash64(F.lit(k), "x.rep")).alias("y"), F.count(F.lit(1)).alias("_size"))
        pairs = pairs.unionByName(_candidates(meet(alone, pivot, "key", entries)))
    groups = cut(components(same.unionByName(_linked(pairs, rows))))

    def members(part: DataFrame) -> DataFrame:
        named = part.join(groups, F.col("rep") == F.col("node"), "left")
        return named.select("key", "size", F.struct("rep", "n", "at", "wide", F.coalesce("component", "rep").alias("group")).alias("x"))

    few = members(held.where(F.col("size") <= small_bucket)).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("all"))
    few = few.select("all", F.posexplode("all").alias("k", "x")).select("x", F.explode(F.expr("slice(all, k + 2, size(all))")).alias("y"))
    met = _in_blocks(members(shortest), rows, held, entries)
    more = _linked(_candidates(few).unionByName(met.where("not sure").select("a", "b")), rows).unionByName(met.where("sure").select("a", "b"))
    groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = known.select("_id").join(groups, F.col("_id") == F.col("node"), "left")
    return named.select(F.col("_id").alias("doc_id"), F.coalesce("component", "_id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose group has a smaller id; rows with a null id stay."""
    gone = near_duplicates(df, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(small(gone), F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
