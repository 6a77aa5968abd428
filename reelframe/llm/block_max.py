"""Ranked lexical search by block-max pruning over a forward index.

Documents are cut into blocks of neighbours (at most BLOCK_DOCUMENTS of them, or fewer with many words), where they lie
and without a shuffle.  A block's row has its terms, how many of its documents hold each, the largest impact that each
has in any of them, and, as a forward index, the terms of every document.  A document's score is the sum of weight
times impact over a query's terms, so the same sum over a block's maxima bounds every score in it.

A search goes over the blocks three times, a batch of queries at once.  The first reads terms and maxima only and finds
for each query the blocks with the highest bounds.  Those are scored, and the k-th best score is a threshold that no
result falls below.  The last pass takes the blocks of a task in the order of each query's bound, and scores until the
bound drops below the threshold, which rises with what the task has found.  Each task hands on k rows a query at most.
A block whose bound equals the threshold is scored, as a smaller id wins a tie; so the result is exact.

Scores are integers: they are summed in doubles where no sum can pass 2^53, and in 64-bit integers otherwise.

Queries go in batches of at most QUERY_CELLS cells (queries times distinct terms), which bounds what is broadcast: one
query with more terms is a batch of its own.

Defined results: a null text has no terms, in documents and queries; a document without terms counts nowhere; a query
without terms, or whose terms no document holds, has no row; rows with a null id are scored and come last among equal
scores; rows that repeat an id or a text are ranked each for itself; a query's repeated terms count as often; each row
of the queries is a query; other columns of either table, whatever their names, are not looked at; texts are read whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelframe.llm.common import batches_of, cut, new_path, packed, release, remove

#: What separates terms, and the same for Spark: bytes of ASCII that are neither letters nor digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK_DOCUMENTS, BLOCK_ENTRIES, READ_BLOCKS, QUERY_CELLS, SEEDS, BEST = 64, 1 << 16, 32, 1 << 22, 2, 10
BLOCKS = "block long, ids array<long>, lengths array<long>, vocab array<binary>, most array<int>, held array<int>, starts array<int>, terms array<int>, times array<long>"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


class Numbers(dict):
    """A number for each key, in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


@dataclass
class Index:
    """Blocks (as BLOCKS) at a path, the number of documents with a term, and of all their terms."""

    blocks: DataFrame
    path: str
    documents: int
    words: int

    def remove(self) -> None:
        """Deletes the blocks; what has been searched stays."""
        remove(self.blocks.sparkSession, self.path)


def lengthening(n: int, documents: int, words: int) -> int:
    """The contract's m of a document with n terms."""
    return 100 - 75 + 75 * n * documents // words


def impacts(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def _block_row(number: int, names: list, lengths: list[int], vocab: Numbers, parts: list[tuple[list[int], list[int]]], documents: int, words: int) -> pa.RecordBatch:
    sizes = [len(t) for t, _ in parts]
    terms, times = (np.array([x for part in parts for x in part[side]], np.int64) for side in (0, 1))
    m = np.repeat(np.array([lengthening(n, documents, words) for n in lengths], np.int64), sizes)
    most = np.zeros(len(vocab), np.int64)
    np.maximum.at(most, terms, impacts(times, m))
    columns = [pa.array(names, pa.int64()), pa.array(lengths, pa.int64()), pa.array(list(vocab), pa.binary())]
    columns += [pa.array(x.astype(np.int32)) for x in (most, np.bincount(terms, minlength=len(vocab)), np.cumsum([0, *sizes]), terms)]
    columns.append(pa.array(times))
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], [c.split()[0] for c in BLOCKS.split(", ")])


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_documents: int = BLOCK_DOCUMENTS, block_entries: int = BLOCK_ENTRIES) -> Index:
    """The blocks of all documents of df, written to the shared folder.  Their number and lengths are counted first, as impacts depend on them."""
    spark = df.sparkSession
    rows = packed(df, text_col, id_col, [], []).select(F.col("_id").cast("long").alias("_id"), "_text")
    n = F.regexp_count("_text", F.lit(TERM))
    documents, words = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        names, lengths, vocab, parts, entries = [], [], Numbers(), [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                times = Counter(found)
                names.append(name)
                lengths.append(len(found))
                parts.append((list(map(vocab.__getitem__, times)), list(times.values())))
                entries += len(times)
                if len(names) >= block_documents or entries >= block_entries:
                    yield _block_row(base + count, names, lengths, vocab, parts, documents, words)
                    count += 1
                    names, lengths, vocab, parts, entries = [], [], Numbers(), [], 0
        if names:
            yield _block_row(base + count, names, lengths, vocab, parts, documents, words)
        release()

    path = new_path(spark, "blocks")
    rows.mapInArrow(run, BLOCKS).write.parquet(path)
    return Index(spark.read.schema(BLOCKS).parquet(path), path, documents, words)


@dataclass
class Queries:
    """A batch of queries: their ids, their distinct terms, and how often each query (row) has each term (column)."""

    items: list
    vocab: list[bytes]
    counts: np.ndarray

    def weighed(self, held: np.ndarray, documents: int) -> np.ndarray:
        """A row for each term and a column for each query: count times weight."""
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)
        table = np.ascontiguousarray((self.counts * weights).T)
        return table.astype(np.float64) if table.sum(axis=0).max(initial=0) < (1 << 53) // 1_000_000 else table


def query_batches(queries: DataFrame, item_col: str, text_col: str, cells: int = QUERY_CELLS) -> Iterator[Queries]:
    """The queries in batches, of which the driver holds one at a time."""
    vocab, items, found = Numbers(), [], []

    def batch() -> Queries:
        counts = np.zeros((len(items), len(vocab)), np.int64)
        for row, times in enumerate(found):
            counts[row, [vocab[t] for t in times]] = list(times.values())
        return Queries(items, list(vocab), counts)

    for item, text in queries.select(queries[f"`{item_col}`"], queries[f"`{text_col}`"].cast("string")).toLocalIterator():
        times = Counter(terms_of(text or ""))
        if not times:
            continue
        if items and (len(items) + 1) * (len(vocab) + sum(t not in vocab for t in times)) > cells:
            yield batch()
            vocab, items, found = Numbers(), [], []
        for term in times:
            vocab[term]
        items.append(item)
        found.append(times)
    if items:
        yield batch()


class Block:
    """A row of BLOCKS, as far as its columns were read, against a batch of queries."""

    def __init__(self, batch: pa.RecordBatch, k: int, vocab: pa.Array, table: np.ndarray, lengths: tuple[int, int]) -> None:
        self.batch, self.k, self.totals, self.seen = batch, k, lengths, None
        terms = batch.column("vocab")[k].values
        place = pc.fill_null(pc.index_in(vocab, value_set=terms), -1).to_numpy(zero_copy_only=False)
        self.present = np.flatnonzero(place >= 0)
        self.place, self.terms, self.table = place[self.present], len(terms), table

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(name)[self.k].values.to_numpy(zero_copy_only=False)

    def bounds(self) -> np.ndarray:
        """For each query what no score in the block passes."""
        return self.column("most")[self.place].astype(self.table.dtype) @ self.table[self.present]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """A row for each of the queries, a column for each document."""
        if self.seen is None:
            mine = np.full(self.terms, -1, np.int64)
            mine[self.place] = np.arange(len(self.place))
            term, starts, lengths = mine[self.column("terms")], self.column("starts"), self.column("lengths")
            known = term >= 0
            document = np.repeat(np.arange(len(lengths)), np.diff(starts))[known]
            m = np.array([lengthening(int(n), *self.totals) for n in lengths], np.int64)
            self.seen = np.zeros((len(self.place), len(lengths)), self.table.dtype)
            self.seen[term[known], document] = impacts(self.column("times")[known], m[document])
        return self.table[np.ix_(self.present, queries)].T @ self.seen


class Best:
    """The k best (score, id) of each query."""

    def __init__(self, queries: int, k: int, least: np.ndarray) -> None:
        self.k, self.least, self.rows = k, least.copy(), [np.zeros(0, np.int64)] * 4  # query, score, whether the id is null, id
        self.queries, self.waiting = queries, []

    def offer(self, queries: np.ndarray, scores: np.ndarray, block: Block) -> None:
        at, document = np.nonzero(scores >= np.maximum(self.least[queries], 1)[:, None])
        if len(at):
            names = block.batch.column("ids")[block.k].values
            null = names.is_null().to_numpy(zero_copy_only=False).astype(np.int64)[document]
            self.waiting.append([queries[at], scores[at, document].astype(np.int64), null, pc.fill_null(names, 0).to_numpy(zero_copy_only=False)[document]])

    def settle(self) -> None:
        """Takes what was offered; the threshold of a query with k results is the last one's score."""
        if not self.waiting:
            return
        query, score, null, name = (np.concatenate(c) for c in zip(self.rows, *self.waiting, strict=True))
        order = np.lexsort((name, null, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.rows = [query[kept], *[c[order][kept] for c in (score, null, name)]]
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[order][last])
        self.waiting = []

    def batch(self) -> pa.RecordBatch:
        query, score, null, name = self.rows
        return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(name, mask=null.astype(bool)), pa.array(score)], ["query", "doc_id", "score"])


def best_first(blocks: list[Block], best: Best) -> int:
    """Offers the scores of each query's blocks in the order of their bounds, until the bound drops below its threshold.

    Queries go on together, in waves of 1, 1, 2, 4, ... blocks each, so that a block is scored for several at once.
    Returns how many (query, block) pairs were scored.
    """
    bounds = np.stack([b.bounds() for b in blocks])
    order, scored, done, step = np.argsort(-bounds, axis=0, kind="stable"), 0, 0, 1
    while done < len(blocks):
        wave = order[done : done + step]
        block, query = wave.ravel(), np.tile(np.arange(best.queries), len(wave))
        wanted = bounds[block, query] >= np.maximum(best.least[query], 1)
        if not wanted.any():
            break  # later bounds are lower still
        block, query = block[wanted], query[wanted]
        for b in np.unique(block).tolist():
            mine = query[block == b]
            best.offer(mine, blocks[b].scores(mine), blocks[b])
        best.settle()
        scored, done, step = scored + len(block), done + len(wave), max(1, done + len(wave))
    return scored


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(index: Index, queries: Queries, k: int, seeds: int) -> DataFrame:
    """(query, doc_id, score, rank) of a batch of queries, by their numbers."""
    spark, totals = index.blocks.sparkSession, (index.documents, index.words)
    terms = spark.sparkContext.broadcast(queries.vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pa.array(terms.value, pa.binary())
        held = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                place = pc.fill_null(pc.index_in(vocab, value_set=batch.column("vocab")[k].values), -1).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(place >= 0)
                held[known] += batch.column("held")[k].values.to_numpy()[place[known]]
        known = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(held[known])], ["term", "n"])

    held = np.zeros(len(queries.vocab), np.int64)
    for term, n in index.blocks.select("vocab", "held").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # as many as terms at most
        held[term] = n
    table = spark.sparkContext.broadcast(queries.weighed(held, index.documents))
    n_queries = len(queries.items)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, kept = pa.array(terms.value, pa.binary()), [np.zeros((0, n_queries), np.int64)] * 2
        for batch in batches:
            here = [Block(batch, k, vocab, table.value, totals).bounds().astype(np.int64) for k in range(batch.num_rows)]
            names = np.repeat(batch.column("block").to_numpy()[:, None], n_queries, axis=1)
            bounds, blocks = np.concatenate([kept[0], *[h[None, :] for h in here]]), np.concatenate([kept[1], names])
            first = np.argsort(-bounds, axis=0, kind="stable")[:seeds]
            kept = [np.take_along_axis(bounds, first, 0), np.take_along_axis(blocks, first, 0)]
        bounds, blocks = kept
        some = bounds.ravel() > 0
        query = np.tile(np.arange(n_queries, dtype=np.int32), len(bounds))
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()[some]) for c in (query, bounds, blocks)], ["query", "bound", "block"])

    def search(least: np.ndarray):
        shared = spark.sparkContext.broadcast(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, best = pa.array(terms.value, pa.binary()), Best(n_queries, k, shared.value)
            for batch in batches:
                if batch.num_rows:
                    best_first([Block(batch, r, vocab, table.value, totals) for r in range(batch.num_rows)], best)
            yield best.batch()
            release()

        return run

    rows = "query int, doc_id long, score long"
    with batches_of(spark, READ_BLOCKS):
        bounds = index.blocks.select("block", "vocab", "most").mapInArrow(bound, "query int, bound long, block long")
        order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "block")
        first = bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seeds).select("block").distinct()
        chosen = cut(first)  # `seeds` blocks a query at most
        least = np.zeros(n_queries, np.int64)
        early = _ranked(index.blocks.join(F.broadcast(chosen), "block", "left_semi").mapInArrow(search(least), rows), k)
        for query, score in early.where(F.col("rank") == k).select("query", "score").collect():  # one a query
            least[query] = score
        return cut(_ranked(index.blocks.mapInArrow(search(least), rows), k))


def search(index: Index, queries: DataFrame, k: int = BEST, item_col: str = "item_id", text_col: str = "text", cells: int = QUERY_CELLS, seeds: int = SEEDS) -> DataFrame:
    """(item_col, rank, doc_id, score): the k documents with the highest scores above 0 for each row of queries."""
    spark: SparkSession = queries.sparkSession
    kind = queries.schema[item_col].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField(item_col, kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    if not index.documents:
        return out
    for batch in query_batches(queries, item_col, text_col, cells):
        names = spark.createDataFrame(list(enumerate(batch.items)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("_item", kind)]))
        found = _found(index, batch, k, seeds).join(F.broadcast(names), "query")
        out = out.unionByName(found.select(F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
