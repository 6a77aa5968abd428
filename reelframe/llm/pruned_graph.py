"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors are merged first: of each distinct vector the k + 1 smallest ids are kept, as no more can ever be among
the k nearest of a query.  Distinct vectors are dealt into cells, each to the nearest of the centres that are fitted to a
sample of about FIT_VECTORS; a cell of more than SHARD_VECTORS is split by hash into several shards.  In each shard a
graph is built in batches: a greedy beam search from the medoid proposes neighbours, relaxed pruning keeps those that no
nearer kept neighbour covers (by the factor ALPHA), and edges are also laid backwards.  The graphs are written to the
shared folder.  A query goes to its PROBES nearest cells, and to further ones until they hold k + 1 ids, then to every
other cell that could hold a vector nearer than the k-th found, by its distance to the plane between two centres; so no
cell is left out that matters.  In each shard a beam search finds candidates, and where it reaches fewer than there are,
the whole shard is scanned instead.  An index row is moved once, plus once for each QUERY_BLOCK queries that ask it.

Distances are sums of squared differences in double precision, after division by a power of two, so neither a common
offset nor a very large or small scale loses their order.  Scores are computed anew from the original vectors.

Defined results: rows with a null id, and vectors that are null, zero or hold null or non-finite components take no
part; only vectors of equal length are compared; ties go to the smaller id; rows that repeat count once; an id with
several vectors counts for each of them; a query with fewer candidates gets all; a distance beyond the range of doubles
is infinite; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelframe.llm.common import cut

DEGREE, BEAM, SEARCH_BEAM, ALPHA, EXPANDED, BATCH = 32, 64, 128, 1.2, 4, 256
SHARD_VECTORS, QUERY_BLOCK = 8192, 16_384
FIT_VECTORS, MOST_CELLS, FIT_ROUNDS, PROBES, PLANES = 1 << 14, 1024, 8, 8, 8


def squared(x: np.ndarray, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The squared distances of each point to its row of nodes."""
    away = x[nodes]
    away -= points[:, None, :]
    return np.einsum("bkd,bkd->bk", away, away)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances), nearest first, of a greedy search for each query; -1 and inf where there are fewer."""
    b = len(queries)
    nodes, far = np.full((b, width), -1, np.int64), np.full((b, width), np.inf)
    done, seen = np.zeros((b, width), bool), np.zeros((b, len(x)), bool)
    nodes[:, 0], seen[:, entry] = entry, True
    far[:, 0] = squared(x, nodes[:, :1], queries)[:, 0]
    while True:
        waits = ~done & (nodes >= 0)
        rows = np.flatnonzero(waits.any(axis=1))
        if not len(rows):
            return nodes, far
        waits = waits[rows]
        turn = waits & (np.cumsum(waits, axis=1) <= EXPANDED)
        done[rows] |= turn
        at = np.argsort(~turn, axis=1, kind="stable")[:, :EXPANDED]
        open_ = np.where(np.take_along_axis(turn, at, axis=1), np.take_along_axis(nodes[rows], at, axis=1), -1)
        near = np.where(open_[:, :, None] >= 0, graph[open_], -1).reshape(len(rows), -1)
        new = near >= 0
        near = np.where(new, near, 0)
        new &= ~seen[rows[:, None], near]
        marked = np.sort(np.where(new, near, -1), axis=1)[:, ::-1]  # a node that two expanded nodes have counts once
        new = marked >= 0
        new[:, 1:] &= marked[:, 1:] != marked[:, :-1]
        most = int((marked >= 0).sum(axis=1).max(initial=0))
        if not most:
            continue
        new, near = new[:, :most], np.where(new, marked, 0)[:, :most]
        seen[np.repeat(rows, new.sum(axis=1)), near[new]] = True
        d = np.concatenate([far[rows], np.where(new, squared(x, near, queries[rows]), np.inf)], axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        far[rows] = np.take_along_axis(d, order, axis=1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], np.where(new, near, -1)], axis=1), order, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(near.shape, bool)], axis=1), order, axis=1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point the kept candidates, nearest first: the nearest one is kept and covers what is alpha times nearer to it than to the point, and so on."""
    candidates = np.sort(candidates, axis=1)
    ok = (candidates >= 0) & (candidates != points[:, None])
    ok[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    safe = np.where(ok, candidates, 0)
    away = x[safe]
    away -= x[points][:, None, :]
    d = np.where(ok, np.einsum("bkd,bkd->bk", away, away), np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, : 3 * degree]
    d, safe = np.take_along_axis(d, order, axis=1), np.take_along_axis(safe, order, axis=1)
    away = np.take_along_axis(away, order[:, :, None], axis=1)
    own = np.einsum("bkd,bkd->bk", away, away)
    pairs = own[:, :, None] - 2 * np.matmul(away, away.transpose(0, 2, 1)) + own[:, None, :]
    alive, rows = np.isfinite(d), np.arange(len(points))
    out = np.full((len(points), degree), -1, np.int64)
    for k in range(degree):
        best = alive.argmax(axis=1)
        some = alive[rows, best]
        if not some.any():
            break
        out[some, k] = safe[rows, best][some]
        alive &= ~(alpha * alpha * pairs[rows, best] <= d)
        alive[rows, best] = False
    return out


def scaled(x: np.ndarray, exponent: int) -> np.ndarray:
    return np.ldexp(x, -exponent)


def exponent_of(*parts: np.ndarray) -> int:
    """The power of two just above the largest component."""
    return max((int(np.frexp(np.abs(p).max())[1]) for p in parts if p.size), default=0)


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(neighbours of each row, -1 where there are fewer; entry) for the rows of x, none of them far beyond 1."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, DEGREE), -1, np.int64)
    if n > 1:
        some = min(8, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    order = rng.permutation(n)
    for first in range(0, n, BATCH):
        points = order[first : first + BATCH]
        found, _ = beam_search(x, graph, entry, x[points], BEAM)
        graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1))
        source, target = np.repeat(points, DEGREE), graph[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, start, size = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(hit), 4 * BATCH):
            t, s, c = (a[low : low + 4 * BATCH] for a in (hit, start, size))
            extra = np.full((len(t), int(c.max())), -1, np.int64)
            column = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            extra[np.repeat(np.arange(len(t)), c), column] = source[np.repeat(s, c) + column]
            graph[t] = robust_prune(x, t, np.concatenate([graph[t], extra], axis=1))
    return graph, entry


def nearest_nodes(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> list[np.ndarray]:
    """The nodes that a beam search finds for each query; all nodes where it finds fewer than it has room for and there are."""
    nodes, _ = beam_search(x, graph, entry, queries, width)
    everything, enough = np.arange(len(x)), min(width, len(x))
    return [f if len(f := row[row >= 0]) >= enough else everything for row in nodes]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q; scaled where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        away = x - q
        plain = np.sqrt((away**2).sum(axis=1))
        odd = ~np.isfinite(plain) | ((plain < 1e-140) & (away != 0).any(axis=1))
        for k in np.flatnonzero(odd & np.isfinite(away).all(axis=1)):
            e = exponent_of(away[k])
            plain[k] = np.ldexp(np.sqrt((scaled(away[k], e) ** 2).sum()), e)
    return plain


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


@dataclass
class Cells:
    """The cells of vectors of one length: centres, and how many ids and shards each has."""

    exponent: int
    middle: np.ndarray
    points: np.ndarray
    ids: np.ndarray
    shards: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, cells: int, exponent: int, seed: int = 0) -> Cells:
        """Centres by a few rounds of k-means over a sample; one cell needs none."""
        middle = np.median(scaled(x, exponent), axis=0) if len(x) else np.zeros(x.shape[1])
        cells = max(1, min(cells, len(x) // 8))
        y = scaled(x, exponent) - middle
        points = y[np.random.default_rng(seed).permutation(len(y))[:cells]] if cells > 1 else np.zeros((1, x.shape[1]))
        out = cls(exponent, middle, points, np.zeros(len(points), np.int64), np.ones(len(points), np.int64))
        for _ in range(FIT_ROUNDS if cells > 1 else 0):
            of = out.far(x).argmin(axis=1)
            n = np.bincount(of, minlength=cells)
            total = np.zeros_like(out.points)
            np.add.at(total, of, y)
            out.points = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], out.points)
        return out

    def far(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each row to each centre, up to what all centres of a row share."""
        return (self.points**2).sum(axis=1) - 2 * (scaled(x, self.exponent) - self.middle) @ self.points.T

    def assigned(self, x: np.ndarray) -> np.ndarray:
        return self.far(x).argmin(axis=1) if len(self.points) > 1 else np.zeros(len(x), np.int64)

    def _near(self, x: np.ndarray, probes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells of each row by nearness, how many are probed first: `probes`, or more until they hold `least` ids)."""
        order = np.argsort(self.far(x), axis=1, kind="stable") if len(self.points) > 1 else np.zeros((len(x), 1), np.int64)
        return order, np.maximum((np.cumsum(self.ids[order], axis=1) < least).sum(axis=1) + 1, probes)

    def _shards(self, found: np.ndarray) -> list[int]:
        """The shards of some cells, as cell << 32 | number."""
        return [(int(c) << 32) + k for c in found for k in range(self.shards[c])]

    def first(self, x: np.ndarray, probes: int, least: int) -> list[list[int]]:
        """The shards in which each row is searched first."""
        return [self._shards(row[:n]) for row, n in zip(*self._near(x, probes, least), strict=True)]

    def further(self, x: np.ndarray, reach: np.ndarray, probes: int, least: int) -> list[list[int]]:
        """The shards of all other cells that may hold a vector nearer than `reach`.

        What lies in a cell is nearer to its centre than to any other, so it is beyond the plane half-way between the two
        and cannot be nearer to a query than that plane is.
        """
        if len(self.points) == 1:
            return [[] for _ in range(len(x))]
        far, (order, n) = self.far(x), self._near(x, probes, least)
        gap = np.sqrt(np.maximum(0, (self.points**2).sum(axis=1)[:, None] - 2 * self.points @ self.points.T + (self.points**2).sum(axis=1)))
        plane = np.zeros_like(far)
        for other in order[:, :PLANES].T:
            between = gap[other]
            plane = np.maximum(plane, np.where(between > 0, (far - far[np.arange(len(x)), other][:, None]) / (2 * np.maximum(between, 1e-300)), 0.0))
        open_ = (plane * (1 - 1e-6) <= scaled(reach, self.exponent)[:, None]) & (self.ids > 0)
        for row, done, k in zip(open_, order, n, strict=True):
            row[done[:k]] = False
        return [self._shards(np.flatnonzero(row)) for row in open_]


def _index(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("ids", key=lambda s: s.map(lambda v: v[0]))
    x = np.array(group["vector"].tolist(), np.float64)
    graph, entry = build_graph(scaled(x, exponent_of(x)))
    ids = [list(v) for v in group["ids"]]
    return pd.DataFrame(
        {
            "dim": [x.shape[1]], "place": [int(group["place"].iloc[0])], "n": [len(x)], "entry": [entry], "vectors": [x.tobytes()], "graph": [graph.astype(np.int32).tobytes()],
            "counts": [np.array([len(v) for v in ids], np.int32).tobytes()], "ids": [np.array([i for v in ids for i in v], np.int64).tobytes()],
        }
    )


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{vector_col}`"].cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))


def _matrices(batch: pd.DataFrame):
    """(positions, matrix) of the rows of a batch that have vectors of one length."""
    for dim, rows in batch.groupby("dim").indices.items():
        yield int(dim), rows, np.array(batch["vector"].iloc[rows].tolist(), np.float64)


def build_index(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_vectors: int = SHARD_VECTORS, fit_vectors: int = FIT_VECTORS) -> tuple[DataFrame, dict[int, Cells]]:
    """(one row for each shard, cells by length of the vectors); every usable vector is in it."""
    rows = _vectors(df, id_col, vector_col)
    first = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    distinct = cut(first.groupBy("dim", "vector").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    draw = F.pmod(F.xxhash64(F.lit("cells"), "vector"), F.lit(1 << 30))
    sizes = {r["dim"]: (r["n"], r["most"]) for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).collect()}
    asked = {dim: min(MOST_CELLS, -(-n // shard_vectors)) for dim, (n, _) in sizes.items()}
    split = [dim for dim, n in asked.items() if n > 1]
    share = F.lit(int((1 << 30) * min(1.0, fit_vectors / max(1, sum(sizes[dim][0] for dim in split)))))
    sample = distinct.where(F.col("dim").isin(split) & (draw < share)).select("dim", "vector").toPandas() if split else pd.DataFrame({"dim": [], "vector": []})
    sample["_key"] = sample["vector"].map(tuple)
    seen = {dim: x for dim, _, x in _matrices(sample.sort_values("_key"))}
    cells = {dim: Cells.fitted(seen.get(dim, np.zeros((0, dim))), asked[dim], exponent_of(np.array([most]))) for dim, (_, most) in sizes.items()}

    def deal(batches):
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for dim, rows, x in _matrices(batch):
                out[rows] = cells[dim].assigned(x)
            yield batch.assign(cell=out)

    dealt = cut(distinct.mapInPandas(deal, "dim int, vector array<double>, ids array<bigint>, cell long"))
    for r in dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect():  # MOST_CELLS rows a length at most
        cells[r["dim"]].ids[r["cell"]], cells[r["dim"]].shards[r["cell"]] = r["ids"], -(-r["n"] // shard_vectors)
    shards = df.sparkSession.createDataFrame([(dim, k, int(n)) for dim, c in cells.items() for k, n in enumerate(c.shards)], "dim int, cell long, shards int")
    placed = dealt.join(F.broadcast(shards), ["dim", "cell"]).withColumn("place", F.shiftleft("cell", 32) + F.pmod(F.xxhash64("vector"), F.col("shards")))
    schema = "dim int, place long, n int, entry int, vectors binary, graph binary, counts binary, ids binary"
    return cut(placed.select("dim", "place", "vector", "ids").groupBy("dim", "place").applyInPandas(_index, schema)), cells


def search(index: DataFrame, cells: dict[int, Cells], queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each usable query, itself (by id) left out."""
    width = max(SEARCH_BEAM, 4 * k)

    def route(further: bool):
        def routed(batches):
            for batch in batches:
                places: list[list[int]] = [[] for _ in range(len(batch))]
                for dim, rows, x in _matrices(batch):
                    if dim in cells:
                        args = (probes, k + 1)
                        found = cells[dim].further(x, batch["reach"].to_numpy(float)[rows], *args) if further else cells[dim].first(x, *args)
                        for row, its in zip(rows, found, strict=True):
                            places[row] = its
                yield batch[["id", "vector", "dim"]].assign(places=places)

        return routed

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            row = held.iloc[0]
            x = np.frombuffer(row["vectors"]).reshape(row["n"], -1)
            graph = np.frombuffer(row["graph"], np.int32).reshape(row["n"], -1).astype(np.int64)
            ends = np.cumsum(np.frombuffer(row["counts"], np.int32))
            ids, asks, names = np.frombuffer(row["ids"], np.int64), np.array(asked["vector"].tolist(), np.float64), asked["id"].tolist()
            exponent = exponent_of(x, asks)
            small, small_asks = scaled(x, exponent), scaled(asks, exponent)
            for at in range(0, len(asks), 64):
                nodes = nearest_nodes(small, graph, int(row["entry"]), small_asks[at : at + 64], width)
                for name, q, found in zip(names[at : at + 64], asks[at : at + 64], nodes, strict=True):
                    pairs = sorted((float(s), int(i)) for s, node in zip(distances(x[found], q), found, strict=True) for i in ids[ends[node - 1] if node else 0 : ends[node]] if i != name)[:k]
                    out += [(name, i, s) for s, i in pairs]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def searched(asked: DataFrame, further: bool) -> DataFrame:
        routed = cut(asked.mapInPandas(route(further), "id long, vector array<double>, dim int, places array<bigint>"))
        routed = routed.select("id", "vector", "dim", F.explode("places").alias("place"))
        hot = routed.groupBy("dim", "place").count().where(F.col("count") > query_block).select("dim", "place", F.ceil(F.col("count") / query_block).cast("int").alias("blocks"))
        one = F.coalesce("blocks", F.lit(1))
        asks = routed.join(hot, ["dim", "place"], "left").withColumn("block", F.pmod(F.xxhash64("id"), one).cast("int")).drop("blocks")
        held = index.join(hot, ["dim", "place"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), one - 1))).drop("blocks")
        keys = ["dim", "place", "block"]
        return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    asked = _vectors(queries, id_col, vector_col).dropDuplicates(["id", "vector"])
    found = searched(asked, False)
    if any(len(c.points) > probes for c in cells.values()):
        found = cut(found)
        kth = best(found).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("reach"))
        open_ = asked.join(kth, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        found = found.unionByName(searched(open_, True))
    return best(found).select("query_id", "rank", "vec_id", "score")
