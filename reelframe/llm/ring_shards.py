"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring is cut into CELLS equal cells.  Each shard owns VNODES cells drawn by hash, its virtual nodes; a row belongs
to the cell of its key's hash and goes to the next virtual node clockwise.  A shard takes no more rows than its bound:
the row counts of two shards differ by one at most.  What finds its shard full continues clockwise, cell by cell and
within the cell in which a shard fills up row by row (by hash, then id, then checksum).

One aggregation gives the number of rows in each cell, CELLS rows at most whatever the input; the driver walks the
ring over these counts and plans which ranks of which cell go where.  The plan, at most CELLS + shards^2 rows, is
broadcast to the rows, which shuffle once by cell, without their texts unless the caller carries them.

Defined results: a null text counts as empty with 8 bytes; rows with a null id are placed by their text; equal rows
share a cell and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelframe.llm.common import packed, unpacked

OUTPUTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
CELLS = 1 << 16
VNODES = 160


def _cell(hashed: Column, cells: int) -> Column:
    return F.shiftrightunsigned(hashed, 65 - cells.bit_length()).cast("int")


def virtual_nodes(spark: SparkSession, shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) clockwise; of several virtual nodes in a cell the one with the smallest hash owns it."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("replica"))
    hashed = nodes.withColumn("h", F.xxhash64(F.lit("vnode"), "shard", "replica"))
    owned = hashed.groupBy(_cell(F.col("h"), cells).alias("cell")).agg(F.min_by("shard", "h").alias("shard"))
    return sorted((r["cell"], r["shard"]) for r in owned.collect())


def walk(loads: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank) under bounds that differ by one at most."""
    total = sum(loads.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken, starts, plan = [0] * shards, [cell for cell, _ in nodes], []
    ahead = list(range(len(nodes)))  # the next virtual node, this one included, whose shard may have room

    def roomy(k: int) -> int:
        passed = []
        while True:
            while ahead[k] != k:
                passed.append(k)
                k = ahead[k]
            if taken[nodes[k][1]] < room[nodes[k][1]]:
                break
            ahead[k] = (k + 1) % len(nodes)
        for p in passed:
            ahead[p] = k
        return k

    for cell in sorted(loads):
        rank, k = 0, bisect_left(starts, cell) % len(nodes)
        while rank < loads[cell]:
            k = roomy(k)
            shard = nodes[k][1]
            n = min(loads[cell] - rank, room[shard] - taken[shard])
            plan.append((cell, rank, rank + n, shard, taken[shard]))
            taken[shard] += n
            rank += n
    return plan


def assign_shards(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """df with size, text_crc32, law ('rows'), shard, slot and grown_shard (null under this law)."""
    spark = df.sparkSession
    rows = packed(df, text_col, id_col, OUTPUTS, carry).select("_id", "_row", F.crc32(F.col("_text").cast("binary")).alias("_crc"), (F.octet_length("_text") + 8).cast("long").alias("_size"))
    keyed = rows.withColumn("_hash", F.when(F.col("_id").isNull(), F.xxhash64("_crc", "_size")).otherwise(F.xxhash64("_id"))).withColumn("_cell", _cell(F.col("_hash"), cells))
    loads = {r["_cell"]: r["count"] for r in keyed.groupBy("_cell").count().collect()}  # at most `cells` rows
    plan = walk(loads, virtual_nodes(spark, shards, vnodes, cells), shards)
    planned = spark.createDataFrame(plan, "cell int, first long, end long, shard int, at long")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", "_id", "_crc", "_size")).cast("long") - 1)
    placed = ranked.join(F.broadcast(planned), (F.col("_cell") == F.col("cell")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("end")))
    return unpacked(
        placed, size=F.col("_size"), text_crc32=F.col("_crc"), law=F.lit("rows"), shard=F.col("shard"), slot=F.col("at") + F.col("_rank") - F.col("first"), grown_shard=F.lit(None).cast("int")
    )
