"""Helpers shared by the operators of this subpackage.

Operators take a frame with any columns.  What they need is copied to names that begin with an underscore and the
caller's columns travel in one struct, so no column of the caller can clash with a working column.  Where the caller
has a column that is named like a result column, the result replaces it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; only Spark opens it, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; on one machine, a new one where that is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelframe-"))
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any store that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path of any store that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is computed within leaves no shuffle files behind: its result is kept or written, so they serve no more."""
    with setting(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, where the loss of an executor does no harm."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint()


@contextlib.contextmanager
def setting(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session's settings changed for what is computed within."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed within reads and hands Python so many rows at a time, for rows that may be long."""
    with setting(spark, dict.fromkeys(("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"), rows)):
        yield


def release() -> None:
    """Gives back the memory that a task has freed, as Spark keeps its Python worker for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def hot_size(total: int, hot_groups: int) -> int:
    """More rows than this are a hot group: a power of two, so that plans over growing tables stay alike, or 0."""
    share = total // hot_groups
    return 1 << (share - 1).bit_length() if share > 0 else 0


HOT_GROUPS = 1024
BROADCAST_IDS = 2_000_000


def meet(rows: DataFrame, groups: DataFrame, key: str, total: int, size: str = "_size", hot_groups: int | None = None) -> DataFrame:
    """rows with the other columns of groups, null where there is none; no task gets a whole large group.

    groups has one row for each key and, in the column `size`, how many of the `total` rows have it.  The keys of more
    than a HOT_GROUPS-th of them, fewer than HOT_GROUPS, reach their rows by a broadcast; these rows then take keys of
    their own, which meet nothing and spread.
    """
    names = [c for c in groups.columns if c not in (key, size)]
    hot = groups.where(F.col(size) > F.lit(hot_size(total, hot_groups or HOT_GROUPS))).select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) + 1
    marked = marked.withColumn("_own", F.when(F.col("_hot_key").isNull(), F.lit(0).cast("long")).otherwise(own))
    # zero, but not a constant, which would be taken out of the join
    rest = groups.select(F.col(key).alias("_rest_key"), F.pmod(F.xxhash64(key), F.lit(1).cast("long")).alias("_rest_own"), F.struct(*names).alias("_rest"))
    met = marked.join(rest, (F.col(key) == F.col("_rest_key")) & (F.col("_own") == F.col("_rest_own")), "left")
    return met.select(*rows.columns, *[F.coalesce(F.col("_hot").getField(c), F.col("_rest").getField(c)).alias(c) for c in names])


def small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """df, kept in the shared folder, to be broadcast if it has at most `most` rows; they should be short ones."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def packed(df: DataFrame, text_col: str, id_col: str, outputs: list[str], carry: list[str] | None = None) -> DataFrame:
    """_id, _text (null becomes empty) and _row, a struct of the carried columns that no result column replaces."""
    taken = {name.lower() for name in outputs}
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    row = F.struct(*[df[f"`{c}`"] for c in names]) if names else F.struct(F.lit(0).alias("_none"))
    return df.select(df[f"`{id_col}`"].alias("_id"), F.coalesce(df[f"`{text_col}`"].cast("string"), F.lit("")).alias("_text"), row.alias("_row"))


def unpacked(df: DataFrame, **outputs: Column) -> DataFrame:
    """The carried columns, then the result columns."""
    names = [c for c in df.schema["_row"].dataType.names if c != "_none"]
    return df.select(*[F.col("_row").getField(c).alias(c) for c in names], *[column.alias(name) for name, column in outputs.items()])
