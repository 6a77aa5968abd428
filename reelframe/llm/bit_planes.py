"""Token ids in binary files of bit planes.

A file holds the ids of whole documents, cut into blocks of block_ids ids.  A block is transposed into planes: all the
lowest bytes (or bits) together, then all the next ones, and so on.  High planes are nearly constant, so each plane is
compressed by itself with zstandard.  The head of the file has an index of the blocks and a table of the documents.

    magic b"RFBP1\\n" | kind u8 | documents u32 | blocks u32 | for each document: ids u64 |
    for each block: ids u32, planes u8, for each plane: bytes u32 | the planes

Files are the column `file` of a Parquet table, so that Spark's committer writes them in any store and a lost task
leaves none behind.  Rows are in ascending order of id: part, then number in the part.

Defined results: null ids come first; a null text counts as empty; repeated rows are stored as often as they occur, in
any order; a document is never split over files, so that one of any length makes a long file; an empty table gives an
empty store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelframe.llm.common import packed
from reelframe.llm.piece_cache import library_cache

MAGIC = b"RFBP1\n"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 20
LEVEL = 3
STORED = {"part": pa.int32(), "number": pa.int32(), "first": pa.int64(), "n_ids": pa.int64(), "ids_of": pa.list_(pa.int64()), "file": pa.binary()}


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first, without the highest ones if they are zero throughout."""
    if kind == "byte":
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    else:
        planes = np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T, axis=1, bitorder="little")
    used = np.flatnonzero(planes.any(axis=1))
    return [p.tobytes() for p in planes[: used[-1] + 1 if len(used) else 0]]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The n ids of a block."""
    if kind == "byte":
        whole = np.zeros((4, n), np.uint8)
        for k, plane in enumerate(planes):
            whole[k] = np.frombuffer(plane, np.uint8)
        return np.ascontiguousarray(whole.T).view("<u4").reshape(-1)
    bits = np.zeros((32, n), np.uint8)
    for k, plane in enumerate(planes):
        bits[k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").reshape(-1)


def write_file(lengths: list[int], ids: np.ndarray, kind: str = "byte", block_ids: int = BLOCK_IDS) -> bytes:
    """A file of documents with the given numbers of ids."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    index, body = [], []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        planes = [squeeze(p) for p in to_planes(block, kind)]
        index.append(struct.pack(f"<IB{len(planes)}I", len(block), len(planes), *map(len, planes)))
        body += planes
    head = MAGIC + struct.pack("<BII", kind == "bit", len(lengths), len(index)) + np.array(lengths, "<u8").tobytes()
    return head + b"".join(index) + b"".join(body)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of ids of the documents, all ids) of a file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of bit planes")
    at = len(MAGIC)
    bits, documents, blocks = struct.unpack_from("<BII", data, at)
    at += 9
    lengths = np.frombuffer(data, "<u8", documents, at).astype(np.int64)
    at += 8 * documents
    index = []
    for _ in range(blocks):
        n, planes = struct.unpack_from("<IB", data, at)
        index.append((n, struct.unpack_from(f"<{planes}I", data, at + 5)))
        at += 5 + 4 * planes
    expand, out = zstandard.ZstdDecompressor().decompress, []
    for n, sizes in index:
        planes = []
        for size in sizes:
            planes.append(expand(data[at : at + size]))
            at += size
        out.append(from_planes(planes, n, "bit" if bits else "byte"))
    return lengths, np.concatenate(out) if out else np.zeros(0, "<u4")


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", file_ids: int = FILE_IDS) -> None:
    """Encodes the texts with a tokenizer file, appends end_id to each and writes the store to path, in order of id.

    The texts are dealt out by ranges of the id, then sorted and encoded range by range.  Rows of one id, or without one,
    are told apart by their text and place, so any number of them spreads over tasks.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        names, parts, size = [], [], 0

        def closed() -> pa.RecordBatch:
            lengths = [len(p) // 4 for p in parts]
            data = write_file(lengths, np.frombuffer(b"".join(parts), "<u4"), kind)
            values = (part, number, first, sum(lengths), names, data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, STORED.values(), strict=True)], list(STORED))

        with library_cache(vocabulary).task() as cache:
            for batch in batches:
                coded = cache.encode(text.as_py() for text in batch.column(1))
                for name, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                    names.append(name)
                    parts.append(ids + end)
                    size += len(parts[-1]) // 4
                    if size >= file_ids:
                        yield closed()
                        number, first, names, parts, size = number + 1, first + size, [], [], 0
        if parts:
            yield closed()

    kept = packed(df, text_col, id_col, [], []).select(F.col("_id").cast("long").alias("_id"), "_text")
    keyed = kept.select("_id", "_text", F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("_id").asc_nulls_first(), "_hash", "_row"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    ordered.mapInArrow(files, "part int, number int, first long, n_ids long, ids_of array<long>, file binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a store: start counts the ids of all documents before, ids are little-endian u32."""
    store = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part, as many as the writer had tasks
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("ids_of")
            for k, (base, first) in enumerate(zip(batch.column("base").to_pylist(), batch.column("first").to_pylist(), strict=True)):
                lengths, ids = read_file(batch.column("file")[k].as_py())
                ends = np.cumsum(lengths)
                data = ids.tobytes()
                texts = [data[4 * (e - n) : 4 * e] for n, e in zip(lengths, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([names[k].values, pa.array(base + first + ends - lengths), pa.array(texts, pa.binary())], ["doc_id", "start", "ids"])

    rows = store.join(F.broadcast(offsets), "part").select("base", "first", "ids_of", "file")
    return rows.mapInArrow(documents, "doc_id long, start long, ids binary")
