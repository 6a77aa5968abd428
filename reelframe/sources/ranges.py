"""Containers read and written by ranges: a file of any size costs its headers and its index, and the media is copied in parts.

files has file_id, a path or URI that pyarrow can open (local and mounted folders, hdfs, s3, gs), and file_size.  Files
in other stores are read by containers.read_files.  Each file is one row, so the work spreads over the files.

Defined results: a file that is not there, or cannot be opened, fails the task; one without a box has no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.sources.containers import BOXES, CONTAINERS, MAX_TOP_LEVEL, Rows, accepted, has_payload, header, tree
from reelframe.sources.rewrites import Declined, laid_out

WRITTEN = "file_id string, path string, bytes long, offsets_moved long, passes int, error string"
COPY_BYTES = 8 << 20


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, file_size) of the accepted files of a folder that are not empty; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(accepted(F.col("path"))).select(F.col("path").alias("file_id"), F.col("length").alias("file_size"))


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", uri))


def _scan(file, size: int) -> Iterator[tuple[str, int, int, int, bool]]:
    """Headers of the boxes of an open file, 16 bytes read of each."""
    start = 0
    for _ in range(MAX_TOP_LEVEL):
        file.seek(start)
        found = header(file.read(16), size - start)
        if found is None:
            return
        kind, n, head, large = found
        yield kind, start, n, head, large
        start += n


def box_rows(name: str, file, size: int, payloads: bool = False, strict: bool = True, wanted: Callable[[str], bool] | None = None) -> list[tuple]:
    """The rows of the boxes of an open file.  wanted: whether a top-level box of a type is to be read at all; others have their header's row."""
    rows: list[tuple] = []
    for k, (kind, start, n, head, large) in enumerate(_scan(file, size)):
        read = (kind in CONTAINERS or kind == "ftyp") and (wanted is None or wanted(kind))
        data = b""
        if read:
            file.seek(start)
            data = file.read(n)
            if len(data) == n:
                rows += [(name, *r, *[data[r[6] - start + r[8] : r[9] - start] if has_payload(r[5]) else None] * payloads) for r in tree(data, (kind, 0, n, head, large), len(rows), k, strict, start)]
                continue
        short = f"{len(data)} of {n} bytes could be read" if read else None
        rows.append((name, len(rows), -1, 0, k, f"{kind}[{k}]", kind, start, n, head, start + n, large, short, *[None] * payloads))
    return rows


def boxes(files: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """The rows of containers.boxes, of which media and padding are never read; a box that is cut short has an error."""
    schema = BOXES + (", payload binary" if payloads else "")

    def rows_of(name: str) -> list[tuple]:
        store, path = _place(name)
        with store.open_input_file(path) as file:
            return box_rows(name, file, file.size(), payloads, strict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = rows_of(name)
                yield from out.add(rows, sum(len(r[-1] or b"") for r in rows) if payloads else 0)
        yield from out.rest()

    return files.select("file_id").mapInArrow(run, schema)


def write_rewrites(files: DataFrame, folder: str, suffix: str = "remuxed", retag: bool = False) -> DataFrame:
    """Lossless rewrites written to folder, which all executors reach; as WRITTEN, one row a file.

    names: the files have a column output_name, unique in the folder, or else take their own stem and suffix.  A file
    is written under a name of its own and then moved into place, so a task that runs again leaves one whole file.
    """
    from reelframe.functions.formats import output_name

    base = F.regexp_extract("file_id", r"([^/]*)$", 1)
    named = files.select("file_id", F.col("output_name") if "output_name" in files.columns else output_name(base, suffix).alias("output_name"))

    def one(name: str, out: str) -> tuple:
        store, path = _place(name)
        with store.open_input_file(path) as file:

            def read(start: int, size: int) -> bytes:
                file.seek(start)
                return file.read(size)

            try:
                front, (start, size), moved, turns = laid_out(list(_scan(file, file.size())), read, retag)
            except Declined as why:
                return name, None, None, None, None, str(why)
            target, place = _place(f"{folder.rstrip('/')}/{out}")
            whole = f"{place}.{uuid.uuid4().hex}.part"
            with target.open_output_stream(whole) as sink:
                sink.write(front)
                for at in range(start, start + size, COPY_BYTES):
                    sink.write(read(at, min(COPY_BYTES, start + size - at)))
            target.move(whole, place)
        return name, f"{folder.rstrip('/')}/{out}", len(front) + size, moved, turns, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = Rows(WRITTEN)
        for batch in batches:
            for name, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from done.add([one(name, out)])
        yield from done.rest()

    return named.mapInArrow(run, WRITTEN)


HEADS = "file_id string, file_size long, brand binary, index binary"
OBSERVED = "file_id string, path string, bytes long, error string"


def heads(files: DataFrame) -> DataFrame:
    """(file_id, file_size, brand, index): the first ftyp and moov boxes of each file, null where there is none; media is not read."""

    def one(name: str) -> tuple:
        store, path = _place(name)
        with store.open_input_file(path) as file:
            found: dict[str, bytes] = {}
            for kind, start, size, _, _ in _scan(file, file.size()):
                if kind in ("ftyp", "moov") and kind not in found:
                    file.seek(start)
                    found[kind] = file.read(size)
            return name, file.size(), found.get("ftyp"), found.get("moov")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(HEADS)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                row = one(name)
                yield from out.add([row], len(row[2] or b"") + len(row[3] or b""))
        yield from out.rest()

    return files.select("file_id").mapInArrow(run, HEADS)


def copy_with_tail(read: Callable[[int, int], bytes], write: Callable[[bytes], object], front: bytes, start: int, size: int, pattern: bytes, times: int) -> int:
    """Writes front, a range of a source and a pattern that repeats, in parts of COPY_BYTES at most; returns the number of bytes."""
    write(front)
    for at in range(start, start + size, COPY_BYTES):
        part = read(at, min(COPY_BYTES, start + size - at))
        if len(part) != min(COPY_BYTES, start + size - at):
            raise OSError(f"the source ends before byte {start + size}")
        write(part)
    most = max(1, COPY_BYTES // len(pattern))
    part = pattern * min(most, times)
    for at in range(0, times, most):
        write(part if times - at >= most else pattern * (times - at))
    return len(front) + size + times * len(pattern)


def write_observed(files: DataFrame, folder: str, tag: str | None = None, suffix: str = "observed") -> DataFrame:
    """The opt-in rewrites of observed.transform written to folder, which all executors reach; as OBSERVED, one row a file.

    Names and places are those of write_rewrites: a task that runs again leaves one whole file.
    """
    from reelframe.functions.formats import output_name
    from reelframe.sources import observed
    from reelframe.storage import kept

    read = kept(heads(files))
    made = observed.transform_index(read.select("file_id", "file_size"), kept(boxes(files).where("depth = 0")), read.where("brand IS NOT NULL").select("file_id", F.col("brand").alias("_brand")), read.select("file_id", F.col("index").alias("content")), tag)
    base = F.regexp_extract("file_id", r"([^/]*)$", 1)
    named = files.select("file_id", (F.col("output_name") if "output_name" in files.columns else output_name(base, suffix)).alias("output_name"))
    rows = made.join(named, "file_id").select("file_id", "output_name", "front", "media_start", "media_size", "pad_samples", "error")

    def one(name: str, out: str, front: bytes | None, start: int, size: int, times: int, error: str | None) -> tuple:
        if error is not None:
            return name, None, None, error
        store, path = _place(name)
        target, place = _place(f"{folder.rstrip('/')}/{out}")
        part = f"{place}.{uuid.uuid4().hex}.part"
        with store.open_input_file(path) as file, target.open_output_stream(part) as sink:

            def read_range(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(n)

            n = copy_with_tail(read_range, sink.write, front, start, size, observed.PATTERN, times)
        target.move(part, place)
        return name, f"{folder.rstrip('/')}/{out}", n, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = Rows(OBSERVED)
        for batch in batches:
            for row in batch.to_pylist():
                yield from done.add([one(*row.values())])
        yield from done.rest()

    return rows.mapInArrow(run, OBSERVED)
