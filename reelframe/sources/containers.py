"""Boxes of media containers that are already a binary column.

walk() reads headers only, so a payload is never copied unless it is asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Boxes that hold boxes, the deepest level, and how many boxes a file may have at the top.
CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "edts", "udta", "dinf", "mvex", "moof", "traf", "ilst", "meta"}
MAX_DEPTH, MAX_TOP_LEVEL = 32, 4096
NO_PAYLOAD = {"mdat", "free", "skip", "wide"}
ACCEPTED_TYPES, ACCEPTED_NAME, INTAKE = ("video/mp4", "video/quicktime", "video/x-m4v"), r"\.(mp4|mov|m4v)$", 8
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
#: Rows and bytes that make an Arrow batch full.
MOST_ROWS, MOST_BYTES = 20_000, 32 << 20
BOXES = "file_id string, node_id int, parent_id int, depth int, child_ordinal int, path string, type string, start long, size long, header_size int, end long, large boolean, error string"


def fourcc(raw: bytes) -> str:
    """Four characters; bytes that are not printable as \\xNN."""
    return "".join(chr(b) if 0x20 <= b <= 0x7E else f"\\x{b:02x}" for b in raw)


def header(raw: bytes, room: int) -> tuple[str, int, int, bool] | None:
    """(type, size, header size, large) of the box that begins with raw, 16 bytes of it if there are, with room bytes to the end; None if malformed."""
    if room < 8 or len(raw) < 8:
        return None
    size, kind = struct.unpack_from(">I4s", raw)
    head, large = 8, size == 1
    if large:
        if len(raw) < 16:
            return None
        head, size = 16, struct.unpack_from(">Q", raw, 8)[0]
    elif size == 0:
        size = room
    return (fourcc(kind), size, head, large) if head <= size <= room else None


class Malformed(ValueError):
    """What is wrong with a tree of boxes that has to be whole."""


def _alike(data: bytes, start: int, size: int, most: int) -> int:
    """How many neighbours of a size, `most` at most, begin with the eight bytes at start; each look goes as far as was found alike before."""
    count, first = 1, np.frombuffer(data, "<u8", 1, start)[0]
    while count < most:
        n = min(count, most - count)
        differ = np.ndarray(n, "<u8", data, start + count * size, (size,)) != first
        if differ.any():
            return count + int(differ.argmax())
        count += n
    return count


def runs(data: bytes, start: int, end: int, most: int | None = None, strict: bool = False, base: int = 0) -> Iterator[tuple[str, int, int, int, bool, int]]:
    """(type, start, size, header size, large, count) of neighbouring boxes, `most` of them if given; those with one header in a row are a run.

    A malformed size ends them, or is Malformed if strict; base is added to the offset that is named then.  Up to seven
    bytes behind the last box have no room for another one and are left alone.
    """
    count = 0
    while end - start >= 8 and (most is None or count < most):
        found = header(data[start : min(end, start + 16)], end - start)
        if found is None:
            if strict:
                raise Malformed(f"malformed '{fourcc(data[start + 4 : start + 8])}' box at offset {base + start}, where {end - start} byte(s) are left")
            return
        kind, size, head, large = found
        room, n = (end - start) // size, 1
        if not large and (room := room if most is None else min(room, most - count)) > 1 and data[start : start + 8] == data[start + size : start + size + 8]:
            n = _alike(data, start, size, room)
        yield kind, start, size, head, large, n
        start, count = start + n * size, count + n


def headers(data: bytes, start: int, end: int, most: int | None = None, strict: bool = False, base: int = 0) -> Iterator[tuple[str, int, int, int, bool]]:
    """(type, start, size, header size, large) of neighbouring boxes one by one, as runs() finds them."""
    for kind, at, size, head, large, n in runs(data, start, end, most, strict, base):
        for k in range(n):
            yield kind, at + k * size, size, head, large


def inner_start(data: bytes, first: int, end: int) -> int:
    """Where the boxes within a meta begin: behind four bytes of version and flags, unless it has the plain form."""
    plain = end - first >= 12 and data[first + 4 : first + 8] in (b"hdlr", b"ilst", b"keys")
    return first if plain else min(first + 4, end)


def _holds(kind: str, above: str) -> bool:
    """Whether a box of a type, in one of type `above`, holds boxes."""
    return kind != "stsd" and (kind in CONTAINERS or above == "ilst")


def runs_below(data: bytes, box: tuple, node: int = 0, ordinal: int = 0, strict: bool = True, base: int = 0) -> Iterator[tuple]:
    """The top-level box of a header and all boxes within, in pre-order and numbered from node, as runs of neighbours.

    A run is (node, parent, depth, ordinal, path without ordinal, type, start, size, header size, large, error, count) of
    its first box; boxes that hold boxes are runs of one.
    """
    waiting = [(*box, 1, -1, 0, ordinal, box[0], "")]
    while waiting:
        kind, start, size, head, large, n, parent, depth, ordinal, name, above = waiting.pop()
        yield node, parent, depth, ordinal, name, kind, base + start, size, head, large, None, n
        if _holds(kind, above):
            if depth > MAX_DEPTH:
                if strict:
                    raise Malformed(f"boxes are nested more than {MAX_DEPTH} levels deep")
            else:
                end, k, inside = start + size, 0, []
                first = inner_start(data, start + head, end) if kind == "meta" and above != "ilst" else start + head
                for sub, at, size, head, large, m in runs(data, first, end, None, strict, base):
                    each = 1 if _holds(sub, kind) else m
                    inside += [(sub, at + j * size, size, head, large, each, node, depth + 1, k + j, f"{name}[{ordinal}]/{sub}", kind) for j in range(0, m, each)]
                    k += m
                waiting += inside[::-1]
        node += n


def tree_runs(data: bytes, box: tuple, node: int = 0, ordinal: int = 0, strict: bool = True, base: int = 0) -> list[tuple]:
    """runs_below() of a box.

    A moov is parsed strictly, as nothing in a damaged index can be trusted: if anything in it is malformed, it has one
    row with the reason and none for what it holds.
    """
    try:
        return list(runs_below(data, box, node, ordinal, strict and box[0] == "moov", base))
    except Malformed as why:
        kind, start, size, head, large = box
        return [(node, -1, 0, ordinal, kind, kind, base + start, size, head, large, str(why), 1)]


def _each(found: Iterable[tuple]) -> list[tuple]:
    """The boxes of runs, one by one."""
    return [
        (node + k, parent, depth, ordinal + k, f"{name}[{ordinal + k}]", kind, start + k * size, size, head, start + (k + 1) * size, large, error)
        for node, parent, depth, ordinal, name, kind, start, size, head, large, error, n in found for k in range(n)
    ]


def tree(data: bytes, box: tuple, node: int = 0, ordinal: int = 0, strict: bool = True, base: int = 0) -> list[tuple]:
    """The boxes of tree_runs() one by one, as walk() has them."""
    return _each(tree_runs(data, box, node, ordinal, strict, base))


def walk_runs(data: bytes, strict: bool = True) -> Iterator[tuple]:
    """All boxes of a file as runs of neighbours."""
    node = 0
    for k, box in enumerate(headers(data, 0, len(data), MAX_TOP_LEVEL)):
        found = tree_runs(data, box, node, k, strict)
        yield from found
        node = found[-1][0] + found[-1][-1]


def walk(data: bytes, strict: bool = True) -> Iterator[tuple]:
    """All boxes in pre-order as (node, parent, depth, ordinal, path, type, start, size, header size, end, large, error)."""
    yield from _each(walk_runs(data, strict))


def has_payload(kind: str) -> bool:
    return kind not in CONTAINERS and kind not in NO_PAYLOAD


class Rows:
    """Rows gathered into Arrow batches of bounded size, however many or few come from one file."""

    def __init__(self, schema: str, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> None:
        self.schema = pa.schema([(name, ARROW[kind]) for name, kind in (column.split() for column in schema.split(", "))])
        self.most_rows, self.most_bytes, self.rows, self.bytes = most_rows, most_bytes, [], 0

    def add(self, rows: list[tuple], size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows += rows
        self.bytes += size
        if len(self.rows) >= self.most_rows or self.bytes >= self.most_bytes:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0


def _batch(found: list[tuple], payloads: list[list], schema: pa.Schema, whole: bool) -> pa.RecordBatch:
    """Runs, each behind the name of its file, as columns: a row for each box, or with `whole` for each run."""
    file, node, parent, depth, ordinal, path, kind, start, size, head, large, error, count = zip(*found, strict=True)
    n = np.array([1] * len(count) if whole else count)
    run = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)

    def alike(name: str, values: tuple) -> pa.Array:
        return pa.array(values, schema.field(name).type).take(run)

    def stepped(first: tuple, step: tuple | int, more: int = 0) -> np.ndarray:
        return np.array(first)[run] + (np.array(step)[run] if isinstance(step, tuple) else step) * (nth + more)

    def paths() -> pa.Array:
        return pc.binary_join_element_wise(alike("path", path), "[", pc.cast(stepped(ordinal, 1), pa.string()), "]", "")

    made = {
        "file_id": lambda: alike("file_id", file), "node_id": lambda: stepped(node, 1), "parent_id": lambda: alike("parent_id", parent), "depth": lambda: alike("depth", depth), "child_ordinal": lambda: stepped(ordinal, 1), "path": paths,
        "type": lambda: alike("type", kind), "start": lambda: stepped(start, size), "size": lambda: alike("size", size), "header_size": lambda: alike("header_size", head), "end": lambda: stepped(start, size, 1), "large": lambda: alike("large", large),
        "error": lambda: alike("error", error), "payload": lambda: [x for values in payloads for x in values], "boxes": lambda: count,
    }
    values = [(made[f.name](), f.type) for f in schema]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in values], schema=schema)


def boxes(
    files: DataFrame, key: str = "file_id", content: str = "content", payloads: bool = False, strict: bool = True, kinds: Collection[str] | None = None, columns: Collection[str] | None = None, runs: bool = False, deepest: int | None = None
) -> DataFrame:
    """One row for each box of each file, as BOXES; with payloads, also the bytes of leaves other than media and padding.

    A null content has no boxes, as has one that begins with a malformed size.  A moov that is malformed anywhere has
    one row with the reason in `error` and no boxes within; with strict off, it has those before the malformed one.
    Where kinds, columns or deepest are given, rows of other types or below that depth, and other columns, are not made at
    all; what is read and judged stays the same.  runs: neighbours with
    the same type and size are one row, that of the first, with their number in `boxes`; it goes without payloads.
    """
    if runs and payloads:
        raise ValueError("a run of boxes has no one payload")
    schema = BOXES + (", payload binary" if payloads else "") + (", boxes long" if runs else "")
    schema = ", ".join(c for c in schema.split(", ") if columns is None or c.split()[0] in columns)
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in (column.split() for column in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bodies, rows, size = [], [], 0, 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if data is None:
                    continue
                for one in walk_runs(data, strict):
                    if (kinds is None or one[5] in kinds) and (deepest is None or one[2] <= deepest):
                        found.append((name, *one))
                        rows += 1 if runs else one[-1]
                        if payloads:
                            first, step, head, n = one[6], one[7], one[8], one[-1]
                            bodies.append([data[at + head : at + step] for at in range(first, first + n * step, step)] if has_payload(one[5]) else [None] * n)
                size += len(data) if payloads else 0
                if rows >= MOST_ROWS or size >= MOST_BYTES:
                    if found:
                        yield _batch(found, bodies, arrow, runs)
                    found, bodies, rows, size = [], [], 0, 0
        if found:
            yield _batch(found, bodies, arrow, runs)

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, file_size, content) of the accepted files of a folder; content is read only where it is asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(accepted(F.col("path"))).select(F.col("path").alias("file_id"), F.col("length").alias("file_size"), "content")


def accepted(name, mime_type=None):
    """Whether a file is taken in: by its type, or by the end of its name in any case."""
    named = F.lower(name).rlike(ACCEPTED_NAME)
    return named if mime_type is None else F.coalesce(mime_type.isin(*ACCEPTED_TYPES), F.lit(False)) | F.coalesce(named, F.lit(False))


def intake(files: DataFrame, queue: str, order: str, room: int = INTAKE, salts: int = 64) -> DataFrame:
    """files with taken: the first `room` of each queue in order are, the others are rejected.

    A queue of any length spreads over `salts` parts, of which each hands on `room` rows at most; the last place that is
    taken then goes to all rows of the queue.  Among equal orders a hash of the row decides; rows that are equal in
    all columns are taken or rejected together.  Rows without a queue are a queue.
    """
    place = F.struct(F.col(order).alias("o"), F.xxhash64(*[f"`{c}`" for c in files.columns]).alias("h"))
    keyed = files.select(F.col(queue).alias("_queue"), place.alias("_place"))
    parts = Window.partitionBy("_queue", F.pmod("_place.h", F.lit(salts))).orderBy("_place")
    near = keyed.withColumn("_n", F.row_number().over(parts)).where(F.col("_n") <= room)
    last = near.withColumn("_n", F.row_number().over(Window.partitionBy("_queue").orderBy("_place"))).where(F.col("_n") == room).select("_queue", F.col("_place").alias("_last"))
    met = files.withColumn("_at", place).join(last, F.col(queue).eqNullSafe(F.col("_queue")), "left")
    return met.select(*[f"`{c}`" for c in files.columns if c != "taken"], F.coalesce(F.col("_at") <= F.col("_last"), F.lit(True)).alias("taken"))


def children(found: DataFrame, parent: str, kind: str | None = None) -> DataFrame:
    """The direct children, of one type if given, of the boxes with the path `parent` (with or without ordinals)."""
    return found.where((parent_path(F.col("path")) == parent) | (plain_path(parent_path(F.col("path"))) == parent)).where(F.lit(True) if kind is None else F.col("type") == kind)


def first_child(found: DataFrame, parent: str, kind: str) -> DataFrame:
    """Of each file and parent the first child of a type."""
    row = F.min_by(F.struct(*found.columns), "child_ordinal")
    return children(found, parent, kind).groupBy("file_id", "parent_id").agg(row.alias("r")).select("r.*")


def find_all(found: DataFrame, kind: str) -> DataFrame:
    """All boxes of a type; node_id is their depth-first order."""
    return found.where(F.col("type") == kind)


def plain_path(path):
    """A path without ordinals."""
    return F.regexp_replace(path, r"\[\d+\]", "")


def parent_path(path):
    """The path of the box around."""
    return F.regexp_replace(path, r"/?[^/]*$", "")
