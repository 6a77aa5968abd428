"""Trees of boxes as rows: taken apart, edited by filters and joins, measured, and put together again.

A row is a box, named by its path within its file: its parent's path, its place among its siblings, its type and its
bytes.  Those are the payload of a box without boxes; of one with boxes, what lies before the first and behind the last
of them.  An edit takes rows and gives rows, so edits combine, and nothing holds an offset or a size that an edit would
make wrong.  Sizes are built from the deepest boxes up, one grouping and one join a level; bytes by a task that has a file's
rows together.  All of these are by file, so rows that are dealt out by file once shuffle no more.

Defined results: a file whose tree is malformed has one row with the reason in `error`, which edits leave alone, and no
bytes; a null content has no row; boxes that repeat in a place keep the order of their paths; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.decoders import AUDIO_HEAD, QT_EXTRA, VISUAL_HEAD
from reelframe.sources.containers import MAX_TOP_LEVEL, Malformed, Rows, headers, tree
from reelframe.storage import kept

NODES = "file_id string, path string, parent string, depth int, place double, type string, before binary, payload binary, after binary, error string"
#: Sample entries whose boxes are taken apart.
SOUNDS, PICTURES = ("mp4a", "enca"), ("avc1", "avc3", "hvc1", "hev1")
END = 1e9  # a place behind all siblings


def _entries(data: bytes, first: int, end: int, path: str, depth: int) -> list[tuple] | None:
    """The sample entries of an stsd payload and the boxes in them as rows; None if something is malformed."""
    rows = []
    try:
        found = list(headers(data, first + 8, end, strict=True))
        if not found or found[-1][1] + found[-1][2] != end:
            return None
        for k, (kind, at, size, head, _) in enumerate(found):
            name, stop = f"{path}/{kind}[{k}]", at + size
            fixed = size
            if kind in PICTURES:
                fixed = VISUAL_HEAD
            elif kind in SOUNDS and size >= AUDIO_HEAD:
                fixed = AUDIO_HEAD + QT_EXTRA.get(struct.unpack_from(">H", data, at + 16)[0], 0)
            if head != 8 or fixed > size:
                return None
            inner = list(headers(data, at + fixed, stop, strict=True)) if fixed < size else []
            last = inner[-1][1] + inner[-1][2] if inner else at + fixed
            body = (data[at + 8 : at + fixed], None, data[last:stop]) if kind in SOUNDS + PICTURES else (None, data[at + 8 : stop], None)
            rows.append((name, path, depth + 1, float(k), kind, *body, None))
            rows += [(f"{name}/{sub}[{j}]", name, depth + 2, float(j), sub, None, data[s + h : s + n], None, None) for j, (sub, s, n, h, _) in enumerate(inner)]
    except Malformed:
        return None
    return rows


def _nodes(data: bytes, kinds: tuple[str, ...], entries: bool) -> Iterator[tuple]:
    """The rows of a file without its name."""
    for k, box in enumerate(headers(data, 0, len(data), MAX_TOP_LEVEL)):
        if box[0] not in kinds:
            continue
        found = tree(data, box, 0, k)
        first, last, paths = {}, {}, {r[0]: r[4] for r in found}
        for r in found:
            first.setdefault(r[1], r[6])
            last[r[1]] = max(last.get(r[1], 0), r[9])
        for node, parent, depth, ordinal, path, kind, start, _, head, end, _, error in found:
            start += head
            if node in first and node >= 0 and first[node] < end and parent != node:
                body = (data[start : first[node]], None, data[last[node] : end])
            elif entries and kind == "stsd" and error is None and (inner := _entries(data, start, end, path, depth)) is not None:
                yield path, paths.get(parent, ""), depth, float(ordinal), kind, data[start : start + 8], None, None, None
                yield from inner
                continue
            else:
                body = (None, None if error else data[start:end], None)
            yield path, paths.get(parent, ""), depth, float(ordinal), kind, *body, error


def parts(files: DataFrame, kinds: tuple[str, ...] = ("moov",), entries: bool = False, key: str = "file_id", content: str = "content") -> DataFrame:
    """The boxes of the given top-level boxes of each file, as NODES; entries: those of sample descriptions too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(NODES)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py()
                if data is not None:
                    yield from out.add([(name, *row) for row in _nodes(data, kinds, entries)], len(data))
        yield from out.rest()

    return files.select(F.col(key).cast("string"), content).mapInArrow(run, NODES)


def plain(path: Column) -> Column:
    """A path without ordinals."""
    return F.regexp_replace(path, r"\[[^\]]*\]", "")


def _above(path: Column) -> Column:
    """The path of a box and of all around it."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def _marked(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with _root: the path of the root (file_id, path) that a row is or lies in, or null."""
    gone = roots.groupBy("file_id").agg(F.collect_set("path").alias("_roots"))
    return nodes.join(gone, "file_id", "left").withColumn("_root", F.get(F.array_intersect(_above(F.col("path")), F.col("_roots")), 0)).drop("_roots")


def without(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes without the boxes roots (file_id, path) and all within them."""
    return _marked(nodes, roots).where("_root IS NULL").drop("_root")


def within(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The boxes roots (file_id, path) and all within them."""
    return _marked(nodes, roots).where("_root IS NOT NULL").drop("_root")


def replaced(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with other payloads: changes has (file_id, path, payload), a row for a box at most.

    The few changes of a file meet its rows as a map, so that the join is by file as all others.
    """
    each = F.map_from_entries(F.collect_list(F.struct("path", "payload"))).alias("_new")
    new = changes.where("path IS NOT NULL AND payload IS NOT NULL").groupBy("file_id").agg(each)
    value = F.coalesce(F.try_element_at("_new", F.col("path")), F.col("payload"))
    return nodes.join(new, "file_id", "left").select(*[value.alias("payload") if c == "payload" else c for c in nodes.columns])


def added(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """nodes and leaves (file_id, parent, type, place, payload), whose parents are boxes of nodes or among the leaves' own.

    A leaf may bring a path and a depth, for others to lie in it; a new path ends in [+], and in a number where leaves of
    one type are several.
    """
    columns = [c.split()[0] for c in NODES.split(", ")]
    named = leaves if "path" in leaves.columns else leaves.withColumn("path", F.concat("parent", F.lit("/"), "type", F.lit("[+]")))
    if "depth" not in leaves.columns:
        named = named.join(nodes.select("file_id", F.col("path").alias("parent"), (F.col("depth") + 1).alias("depth")), ["file_id", "parent"])
    for name in ("before", "after", "error"):
        named = named.withColumn(name, F.lit(None).cast("string" if name == "error" else "binary"))
    return nodes.unionByName(named.select(*[F.col(c).cast("double") if c == "place" else F.col(c) for c in columns]))


def copied(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The boxes of roots (file_id, path, copy, place) and all within, as rows of their own: copy is the new path of the root, place its place."""
    inside = nodes.join(roots.select("file_id", F.col("path").alias("_root"), "copy", F.col("place").alias("_place")), "file_id")
    is_root = F.col("path") == F.col("_root")
    inside = inside.where(is_root | F.col("path").startswith(F.concat("_root", F.lit("/"))))
    moved = {
        "path": F.concat("copy", F.expr("substring(path, length(_root) + 1)")),
        "parent": F.when(is_root, F.col("parent")).otherwise(F.concat("copy", F.expr("substring(parent, length(_root) + 1)"))),
        "place": F.when(is_root, F.col("_place")).otherwise(F.col("place")),
    }
    return inside.select(*[moved.get(c, F.col(c)).alias(c) for c in nodes.columns])


def _levels(nodes: DataFrame, own: Column, joined: Callable[[Column], Column], boxed: Callable[[Column], Column], empty: Column) -> list[DataFrame]:
    """For each depth from the deepest up (file_id, path, parent, place, made): boxed of own and of what the boxes within have made."""
    rows = kept(nodes.where("error IS NULL").repartition("file_id"))
    deepest = rows.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = rows.where(F.col("depth") == depth)
        if levels:
            below = levels[-1].groupBy("file_id", F.col("parent").alias("path")).agg(joined(F.array_sort(F.collect_list(F.struct("place", "path", "made")))).alias("_inside"))
            here = here.join(below, ["file_id", "path"], "left").withColumn("_inside", F.coalesce("_inside", empty))
        else:
            here = here.withColumn("_inside", empty)
        levels.append(here.select("file_id", "path", "parent", "place", "type", boxed(own).alias("made")))
    return levels


def measured(nodes: DataFrame) -> DataFrame:
    """(file_id, path, size) of all boxes: what each will take, with the larger header where four bytes cannot hold it.

    Where nodes has a column `length`, it is the number of bytes of a payload that is not there.
    """
    bare = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("before", "payload", "after")]
    if "length" in nodes.columns:
        bare.append(F.coalesce(F.col("length"), F.lit(0)).cast("long"))
    own = sum(bare[1:], bare[0])
    levels = _levels(nodes, own, lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["made"]), lambda own: size_of(own + F.col("_inside")), F.lit(0).cast("long"))
    out = nodes.sparkSession.createDataFrame([], "file_id string, path string, size long")
    for level in levels:
        out = out.unionByName(level.select("file_id", "path", F.col("made").alias("size")))
    return out


def size_of(body: Column) -> Column:
    """The size of a box with a body of so many bytes."""
    return body + F.when(body + 8 > (1 << 32) - 1, 16).otherwise(8)


@lru_cache(4096)
def _name(kind: str) -> bytes | None:
    """binary.unescaped() of a type."""
    parts = re.findall(r"(?s)\\x[0-9a-f]{2}|.", kind)
    return b"".join(bytes.fromhex(x[2:]) if len(x) == 4 else x.encode("latin-1", "replace") for x in parts) if len(parts) == 4 else None


def _together(rows: list[tuple]) -> bytes | None:
    """The bytes of one file's boxes (path, parent, depth, place, type, before, payload, after), from the deepest up; None if none is at the top."""
    inside: dict[tuple, list] = {}
    for path, parent, depth, place, kind, before, payload, after in sorted(rows, key=lambda r: -r[2]):
        held = b"".join(made for *_, made in sorted(inside.get((depth + 1, path), ())))
        body, name = b"".join((before or b"", payload or b"", held, after or b"")), _name(kind)
        if name is not None:
            inside.setdefault((depth, parent if depth else None), []).append((place, path, struct.pack(">I", len(body) + 8) + name + body))
    top = inside.get((0, None))
    return None if top is None else b"".join(made for *_, made in sorted(top))


def assembled(nodes: DataFrame) -> DataFrame:
    """(file_id, content): the bytes of the top-level boxes of each file, one behind the other; one shuffle brings a file's rows together."""
    schema = "file_id string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, rows = Rows(schema), None, []
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != file and rows:
                    if (content := _together(rows)) is not None:
                        yield from out.add([(file, content)], len(content))
                    rows = []
                file = name
                rows.append(tuple(row))
        if rows and (content := _together(rows)) is not None:
            yield from out.add([(file, content)], len(content))
        yield from out.rest()

    rows = nodes.where("error IS NULL").select("file_id", "path", "parent", "depth", "place", "type", "before", "payload", "after")
    return rows.repartition("file_id").sortWithinPartitions("file_id").mapInArrow(run, schema)


def without_edit_lists(nodes: DataFrame) -> DataFrame:
    """nodes without the edit lists of tracks; a path says by itself whether it leads through one."""
    return nodes.where(~F.col("path").rlike(r"(^|/)trak(\[[^\]]*\])*/edts\[[^\]]*\](/|$)"))


def edit_lists(nodes: DataFrame) -> DataFrame:
    """(file_id, path, parent) of the edit lists that lie directly in a track."""
    return nodes.where((F.col("type") == "edts") & plain(F.col("parent")).rlike("(^|/)trak$")).select("file_id", "path", "parent")


def tagged_encoder(nodes: DataFrame, tag: Column | str, kind: str = r"\xa9too") -> DataFrame:
    """nodes in which each list of tags (ilst) names an encoder: in place of every such tag, or behind the others.

    tag: a text, or a column of nodes that is alike in a file.  A file without a list of tags stays as it is; no box
    around one is made.
    """
    value = F.lit(tag) if isinstance(tag, str) else tag
    lists = nodes.where(F.col("type") == "ilst").select("file_id", F.col("path").alias("parent"), (F.col("depth") + 1).alias("depth"), value.alias("_tag"))
    old = nodes.where(F.col("type") == kind).select("file_id", "parent", "path", "place").join(lists, ["file_id", "parent"])
    fresh = lists.join(old.select("file_id", "parent").distinct(), ["file_id", "parent"], "left_anti")
    new = old.drop("path").unionByName(fresh.withColumn("place", F.lit(END)), allowMissingColumns=True)
    spot = F.regexp_replace(F.col("place").cast("string"), r"\.0$", "")
    boxes = new.select("file_id", "parent", F.lit(kind).alias("type"), "place", F.concat("parent", F.lit(f"/{kind}[+"), spot, F.lit("]")).alias("path"), "depth", F.lit(None).cast("binary").alias("payload"), "_tag")
    data = F.concat(F.unhex(F.lit("0000000100000000")), F.encode("_tag", "UTF-8"))
    leaves = boxes.select("file_id", F.col("path").alias("parent"), F.lit("data").alias("type"), F.lit(0.0).alias("place"), F.concat("path", F.lit("/data[+]")).alias("path"), (F.col("depth") + 1).alias("depth"), data.alias("payload"))
    return added(without(nodes, old.select("file_id", "path")), boxes.drop("_tag").unionByName(leaves))
