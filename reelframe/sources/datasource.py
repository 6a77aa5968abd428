"""A data source for Spark: spark.read.format("containers").load(folder) gives a row for each box.

    spark.dataSource.register(ContainerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("containers").option("payloads", "true").load("/media").where("type = 'stsd'")

Files are dealt into partitions by number and size.  Filters on type, and on file_id by equality or by how it begins, are
taken over by the source: files that cannot match are not opened, and of the others only headers and the top-level boxes
that may hold a wanted type are read.  Media and padding are never read.

Options: payloads (false), strict (true), files (the most of a partition, 64), bytes (of a partition's files, 256 MiB).
Paths are those that pyarrow opens (local and mounted folders, hdfs, s3, gs).

Defined results: only names that end in .mp4, .mov or .m4v in any case are read; an empty folder, or one without such
names, has no row; a file that is cut short has its boxes with the reason in `error`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from reelframe.sources.containers import ACCEPTED_NAME, BOXES, CONTAINERS, Rows
from reelframe.sources.ranges import _place, box_rows


@dataclass
class Files(InputPartition):
    """The files of a partition."""

    names: list[str]


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return BOXES + (", payload binary" if _true(self.options.get("payloads"), False) else "")

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(dict(self.options))


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payloads, self.strict = _true(options.get("payloads"), False), _true(options.get("strict"), True)
        self.most_files, self.most_bytes = int(options.get("files", 64)), int(options.get("bytes", 256 << 20))
        self.types: set[str] | None = None
        self.names: set[str] | None = None
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what it can; the rest is for Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("type",):
                self.types = values if self.types is None else self.types & values
            elif values is not None and f.attribute == ("file_id",):
                self.names = values if self.names is None else self.names & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("file_id",):
                self.starts.append(f.value)
            else:
                yield f

    def _asked(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(name.startswith(s) for s in self.starts)

    def partitions(self) -> list[Files]:
        store, path = _place(self.path)
        scheme = re.match(r"^\w+://", self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        out, names, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            name = f"{scheme.group(0)}{info.path.lstrip('/')}" if scheme and scheme.group(0) != "file://" else f"file://{info.path}" if scheme else info.path
            if info.type != fs.FileType.File or not re.search(ACCEPTED_NAME, info.path.lower()) or not self._asked(name):
                continue
            if names and (len(names) >= self.most_files or size + info.size > self.most_bytes):
                out.append(Files(names))
                names, size = [], 0
            names.append(name)
            size += info.size
        return [*out, Files(names)] if names else out or [Files([])]

    def _reads(self, kind: str) -> bool:
        """Whether a top-level box is read: it may hold a wanted type, or is one itself and may be damaged."""
        return self.types is None or kind in self.types or (kind in CONTAINERS and bool(self.types - {"ftyp", "mdat", "free", "skip", "wide"}))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        out = Rows(BOXES + (", payload binary" if self.payloads else ""))
        for name in partition.names:
            store, path = _place(name)
            with store.open_input_file(path) as file:
                rows = box_rows(name, file, file.size(), self.payloads, self.strict, self._reads)
            if self.types is not None:
                rows = [r for r in rows if r[6] in self.types]
            yield from out.add(rows, sum(len(r[-1] or b"") for r in rows) if self.payloads else 0)
        yield from out.rest()


def _true(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() in ("true", "1", "yes")
