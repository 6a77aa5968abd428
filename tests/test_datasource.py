"""The data source and the sink of ranges."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from reelframe.sources import containers, datasource, ranges
from test_observed import source, target
from test_trees import written


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("media")
    for k in range(12):
        (path / f"clip{k}.{'mp4 MOV m4v'.split()[k % 3]}").write_bytes(source(after=k % 2 == 0, n=2 * (k + 1)) + (written((b"free", bytes(1000))) if k == 3 else b""))
    (path / "cut.mp4").write_bytes(source()[:200])
    (path / "note.txt").write_bytes(b"no container")
    return str(path)


class Counted:
    """A file that counts the bytes it gives."""

    def __init__(self, file):
        self.file, self.given = file, 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        self.given += len(data)
        return data


def test_rows_are_those_of_whole_files(spark, folder):
    spark.dataSource.register(datasource.ContainerSource)
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:", "").alias("file_id"), "content").where(~F.col("path").like("%.txt") & ~F.col("path").like("%cut.mp4"))
    want = {tuple(r) for r in containers.boxes(files, payloads=True).collect()}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("containers").option("payloads", "true").option("files", "5").load(folder)
        assert read.rdd.getNumPartitions() == 3
        got = {tuple(r) for r in read.where("file_id NOT LIKE '%cut.mp4'").collect()}
        assert got == want and len(got) > 200
        only = read.where("type = 'stco' AND file_id LIKE '%/clip1%'")  # a like that Spark itself applies
        assert {tuple(r) for r in only.collect()} == {r for r in want if r[6] == "stco" and "/clip1" in r[0]}
        assert {r["type"] for r in read.where(F.col("type").isin("ftyp", "mdat")).collect()} == {"ftyp", "mdat"}
        one = read.where(F.col("file_id") == f"{folder}/clip3.mp4")
        assert one.rdd.getNumPartitions() == 1 and one.where("type = 'free'").count() == 1
        short = read.where("file_id LIKE '%cut.mp4' AND error IS NOT NULL").collect()
        assert len(short) <= 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_what_is_asked_for_is_read(tmp_path):
    data = source(media=bytes(3_000_000))
    path = tmp_path / "a.mp4"
    path.write_bytes(data)

    def given(types):
        reader = datasource.ContainerReader({"path": str(tmp_path)})
        reader.types = types
        with path.open("rb") as file:
            counted = Counted(file)
            ranges.box_rows("a", counted, len(data), wanted=reader._reads)
        return counted.given

    index = len(data) - 3_000_000
    assert given({"ftyp"}) < 100 and given({"mdat"}) < 100 and given({"mdat", "free"}) < 100
    assert 300 < given({"stco"}) <= index + 48 and given(None) <= index + 48


def test_partitions_by_number_and_size(folder, tmp_path):
    assert [len(p.names) for p in datasource.ContainerReader({"path": folder, "files": "4"}).partitions()] == [4, 4, 4, 1]
    assert len(datasource.ContainerReader({"path": folder, "bytes": "2000"}).partitions()) > 4
    assert [p.names for p in datasource.ContainerReader({"path": str(tmp_path)}).partitions()] == [[]]


def test_observed_files_by_ranges(spark, folder, tmp_path):
    files = ranges.list_files(spark, folder).where("file_id NOT LIKE '%cut%'")
    rows = {r["file_id"].rsplit("/", 1)[1]: r for r in ranges.write_observed(files, str(tmp_path), "a tag").collect()}
    assert len(rows) == 12 and all(r["error"] is None for r in rows.values())
    for k in range(12):
        name = f"clip{k}.{'mp4 MOV m4v'.split()[k % 3]}"
        data = open(rows[name]["path"], "rb").read()
        assert data == target("a tag", n=2 * (k + 1)) and rows[name]["bytes"] == len(data)


def test_a_tail_of_two_gigabytes_in_little_memory():
    written_bytes, last = 0, b""

    def write(part):
        nonlocal written_bytes, last
        written_bytes, last = written_bytes + len(part), bytes(part[-8:])

    tracemalloc.start()
    n = ranges.copy_with_tail(lambda at, size: bytes(size), write, b"front", 0, 20 << 20, b"\0\0\0\4\0\0\0\0", (2 << 30) // 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == written_bytes == 5 + (20 << 20) + (2 << 30) and last == b"\0\0\0\4\0\0\0\0" and peak < 64 << 20
    with pytest.raises(OSError, match="ends before"):
        ranges.copy_with_tail(lambda at, size: b"short", write, b"", 0, 100, b"12345678", 0)
    for times in (0, 1, 1 << 20, (1 << 20) + 1):
        assert ranges.copy_with_tail(lambda at, size: bytes(size), lambda part: None, b"", 0, 0, b"12345678", times) == 8 * times
