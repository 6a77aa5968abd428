"""Big-endian fields of binary columns, and tables of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(data: Column, offset: Column | int, width: int) -> Column:
    """The unsigned integer of `width` bytes at a byte offset, as a long; null beyond the end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    part = F.substring(data, (at + 1).cast("int"), F.lit(width))
    value = F.conv(F.hex(part), 16, 10)
    return F.when(F.octet_length(part) == width, (value if width < 8 else value.cast("decimal(20,0)")).cast("long"))


def encoded(value: Column, width: int) -> Column:
    """The unsigned integer in `width` bytes; a value that does not fit raises an error."""
    if width < 8:
        value = F.when((value >= 0) & (value < 1 << (8 * width)), value).otherwise(F.raise_error(F.lit(f"value does not fit {width} bytes")))
    return F.unhex(F.lpad(F.hex(value), 2 * width, "0"))


def _entries(data: Column, first: int, stride: int, declared: Column) -> Column:
    """Offsets of the entries of a table: as many as declared, or as many as there is room for."""
    n = F.least(declared, F.floor((F.octet_length(data) - first) / stride))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: k * stride + first)).otherwise(F.array().cast("array<bigint>"))


def _table(*parts: Column) -> Column:
    return F.concat(F.unhex(F.lit("00000000")), *parts)


def _joined(values: Column, each) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.hex(each(v))), ""))


def write_stts(runs: Column) -> Column:
    """A time-to-sample payload from an array of struct(count, delta)."""
    return _table(encoded(F.size(runs).cast("long"), 4), _joined(runs, lambda r: F.concat(encoded(r["count"], 4), encoded(r["delta"], 4))))


def read_stts(data: Column) -> Column:
    """An array of struct(count, delta); a declared count beyond the payload is cut."""
    return F.transform(_entries(data, 8, 8, unsigned(data, 4, 4)), lambda at: F.struct(unsigned(data, at, 4).alias("count"), unsigned(data, at + 4, 4).alias("delta")))


def write_stsz(sizes: Column) -> Column:
    """A sample-size payload with an explicit table."""
    return _table(F.unhex(F.lit("00000000")), encoded(F.size(sizes).cast("long"), 4), _joined(sizes, lambda v: encoded(v, 4)))


def read_stsz(data: Column) -> Column:
    """struct(count, total): the declared count, and the bytes of the entries that are there."""
    each, n = unsigned(data, 4, 4), unsigned(data, 8, 4)
    total = F.aggregate(F.transform(_entries(data, 12, 4, n), lambda at: unsigned(data, at, 4)), F.lit(0).cast("long"), lambda a, v: a + v)
    return F.struct(n.alias("count"), F.when(each > 0, each * n).otherwise(total).alias("total"))


def write_offsets(offsets: Column) -> Column:
    """struct(kind, data): 32-bit offsets where all fit, else 64-bit ones."""
    wide = F.exists(offsets, lambda v: v >= 1 << 32)
    n = encoded(F.size(offsets).cast("long"), 4)
    data = F.when(wide, _table(n, _joined(offsets, lambda v: encoded(v, 8)))).otherwise(_table(n, _joined(F.when(wide, F.array().cast("array<bigint>")).otherwise(offsets), lambda v: encoded(v, 4))))
    return F.struct(F.when(wide, "co64").otherwise("stco").alias("kind"), data.alias("data"))


def read_offsets(data: Column, kind: Column) -> Column:
    """The chunk offsets of either kind."""
    narrow = F.transform(_entries(data, 8, 4, unsigned(data, 4, 4)), lambda at: unsigned(data, at, 4))
    wide = F.transform(_entries(data, 8, 8, unsigned(data, 4, 4)), lambda at: unsigned(data, at, 8))
    return F.when(kind == "co64", wide).otherwise(narrow)


def nibbles(data: Column) -> Column:
    """The 4-bit values of a binary, the high one of each byte first."""
    return F.transform(F.split(F.regexp_replace(F.hex(data), "(.)(?=.)", "$1,"), ","), lambda c: F.conv(c, 16, 10).cast("int"))


def write_stsc(runs: Column) -> Column:
    """A sample-to-chunk payload from an array of struct(first_chunk, samples_per_chunk, description)."""
    return _table(encoded(F.size(runs).cast("long"), 4), _joined(runs, lambda r: F.concat(*[encoded(r[name], 4) for name in ("first_chunk", "samples_per_chunk", "description")])))


def read_stsc(data: Column) -> Column:
    """An array of struct(first_chunk, samples_per_chunk, description); a declared count beyond the payload is cut."""
    names = ("first_chunk", "samples_per_chunk", "description")
    return F.transform(_entries(data, 8, 12, unsigned(data, 4, 4)), lambda at: F.struct(*[unsigned(data, at + 4 * k, 4).alias(name) for k, name in enumerate(names)]))


def is_exact_table(data: Column, width: int) -> Column:
    """Whether a table's payload is as long as its count says, with entries of `width` bytes and nothing behind them."""
    return F.coalesce(F.octet_length(data) == 8 + unsigned(data, 4, 4) * width, F.lit(False))


def patched(data: Column, offset: Column | int, value: Column, width: int) -> Column:
    """data with the unsigned integer at a byte offset replaced; null where it lies beyond the end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    head, tail = F.substring(data, F.lit(1), at.cast("int")), F.substring(data, (at + width + 1).cast("int"), F.octet_length(data))
    return F.when(at + width <= F.octet_length(data), F.concat(head, encoded(value, width), tail))


def _by_version(data: Column, narrow: int, wide: int) -> tuple[Column, Column]:
    """(whether the version is 1, the offset of a field that depends on it)."""
    one = unsigned(data, 0, 1) == 1
    return one, F.when(one, wide).otherwise(narrow)


def media_duration(data: Column) -> Column:
    """The ticks of mdhd."""
    one, at = _by_version(data, 16, 24)
    return F.when(one, unsigned(data, at, 8)).otherwise(unsigned(data, at, 4))


def with_media_duration(data: Column, ticks: Column) -> Column:
    """mdhd with other ticks; more than four bytes hold are an error in version 0."""
    one, at = _by_version(data, 16, 24)
    return F.when(one, patched(data, at, ticks, 8)).otherwise(patched(data, at, F.when(~one, ticks), 4))


def track_number(data: Column) -> Column:
    """The track_ID of tkhd."""
    return unsigned(data, _by_version(data, 12, 20)[1], 4)


def with_track_number(data: Column, number: Column) -> Column:
    return patched(data, _by_version(data, 12, 20)[1], number, 4)


def next_track_number(data: Column) -> Column:
    """The next_track_ID of mvhd, its last four bytes."""
    return unsigned(data, _by_version(data, 96, 108)[1], 4)


def with_next_track_number(data: Column, number: Column) -> Column:
    return patched(data, _by_version(data, 96, 108)[1], number, 4)


def unescaped(name: Column) -> Column:
    """The four bytes of a box type that is shown with \\xNN for bytes that are not printable; null if they are not four."""
    parts = F.regexp_extract_all(name, F.lit(r"(?s)\\x[0-9a-f]{2}|."), F.lit(0))
    codes = F.transform(parts, lambda x: F.when(F.length(x) == 4, F.upper(F.substring(x, 3, 2))).otherwise(F.hex(F.encode(x, "ISO-8859-1"))))
    return F.when(F.size(parts) == 4, F.unhex(F.array_join(codes, "")))


def number(value: Column | int, width: int = 4) -> Column:
    """A column or a fixed number in `width` bytes."""
    return encoded((value if isinstance(value, Column) else F.lit(value)).cast("long"), width)


def zeros(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def boxed(kind: str | Column, *payload: Column) -> Column:
    """A box of a type with a payload in parts."""
    name = F.lit(kind).cast("binary") if isinstance(kind, str) else kind.cast("binary")
    body = F.concat(*payload) if payload else zeros(0)
    whole = F.transform(F.array(body), lambda b: F.concat(encoded(F.octet_length(b).cast("long") + 8, 4), name, b))
    return F.element_at(whole, 1)
