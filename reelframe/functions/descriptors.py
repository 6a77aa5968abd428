"""Descriptors of esds: nested tags whose lengths take one to four bytes, as column expressions.

Defined results: a payload that ends early, has another tag, or a length of more than four bytes, has no such field:
its place is null, and a patch leaves it as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.binary import patched, unsigned
from reelframe.functions.decoders import let

#: Tags of the two outer descriptors, and what lies before the largest bitrate in the inner one.
STREAM_TAG, DECODER_TAG, BEFORE_MAXIMUM = 3, 4, 5


def behind_length(data: Column, at: Column | int) -> Column:
    """The offset behind a length that begins at `at`: each of up to four bytes says in its top bit whether another follows."""
    start = at if isinstance(at, Column) else F.lit(at)
    found = F.lit(None).cast("int")
    for n in (4, 3, 2, 1):
        byte = unsigned(data, start + n - 1, 1)
        found = F.when(byte < 128, start + n).when(byte.isNotNull(), found)
    return found.cast("int")


def maximum_bitrate_at(data: Column) -> Column:
    """Where an esds payload has its largest bitrate, four bytes; null if it has none."""

    def inner(at: Column) -> Column:
        config = let(behind_length(data, at + 1), lambda n: F.when(n + BEFORE_MAXIMUM + 4 <= F.octet_length(data), n + BEFORE_MAXIMUM))
        return F.when(unsigned(data, at, 1) == DECODER_TAG, config)

    def stream(at: Column) -> Column:
        flags, first = unsigned(data, at + 2, 1), at + 3
        depends = F.when(flags.bitwiseAND(128) != 0, first + 2).otherwise(first)
        url = let(depends, lambda d: F.when(flags.bitwiseAND(64) != 0, d + 1 + unsigned(data, d, 1)).otherwise(d))
        return let(F.when(flags.bitwiseAND(32) != 0, url + 2).otherwise(url).cast("int"), inner)

    return F.when(unsigned(data, 4, 1) == STREAM_TAG, let(behind_length(data, 5), stream)).cast("int")


def maximum_bitrate(data: Column) -> Column:
    """The largest bitrate of an esds payload."""
    return unsigned(data, maximum_bitrate_at(data), 4)


def with_maximum_bitrate(data: Column, value: Column) -> Column:
    """An esds payload with another largest bitrate; no other byte moves."""
    return let(maximum_bitrate_at(data), lambda at: F.when(at.isNull(), data).otherwise(patched(data, F.coalesce(at, F.lit(0)), F.when(at.isNotNull(), value).otherwise(0), 4)))


def with_box_bitrate(data: Column, value: Column) -> Column:
    """A btrt payload with another largest bitrate; one that is too short stays as it is."""
    fits = F.octet_length(data) >= 12
    return F.when(fits, patched(data, 4, F.when(fits, value).otherwise(0), 4)).otherwise(data)
