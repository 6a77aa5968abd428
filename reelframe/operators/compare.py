"""Before and after: positional and field-wise differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import formats


def positional_diff(before: DataFrame, after: DataFrame, on: str | list[str], fields: list[str]) -> DataFrame:
    """Full outer join on a position, one column or several: (on, before_x, after_x for each field, differs)."""
    on = [on] if isinstance(on, str) else on
    a = before.select(*on, *[F.col(f).alias(f"before_{f}") for f in fields])
    b = after.select(*on, *[F.col(f).alias(f"after_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}"))
    return a.join(b, on, "full").withColumn("differs", ~same)


def field_diff(pairs: DataFrame, key: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, field, before, after, same): one row for each pair and field, compared as text."""
    parts = ", ".join(f"'{name}', CAST({a} AS string), CAST({b} AS string)" for name, (a, b) in fields.items())
    rows = pairs.select(key, F.expr(f"stack({len(fields)}, {parts}) AS (field, before, after)"))
    return rows.withColumn("same", F.col("before").eqNullSafe(F.col("after")))


def report_comparison(pairs: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """(key, row, label, before, after, improved): two reports of each pair as at most nine rows of text.

    pairs: the key and two structs with the columns of analysis.reports.  improved is null where a row makes no claim;
    the rows on videos are left out unless both have one.
    """
    a, b = F.col(before), F.col(after)

    def row(label: str, show: Callable[[Column], Column], improved: Column | None = None) -> Column:
        claim = F.lit(None).cast("boolean") if improved is None else improved
        return F.struct(F.lit(label).alias("label"), show(a).alias("before"), show(b).alias("after"), claim.alias("improved"))

    delta = formats.size_delta(a["file_size"], b["file_size"])["text"]
    size = F.struct(F.lit("Size").alias("label"), formats.size(a["file_size"]).alias("before"), F.concat(formats.size(b["file_size"]), F.lit(" ("), delta, F.lit(")")).alias("after"), F.lit(None).cast("boolean").alias("improved"))
    same = a["video_bytes"] == b["video_bytes"]
    payload = F.struct(F.lit("Video payload").alias("label"), formats.size(a["video_bytes"]).alias("before"), F.when(same, "identical, byte for byte").otherwise(formats.size(b["video_bytes"])).alias("after"), same.alias("improved"))
    both = a["has_video"] & b["has_video"]
    videos = [
        row("Frame timing", lambda r: formats.timing_label(r["timing_mode"]), b["timing_mode"] == "cfr"),
        row("Frame size", lambda r: formats.dimensions(r["width"], r["height"])),
        row("Frame rate", lambda r: formats.fps(r["fps"])),
        row("Codec", lambda r: r["video_codec"]),
        row("Colour", lambda r: formats.color_label(r["color"]), ~b["color"]["unspecified"] & ~b["color"]["hdr"]),
        row("Video bitrate", lambda r: formats.bitrate(r["bitrate"])),
        payload,
    ]
    rows = [size, row("Index", lambda r: F.when(r["faststart"], "front").otherwise("end of file"), b["faststart"]), *[F.when(both, v) for v in videos]]
    return pairs.select(key, F.posexplode(F.array_compact(F.array(*rows))).alias("row", "r")).select(key, "row", "r.*")


def cloned_sound(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, ratio) of the files of which `after` has more audio tracks than `before`, both as analysis.tracks.

    ratio: samples of the last audio track of `after` over those of the first of `before` (one if it has none).
    """
    a, b = (t.where("kind = 'audio'").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), pick("samples", "ord").alias("samples")) for t, pick in ((before, F.min_by), (after, F.max_by)))
    pair = b.alias("b").join(a.alias("a"), "file_id", "left").where("b.n > coalesce(a.n, 0)")
    first = F.coalesce(F.nullif("a.samples", F.lit(0)), F.lit(1))
    return pair.select("file_id", (F.col("b.samples") / first).alias("ratio"))


def byte_comparison(pairs: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """(key, same_length, identical, first_difference): two binary columns; the first differing place within the shared length, from 0, or null.

    The place is found by halving the range whose digests differ, so no byte becomes a row.
    """
    a, b = F.col(before), F.col(after)
    shared = F.least(F.octet_length(a), F.octet_length(b))

    def halved(state: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        differs = F.substring(a, state["low"] + 1, middle - state["low"]) != F.substring(b, state["low"] + 1, middle - state["low"])
        return F.struct(F.when(differs, state["low"]).otherwise(middle).alias("low"), F.when(differs, middle).otherwise(state["high"]).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), shared.cast("int").alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(shared, F.lit(2)))).cast("int") + 1)
    found = F.aggregate(steps, whole, lambda s, _: F.when(s["high"] - s["low"] <= 1, s).otherwise(halved(s)))["low"]
    first = F.when(F.substring(a, F.lit(1), shared) != F.substring(b, F.lit(1), shared), found.cast("long"))
    return pairs.select(key, (F.octet_length(a) == F.octet_length(b)).alias("same_length"), (a == b).alias("identical"), first.alias("first_difference"))


def repeated_pattern(tail: Column, unit: int = 8) -> Column:
    """How often a binary value repeats its first `unit` bytes; null if it is empty or anything else."""
    n = F.octet_length(tail)
    times = F.floor(n / unit).cast("int")
    whole = F.unhex(F.repeat(F.hex(F.substring(tail, 1, unit)), times))
    return F.when((n > 0) & (n % unit == 0) & (whole == tail), times.cast("long"))
