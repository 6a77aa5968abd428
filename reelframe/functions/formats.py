"""Display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.operators.lookup import js_round


def duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss; a dash for nothing."""
    total = js_round(seconds).cast("long")
    h, m, s = F.floor(total / 3600).cast("string"), F.floor(total % 3600 / 60).cast("string"), (total % 60).cast("string")
    short = F.concat(m, F.lit(":"), F.lpad(s, 2, "0"))
    long = F.concat(h, F.lit(":"), F.lpad(m, 2, "0"), F.lit(":"), F.lpad(s, 2, "0"))
    return F.when(seconds.isNull() | (seconds <= 0), "—").when(total >= 3600, long).otherwise(short)


def estimate(seconds: Column) -> Column:
    """A rough phrase in six bands."""
    minutes = seconds / 60
    near = js_round(minutes).cast("string")
    return (
        F.when(seconds < 0.5, "instant").when(seconds < 2, "under a second").when(seconds < 10, "a few seconds")
        .when(seconds < 60, F.concat(F.lit("around "), (js_round(seconds / 5) * 5).cast("string"), F.lit(" seconds")))
        .when(minutes < 10, F.concat(F.lit("around "), near, F.when(near == "1", " minute").otherwise(" minutes")))
        .otherwise(F.concat((js_round(minutes / 5) * 5).cast("string"), F.lit("+ minutes")))
    )


def output_name(original: Column, suffix: str) -> Column:
    """The stem, with what a file system may not like flattened, at most 80 characters, and the suffix."""
    stem = F.regexp_replace(original, r"\.[^./\\]+$", "")
    safe = F.regexp_replace(F.when(stem == "", "video").otherwise(stem), r'[\\/:*?"<>|]+', "_")
    return F.concat(F.substring(safe, 1, 80), F.lit(f"_{suffix}.mp4"))


def size_band(value: Column) -> Column:
    """struct(unit, scaled): the size as a number in its unit, without text so that it can be compared exactly."""
    k = F.lit(1024.0)
    return F.struct(
        F.when(value < 1024, "B").when(value < 1024**2, "KB").when(value < 1024**3, "MB").otherwise("GB").alias("unit"),
        F.when(value < 1024, value.cast("double")).when(value < 1024**2, value / k).when(value < 1024**3, value / k / k).otherwise(value / k / k / k).alias("scaled"),
    )


def avc_level(level: Column) -> Column:
    return F.concat(F.floor(level / 10).cast("string"), F.lit("."), (level % 10).cast("string"))


def hevc_level(level: Column) -> Column:
    return F.concat(F.floor(level / 30).cast("string"), F.lit("."), js_round(level % 30 / 3).cast("string"))


def to_fixed(value: Column, digits: int) -> Column:
    """`digits` decimals of the exact binary value, halves away from zero upwards, without separators; value is not negative.

    format_number rounds the exact value but sends ties to the even digit; only an odd multiple of 2^-(digits + 1) is
    a tie, and those are nudged up.
    """
    x = value.cast("double")
    halves = x * 2.0 ** (digits + 1)
    tie = (halves == F.floor(halves)) & (F.floor(halves) % 2 == 1)
    return F.regexp_replace(F.format_number(F.when(tie, x + 2.0 ** -(digits + 9)).otherwise(x), digits), ",", "")


def size(value: Column) -> Column:
    """A size in B, KB, MB or GB, with a decimal under ten of the larger units."""
    b = size_band(value)
    scaled = F.when(b["scaled"] < 10, to_fixed(b["scaled"], 1)).otherwise(to_fixed(b["scaled"], 0))
    return F.concat_ws(" ", F.when(b["unit"] == "B", value.cast("string")).otherwise(scaled), b["unit"])


def bitrate(bps: Column) -> Column:
    """kbps, or Mbps with two decimals under ten and one from there; a dash for nothing."""
    million = bps.cast("double") / 1e6
    large = F.concat(F.when(bps < 10_000_000, to_fixed(million, 2)).otherwise(to_fixed(million, 1)), F.lit(" Mbps"))
    return F.when(bps.isNull(), "—").when(bps < 1_000_000, F.concat(js_round(bps.cast("double") / 1000).cast("string"), F.lit(" kbps"))).otherwise(large)


def megabits(bps: Column) -> Column:
    """Mbps with one decimal; 'unknown' for nothing."""
    return F.when(bps.isNull(), "unknown").otherwise(F.concat(to_fixed(bps.cast("double") / 1e6, 1), F.lit(" Mbps")))


def fps(value: Column, missing: str = "—", rounded: bool = True) -> Column:
    """A frame rate, without decimals if it is whole (after rounding to hundredths, if rounded), else with two."""
    x = js_round(value * 100).cast("double") / 100 if rounded else value
    text = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(to_fixed(x, 2))
    return F.when(value.isNull(), missing).otherwise(F.concat(text, F.lit(" fps")))


def dimensions(width: Column, height: Column) -> Column:
    return F.coalesce(F.concat(width.cast("string"), F.lit(" x "), height.cast("string")), F.lit("—"))


def percent(ratio: Column) -> Column:
    return F.concat(js_round(ratio * 100).cast("string"), F.lit("%"))


def size_delta(before: Column, after: Column) -> Column:
    """struct(text, tone): the signed difference and its share of `before`, null if that is zero."""
    delta = after - before
    sign = F.when(delta > 0, "+").otherwise("-")
    share = to_fixed(F.abs(F.try_divide(delta.cast("double"), before.cast("double"))) * 100, 1)
    text = F.concat(sign, size(F.abs(delta)), F.lit(" ("), sign, share, F.lit("%)"))
    return F.struct(F.when(delta == 0, "unchanged").otherwise(text).alias("text"), F.when(delta > 0, "warn").otherwise("good").alias("tone"))


def severity_text(blockers: Column, warnings: Column, notes: Column) -> Column:
    """The counts that are not zero in words."""
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"))) for n, word in ((blockers, "blocker(s)"), (warnings, "worth fixing"), (notes, "note(s)"))]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("nothing to fix"))


def timing_label(mode: Column) -> Column:
    return F.when(mode == "cfr", "constant").when(mode == "near-cfr", "near constant").when(mode == "vfr", "variable").otherwise("unknown")


def color_label(color: Column) -> Column:
    """A colour struct of the decoders in words."""
    three = F.concat_ws(" / ", color["primaries_label"], color["transfer_label"], color["matrix_label"])
    return F.when(color["hdr"], F.concat(F.lit("HDR · "), color["transfer_label"])).when(~color["present"], "not tagged").when(color["rec709"], "Rec.709").otherwise(three)
