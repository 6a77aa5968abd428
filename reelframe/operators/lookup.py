"""Lookups in small fixed tables, and the nearest entry of one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour primaries by number.
PRIMARIES = {
    1: "BT.709", 2: "unspecified", 4: "BT.470M", 5: "BT.601 625", 6: "BT.601 525", 7: "SMPTE 240M", 8: "Film", 9: "BT.2020", 10: "SMPTE 428", 11: "SMPTE 431", 12: "SMPTE 432", 22: "EBU 3213",
}
#: Delivery sizes in order of preference, frame rates, bits a pixel, bounds of a bitrate.
RUNGS = [("portrait-1080", 1080, 1920), ("portrait-720", 720, 1280), ("landscape-1080", 1920, 1080), ("landscape-720", 1280, 720), ("square-1080", 1080, 1080)]
RATES, TOP_RATE = (24, 25, 30, 50, 60), 60
SOFT_BITS, TARGET_BITS, LEAST_BITRATE, MOST_BITRATE = 0.06, 0.2, 2_000_000, 40_000_000


def js_round(x: Column) -> Column:
    """Rounds halves up, towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def label(value: Column, names: dict[int, str] = PRIMARIES) -> Column:
    """The name of a number: 'not tagged' for null, 'unknown (v)' for one without a name."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(value.isNull(), "not tagged").otherwise(F.coalesce(F.try_element_at(table, value), F.concat(F.lit("unknown ("), value.cast("string"), F.lit(")"))))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width == height, "square").when(height > width, "portrait").otherwise("landscape")


def on_target(width: Column, height: Column) -> Column:
    """Whether the size is a delivery size."""
    return F.struct(width.cast("int").alias("w"), height.cast("int").alias("h")).isin(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for _, w, h in RUNGS])


def nearest_rung(width: Column, height: Column) -> Column:
    """struct(name, width, height) of the same orientation with the nearest number of pixels, the first of equals; null on a delivery size."""

    def shape(w: int, h: int) -> str:
        return "square" if w == h else "portrait" if h > w else "landscape"

    rows = F.array(*[
        F.struct(F.abs(F.lit(w * h) - width * height).alias("far"), F.lit(k).alias("ord"), F.lit(name).alias("name"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(shape(w, h)).alias("shape"))
        for k, (name, w, h) in enumerate(RUNGS)
    ])
    best = F.array_min(F.filter(rows, lambda r: r["shape"] == orientation(width, height)))
    return F.when(~on_target(width, height), F.struct(best["name"].alias("name"), best["width"].alias("width"), best["height"].alias("height")))


def nearest_rate(rate: Column) -> Column:
    """The nearest supported frame rate, the lower of equals."""
    rows = F.array(*[F.struct(F.abs(F.lit(float(r)) - F.least(rate, F.lit(float(TOP_RATE)))).alias("far"), F.lit(r).alias("rate")) for r in RATES])
    return F.array_min(rows)["rate"]


def soft_bitrate(width: Column, height: Column, rate: Column) -> Column:
    return js_round(width * height * rate * F.lit(SOFT_BITS))


def target_bitrate(width: Column, height: Column, rate: Column) -> Column:
    return js_round(F.least(F.lit(float(MOST_BITRATE)), F.greatest(F.lit(float(LEAST_BITRATE)), width * height * rate * F.lit(TARGET_BITS))))
