"""From a report to what would be done: support, targets, cost of each mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators import lookup

#: Top-level boxes that a lossless rewrite knows, and the modes.
KNOWN_BOXES = ("ftyp", "moov", "mdat", "free", "skip", "wide")
MODES = ("remux", "retag", "master", "observed")


def rewrite_reason(types: Column, fragmented: Column) -> Column:
    """Why a lossless rewrite is declined, the first reason of several; empty if it is not."""

    def n(kind: str) -> Column:
        return F.size(F.filter(types, lambda t: t == kind))

    unknown = F.array_except(types, F.array(*[F.lit(k) for k in KNOWN_BOXES]))
    # The wording of the reasons.
    return (
        F.when(fragmented, "the file is fragmented, which needs a real remuxer")
        .when(F.size(unknown) > 0, F.concat(F.lit("unexpected top-level box(es): "), F.array_join(unknown, ", ")))
        .when(n("mdat") == 0, "no mdat box")
        .when(n("mdat") != 1, F.concat(F.lit("media is split across "), n("mdat").cast("string"), F.lit(" mdat boxes")))
        .when(n("moov") != 1, "expected exactly one moov box")
        .when(n("ftyp") == 0, "no ftyp box to identify the container")
        .otherwise("")
    )


def master_plan(width: Column, height: Column, rate: Column) -> Column:
    """struct(width, height, fps, bitrate, scaled, rate_changed): never upscaled, with defaults for what is unknown."""
    w, h, r = F.coalesce(width, F.lit(1080)), F.coalesce(height, F.lit(1920)), F.coalesce(rate, F.lit(30.0))
    rung = lookup.nearest_rung(w, h)
    down = F.coalesce(rung["width"] * rung["height"] < w * h, F.lit(False))
    tw, th, tr = F.when(down, rung["width"]).otherwise(w), F.when(down, rung["height"]).otherwise(h), lookup.nearest_rate(r)
    return F.struct(
        tw.alias("width"), th.alias("height"), tr.alias("fps"), lookup.target_bitrate(tw.cast("double"), th, tr).alias("bitrate"),
        ((tw != w) | (th != h)).alias("scaled"), (F.abs(tr - r) > 0.01).alias("rate_changed"),
    )


def estimates(reports: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, mode, engine, seconds) of each mode.  reports: file_size, duration, width, height, fps, native."""
    mb, frames = F.col("file_size") / 1e6, F.when(F.coalesce("duration", F.lit(0.0)) == 0, 1.0).otherwise(F.col("duration")) * F.least(F.coalesce("fps", F.lit(30.0)), F.lit(60.0))
    pixels = F.coalesce("width", F.lit(1080)).cast("double") * F.coalesce("height", F.lit(1920))
    rows = reports.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    engine = F.when(F.col("mode") == "observed", "observed").when((F.col("mode") != "master") & F.col("native"), "native").otherwise("ffmpeg")
    seconds = (
        F.when(F.col("mode") == "observed", F.greatest(F.lit(0.3), mb * 0.008))
        .when(F.col("mode") == "master", F.greatest(F.lit(5.0), lookup.js_round(pixels * frames / 2e6).cast("double")))
        .when(F.col("native"), F.greatest(F.lit(0.2), mb * 0.002))
        .otherwise(F.greatest(F.lit(2.0), lookup.js_round(mb * 0.08).cast("double")))
    )
    return rows.select(key, "mode", engine.alias("engine"), seconds.alias("seconds"))


#: Flags of an encoder's command line, and the audio that a re-encode aims at.
BT709_COPY = ("-color_primaries", "bt709", "-color_trc", "bt709", "-colorspace", "bt709")
BT709_FILTER, EVEN_FILTER, FAST_START = "setparams=color_primaries=bt709:color_trc=bt709:colorspace=bt709", "scale=trunc(iw/2)*2:trunc(ih/2)*2", ("-movflags", "+faststart")
PRESET, CRF, AUDIO_BITRATE, AUDIO_RATE, AUDIO_CHANNELS = "veryfast", 18, 256_000, 48_000, 2


def _words(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _streams(has_audio: Column) -> Column:
    return F.concat(_words("-i", "{input}", "-map", "0:v:0"), F.when(has_audio, _words("-map", "0:a:0")).otherwise(_words()))


def copy_arguments(has_audio: Column, retag: bool) -> Column:
    """The command line that copies the streams, with colour flags if retag."""
    return F.concat(_streams(has_audio), _words("-c", "copy", *(BT709_COPY if retag else ()), *FAST_START))


def master_arguments(plan: Column, hdr: Column, has_audio: Column) -> Column:
    """The command line of a re-encode after a struct of master_plan; null without a plan."""

    def text(name: str, times: int = 1) -> Column:
        return (plan[name].cast("long") * times).cast("string")

    scale = F.when(plan["scaled"], F.concat(F.lit("scale="), text("width"), F.lit(":"), text("height"), F.lit(":flags=lanczos"))).otherwise(EVEN_FILTER)
    filters = F.concat_ws(",", scale, F.when(~hdr, BT709_FILTER), F.lit("format=yuv420p"))
    grid = F.concat(F.lit("keyint="), text("fps", 2), F.lit(":min-keyint="), text("fps"), F.lit(":scenecut=40"))
    video = F.array(
        F.lit("-vf"), filters, F.lit("-fps_mode"), F.lit("cfr"), F.lit("-r"), text("fps"), *[F.lit(w) for w in ("-c:v", "libx264", "-profile:v", "high", "-preset", PRESET, "-crf", str(CRF))],
        F.lit("-maxrate"), text("bitrate"), F.lit("-bufsize"), text("bitrate", 2), F.lit("-pix_fmt"), F.lit("yuv420p"), F.lit("-x264-params"), grid,
    )
    sound = F.when(has_audio, _words("-c:a", "aac", "-b:a", str(AUDIO_BITRATE), "-ar", str(AUDIO_RATE), "-ac", str(AUDIO_CHANNELS))).otherwise(_words())
    return F.when(plan.isNotNull(), F.concat(_streams(has_audio), video, sound, _words(*FAST_START)))
