"""From boxes to tracks, from tracks to one report a file.

Defined results: a track without mdhd or hdlr is counted as skipped and has no row; a file without moov, mvhd or
tracks, or with a malformed box in its moov, has a report with the reason in `error`.  Where a path occurs more than once in a track, the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import binary, decoders
from reelframe.operators import lookup, timing
from reelframe.sources.containers import plain_path

#: Brands of files for streaming, and names of sample entries.
FRAGMENT_BRANDS = ("dash", "msdh", "msix", "iso5", "cmfc")
CODECS = {
    "avc1": "H.264 / AVC", "avc3": "H.264 / AVC (in-band params)", "hvc1": "HEVC / H.265", "hev1": "HEVC / H.265 (in-band params)", "hvc2": "HEVC / H.265", "hev2": "HEVC / H.265 (in-band params)", "av01": "AV1", "vp09": "VP9", "mp4v": "MPEG-4 Visual", "jpeg": "Motion JPEG",
    "ap4h": "Apple ProRes 4444", "apch": "Apple ProRes 422 HQ", "apcn": "Apple ProRes 422", "mp4a": "AAC", "ac-3": "Dolby Digital", "ec-3": "Dolby Digital Plus", "alac": "Apple Lossless", "opus": "Opus", "twos": "PCM (big-endian)", "sowt": "PCM (little-endian)", "lpcm": "PCM", "tx3g": "Timed text", "c608": "CEA-608 captions",
}
_TRACK_BOXES = {"tkhd": "tkhd", "mdhd": "mdia/mdhd", "hdlr": "mdia/hdlr", "elst": "edts/elst"} | {k: f"mdia/minf/stbl/{k}" for k in ("stsd", "stts", "stsz", "stz2", "stco", "co64")}

#: All that track_boxes() and tracks() read, as containers.boxes takes it.
TRACK_TYPES, TRACK_COLUMNS = ("trak", *_TRACK_BOXES), ("file_id", "node_id", "path", "payload")


def codec_label(form: Column) -> Column:
    """The name of a sample entry's format, or the format itself."""
    return decoders.named(form, CODECS, form)


def _packed_sizes(data: Column) -> Column:
    """struct(count, total) of stz2: sizes in 4, 8 or 16 bits."""
    bits, n = binary.unsigned(data, 7, 1), binary.unsigned(data, 8, 4)
    body = decoders.rest(data, 12)
    four = F.aggregate(F.slice(F.when(F.octet_length(body) > 0, binary.nibbles(body)), 1, n.cast("int")), F.lit(0).cast("long"), lambda a, v: a + v)

    def summed(width: int) -> Column:
        there = F.least(n, F.floor((F.octet_length(data) - 12) / width))
        places = F.when(there > 0, F.sequence(F.lit(0).cast("long"), there - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, k: a + binary.unsigned(data, 12 + k * width, width))

    return F.struct(n.alias("count"), F.coalesce(F.when(bits == 4, four).when(bits == 8, summed(1)).when(bits == 16, summed(2)), F.lit(0)).alias("total"))


def track_boxes(boxes: DataFrame) -> DataFrame:
    """(file_id, moov, trak, ord and a payload for each kind of box): one row for each trak of moov."""
    inside = boxes.where("path LIKE 'moov[%'").withColumn("trak", F.regexp_extract("path", r"^moov\[\d+\]/trak\[\d+\]", 0)).where("trak <> ''")
    inner = inside.withColumn("rel", F.regexp_replace(plain_path(F.col("path")), "^moov/trak/?", ""))
    wanted = inner.where(F.col("rel").isin("", *_TRACK_BOXES.values()))
    firsts = [F.min_by("payload", F.when(F.col("rel") == rel, F.col("node_id"))).alias(name) for name, rel in _TRACK_BOXES.items()]
    # min_by over all-null orders is null, so a missing box is a null payload
    return wanted.groupBy("file_id", "trak").agg(F.min("node_id").alias("ord"), *firsts).withColumn("moov", F.regexp_extract("trak", r"^moov\[(\d+)\]", 1).cast("int"))


def tracks(boxes: DataFrame, timed: bool = True) -> DataFrame:
    """One row a track: header, sample entry, sizes, colour, edit list, and timing of videos, which is left out unless timed."""
    rows = track_boxes(boxes)
    name = decoders.handler(F.col("hdlr"))
    rows = rows.where("mdhd IS NOT NULL AND hdlr IS NOT NULL").withColumn("kind", decoders.kind(name)).withColumn("handler", name)
    rows = rows.withColumn("m", decoders.clock(F.col("mdhd"))).withColumn("t", decoders.track_header(F.col("tkhd"))).withColumn("e", decoders.sample_entry(F.col("stsd"), F.col("kind")))
    inner = F.col("e.boxes")
    rows = rows.withColumn("v", F.coalesce(decoders.avc_config(decoders.body_of(inner, "avcC")), decoders.hevc_config(decoders.body_of(inner, "hvcC"))))
    rows = rows.withColumn("a", decoders.audio_config(decoders.body_of(inner, "esds"))).withColumn("color", decoders.color(decoders.body_of(inner, "colr")))
    nothing = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("total"))
    sizes = F.when(F.col("stsz").isNotNull(), binary.read_stsz(F.col("stsz"))).when(F.col("stz2").isNotNull(), _packed_sizes(F.col("stz2"))).otherwise(nothing)
    rows = rows.withColumn("s", sizes).withColumn("edit", decoders.edit_list(F.col("elst")))
    turned, sound = F.coalesce(F.col("t.rotation").isin(90, 270), F.lit(False)), F.col("kind") == "audio"
    out = rows.select(
        "file_id", "moov", "ord", "trak", F.coalesce("t.track_id", F.lit(0)).alias("track_id"), "kind", "handler", F.col("e.format").alias("format"), codec_label(F.col("e.format")).alias("codec"),
        F.col("m.language").alias("language"), F.col("m.timescale").alias("timescale"), F.col("m.seconds").alias("seconds"), F.col("s.count").alias("samples"), F.col("s.total").alias("bytes"),
        F.when((F.col("m.seconds") > 0) & (F.col("s.total") > 0), F.col("s.total") * 8 / F.col("m.seconds")).alias("bitrate"),
        *[F.when(F.col(f"t.{side}") > 0, lookup.js_round(F.col(f"t.{side}"))).alias(f"display_{side}") for side in ("width", "height")],
        F.col("e.width").alias("coded_width"), F.col("e.height").alias("coded_height"), F.coalesce("t.rotation", F.lit(0)).alias("rotation"),
        F.when(turned, F.col("e.height")).otherwise(F.col("e.width")).alias("width"), F.when(turned, F.col("e.width")).otherwise(F.col("e.height")).alias("height"),
        F.col("v.profile").alias("profile"), F.col("v.level").alias("level"), F.col("v.chroma").alias("chroma"), F.col("v.bit_depth").alias("bit_depth"), "color",
        F.when(sound, F.coalesce("a.channels", "e.channels")).alias("channels"), F.when(sound, F.coalesce("a.rate", "e.rate")).alias("rate"), F.col("a.profile").alias("audio_profile"),
        F.when(sound, F.coalesce(F.col("a.bitrate"), decoders.declared_bitrate(decoders.body_of(inner, "btrt")))).alias("declared_bitrate"),
        "edit", F.col("e.entries").alias("sample_entries"), F.when(F.col("stco").isNotNull(), "stco").when(F.col("co64").isNotNull(), "co64").otherwise("none").alias("offsets_kind"),
        F.coalesce(binary.unsigned(F.coalesce("stco", "co64"), 4, 4), F.lit(0)).alias("chunks"), F.when((F.col("kind") == "video") & (F.col("m.timescale") > 0), binary.read_stts(F.col("stts"))).alias("_runs"),
    )
    if not timed:
        return out.drop("_runs")
    runs = out.select(F.struct("file_id", "ord").alias("key"), F.posexplode("_runs").alias("nth", "run")).select("key", F.col("nth").alias("ord"), F.col("run.delta").alias("delta"), F.col("run.count").alias("n"))
    timed = timing.summarize(timing.histogram(runs)).select(F.col("key.file_id").alias("file_id"), F.col("key.ord").alias("ord"), "mode", "reference", F.col("n").alias("_n"), "low", "high", "steady")
    regular = [(F.col("steady") / F.col("_n")).alias("steady_share"), F.when(F.col("reference") > 0, (F.col("high") - F.col("low")) / F.col("reference") * 100).alias("jitter")]
    joined = out.drop("_runs").join(timed, ["file_id", "ord"], "left")
    fps = [F.when(F.col(c) > 0, F.col("timescale").cast("double") / F.col(c)).alias(a) for c, a in (("reference", "fps"), ("high", "min_fps"), ("low", "max_fps"))]
    return joined.select(*out.drop("_runs").columns, F.coalesce("mode", F.lit("unknown")).alias("timing_mode"), *fps, F.when(F.col("seconds") > 0, F.col("_n") / F.col("seconds")).alias("average_fps"), *regular)


def encoder_tags(boxes: DataFrame) -> DataFrame:
    """(file_id, encoder): the first tag of the list of items, else of the older form; empty ones count as none."""

    def clean(data: Column) -> Column:
        text = F.make_valid_utf8(data.cast("string"))
        return F.nullif(F.trim(F.regexp_replace(text, "\\x00+$", "")), F.lit(""))

    plain = plain_path(F.col("path"))
    listed = plain.rlike(r"^moov/udta/meta/ilst/[^/]*too/data$") & (F.octet_length("payload") > 8)
    older = (plain == r"moov/udta/\xa9too") & (F.octet_length("payload") > 4)
    first = [F.min_by("payload", F.when(form, F.col("node_id"))) for form in (listed, older)]
    rows = boxes.where(listed | older).groupBy("file_id").agg(first[0].alias("a"), first[1].alias("b"))
    return rows.select("file_id", F.when(F.col("a").isNotNull(), clean(decoders.rest(F.col("a"), 8))).otherwise(clean(decoders.rest(F.col("b"), 4))).alias("encoder"))


def reports(files: DataFrame, boxes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row a file of `files` (file_id, file_size): what the rules and plans read, notes, and the error of an unreadable one."""
    found = tracks(boxes) if found is None else found
    kind, top = F.col("type"), F.col("depth") == 0
    layout = boxes.groupBy("file_id").agg(
        F.min(F.when(top & (kind == "moov"), F.col("child_ordinal"))).alias("moov"), F.min(F.when(top & kind.isin("mdat", "moof"), F.col("child_ordinal"))).alias("media"),
        F.max(F.coalesce((top & (kind == "moof")) | (plain_path(F.col("path")) == "moov/mvex"), F.lit(False))).alias("fragmented"), F.max(top & F.col("large")).alias("large"), F.max(F.when(top, F.col("end"))).alias("last"),
        F.min("error").alias("damage"), F.count_if(top & (kind == "mdat")).alias("mdats"), F.count_if(plain_path(F.col("path")) == "moov/trak").alias("traks"),
        F.min_by("payload", F.when(top & (kind == "ftyp"), F.col("node_id"))).alias("ftyp"), F.min_by("payload", F.when(plain_path(F.col("path")) == "moov/mvhd", F.col("node_id"))).alias("mvhd"),
        F.transform(F.array_sort(F.collect_list(F.when(top, F.struct("child_ordinal", "type")))), lambda x: x["type"]).alias("types"),
    )
    whole = F.struct(*[c for c in found.columns if c != "file_id"])
    picks = [F.max_by(whole, F.when(F.col("kind") == k, F.struct("seconds", (-F.col("ord")).alias("o")))).alias(k) for k in ("video", "audio")]
    main = found.groupBy("file_id").agg(*picks, F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("kind") == "audio").alias("sounds"), F.max("track_id").alias("top_id"), F.max(F.col("offsets_kind") == "co64").alias("wide_offsets"))
    rows = files.select("file_id", "file_size").join(layout, "file_id", "left").join(main, "file_id", "left").join(encoder_tags(boxes), "file_id", "left")
    rows = rows.withColumn("brand", decoders.brand(F.col("ftyp"))).withColumn("movie_seconds", decoders.clock(F.col("mvhd"))["seconds"])
    v, a, none = F.col("video"), F.col("audio"), F.coalesce("tracks", F.lit(0))
    error = F.when(F.col("types").isNull(), "no boxes").when(F.col("moov").isNull(), "no moov box").when(F.col("damage").isNotNull(), F.col("damage")).when(F.col("mvhd").isNull(), "no mvhd box").when(none == 0, "no readable tracks")
    hint = ~F.col("fragmented") & F.arrays_overlap(F.concat(F.array(F.col("brand.major")), F.col("brand.compatible")), F.array(*[F.lit(b) for b in FRAGMENT_BRANDS]))
    notes = F.array_compact(F.array(F.when(F.col("ftyp").isNull(), "no brand"), F.when(F.col("traks") > none, "skipped a track"), F.when(hint, "brand of a streaming layout"), F.when(F.col("mdats") > 1, F.concat(F.lit("media in parts: "), F.col("mdats").cast("string")))))
    return rows.select(
        "file_id", "file_size", error.alias("error"), notes.alias("notes"), "brand", "types", F.coalesce("fragmented", F.lit(False)).alias("fragmented"), (F.col("media").isNull() | F.coalesce(F.col("moov") < F.col("media"), F.lit(False))).alias("faststart"),
        F.coalesce("large", F.lit(False)).alias("large"), F.when(F.col("movie_seconds") > 0, F.col("movie_seconds")).otherwise(F.coalesce(v["seconds"], F.lit(0.0))).alias("duration"),
        F.when(F.col("movie_seconds") > 0, F.col("file_size") * 8 / F.col("movie_seconds")).alias("overall_bitrate"), "encoder", none.alias("tracks"), v.isNotNull().alias("has_video"), a.isNotNull().alias("has_audio"),
        v["sample_entries"].alias("sample_entries"), v["timing_mode"].alias("timing_mode"), F.coalesce(v["fps"], v["average_fps"]).alias("fps"), v["edit"]["non_trivial"].alias("edit_list"), v["color"]["hdr"].alias("hdr"), v["color"]["unspecified"].alias("color_unspecified"),
        v["format"].alias("video_format"), v["chroma"].alias("chroma"), v["bit_depth"].alias("bit_depth"), v["width"].alias("width"), v["height"].alias("height"), v["bitrate"].alias("bitrate"),
        a["format"].alias("audio_format"), a["audio_profile"].alias("audio_profile"), a["rate"].alias("audio_rate"), a["channels"].alias("audio_channels"),
        v["codec"].alias("video_codec"), v["profile"].alias("video_profile"), v["bytes"].alias("video_bytes"), v["min_fps"].alias("min_fps"), v["max_fps"].alias("max_fps"), v["steady_share"].alias("steady_share"), v["jitter"].alias("jitter"), v["edit"].alias("edit"), v["color"].alias("color"),
        a["codec"].alias("audio_codec"), a["sample_entries"].alias("audio_entries"), a["offsets_kind"].alias("audio_offsets"), a["samples"].alias("audio_samples"), a["chunks"].alias("audio_chunks"),
        F.coalesce("sounds", F.lit(0)).alias("audio_tracks"), F.greatest(F.lit(0), F.coalesce("top_id", F.lit(0))).alias("max_track_id"), F.coalesce("wide_offsets", F.lit(False)).alias("wide_offsets"), (F.col("file_size") - F.coalesce("last", F.lit(0))).alias("trailing_bytes"),
    )


#: The least share that a box is shown with, in percent, and how many boxes the legend names.
LEAST_SHARE, LEGEND = 0.4, 8


def layout(files: DataFrame, boxes: DataFrame) -> DataFrame:
    """(file_id, ordinal, type, size, share, in_legend): the top-level boxes of each file of files (file_id, file_size).

    share: of the file's size in percent, as wide as it is drawn.  The first LEGEND boxes are named in the legend.
    """
    top = boxes.where("depth = 0").select("file_id", F.col("child_ordinal").alias("ordinal"), "type", "size")
    share = F.greatest(F.lit(LEAST_SHARE), F.col("size").cast("double") / F.greatest(F.col("file_size"), F.lit(1)).cast("double") * 100)
    return top.join(files.select("file_id", "file_size"), "file_id").select("file_id", "ordinal", "type", "size", share.alias("share"), (F.col("ordinal") < LEGEND).alias("in_legend"))
