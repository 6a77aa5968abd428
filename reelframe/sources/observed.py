"""A rewrite that breaks the standard on purpose: sound cloned under a new number, with samples that lie outside any box.

It is opt-in, never recommended by a plan, and every row says so (CLASSIFICATION, compliant, VALIDATION).  The index is
taken apart into rows (see trees); what is wrong with a file is found by aggregates over them, before any table is
unpacked or grown; edit lists go; the clock and the largest bitrate of the sound track are set by its samples; the track is
copied with its tables grown by closed forms, run by run and not sample by sample; an encoder tag is set if one is given.
Chunk offsets take four bytes whatever they are, so the size of the index is known before them, and the layout is
settled in one pass: media moves by one shift, and the clone's last chunk is where the media ends.  The index is then
put together, taken apart again, and each offset compared, before a row is handed on.

transform() gives the bytes before the media and the range of the media, and write() in `ranges` copies that range and
the tail in parts of bounded size.

Defined results: a file that is declined has null `front` and a code in `error`, the first that applies in the order of
DECLINED; a null content is declined as one without boxes; repeated names of files are not supported; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import binary, descriptors
from reelframe.operators import exact
from reelframe.plans.steps import MOST_ID, MOST_TAIL, MOST_WORK, PAD_BYTES, PAD_TIMES, STSZ_WORK
from reelframe.sources import containers, trees
from reelframe.sources.rewrites import DROPPED, KNOWN
from reelframe.storage import kept

#: A sample of the tail, and what is said of every result.
PATTERN = bytes.fromhex("0000000400000000")
CLASSIFICATION, VALIDATION = "OBSERVED", "NOT APPROVED"
#: Why a file is declined, in the order in which reasons are looked for.
DECLINED = (
    "unknown-boxes", "not-one-of-each", "trailing-bytes", "damaged-index", "wide-offsets", "inexact-offsets", "no-video", "not-one-audio", "not-aac", "no-sample-table", "not-one-description",
    "inexact-sizes", "uniform-sizes", "no-samples", "too-many-samples", "inexact-runs", "empty-timeline", "long-timeline", "no-clock", "high-bitrate", "damaged-description", "no-header", "no-number-left", "no-chunks", "offset-outside-media", "offset-too-large",
)
TABLES = ("tkhd", "mdia/mdhd", "mdia/hdlr", "mdia/minf/stbl/stts", "mdia/minf/stbl/stsz", "mdia/minf/stbl/stsc", "mdia/minf/stbl/stco")
FRONTS = "file_id, front, media_start, media_size, pad_samples, pad_bytes, cloned_track, source_samples, offset_shift, edit_lists_removed, dropped, error"


def grown_runs(stts: Column, samples: Column) -> Column:
    """Time-to-sample runs with one more: `samples` of one tick."""
    return _grown(stts, 4, 1, F.concat(binary.encoded(samples, 4), binary.encoded(F.lit(1), 4)))


def grown_sizes(stsz: Column, samples: Column) -> Column:
    """An explicit table of sizes with `samples` more of PAD_BYTES each."""
    return _grown(stsz, 8, samples, F.unhex(F.repeat(F.lit(f"{PAD_BYTES:08x}"), samples.cast("int"))))


def grown_chunks(stsc: Column, chunks: Column, samples: Column) -> Column:
    """Sample-to-chunk runs with one more: a chunk behind the others with `samples`."""
    return _grown(stsc, 4, 1, F.concat(binary.encoded(chunks + 1, 4), binary.encoded(samples, 4), binary.encoded(F.lit(1), 4)))


def grown_offsets(stco: Column) -> Column:
    """Chunk offsets with one more, which is zero until the layout is known."""
    return _grown(stco, 4, 1, F.unhex(F.lit("00000000")))


def _grown(data: Column, at: int, more: Column | int, entries: Column) -> Column:
    """A table with a count at an offset: `more` is added to it, and entries are added behind the others."""
    count = binary.unsigned(data, at, 4) + (more if isinstance(more, Column) else F.lit(more))
    return F.concat(F.substring(data, 1, at), binary.encoded(count, 4), F.substring(data, F.lit(at + 5), F.octet_length(data)), entries)


def size_error(stsz: Column) -> Column:
    """Why a table of sample sizes is not grown, by its declared count and its length alone; null if it may be."""
    uniform, n = binary.unsigned(stsz, 4, 4), binary.unsigned(stsz, 8, 4)
    padded = n * PAD_TIMES
    work = padded * PAD_BYTES + (12 + (n + padded) * 4) * 3 + (n + padded) * STSZ_WORK
    return (
        F.when(F.octet_length(stsz) < 12, "inexact-sizes").when(uniform != 0, "uniform-sizes").when(n == 0, "no-samples").when(F.octet_length(stsz) != 12 + n * 4, "inexact-sizes")
        .when((n + padded > MOST_ID) | (padded * PAD_BYTES > MOST_TAIL) | (work > MOST_WORK), "too-many-samples")
    )


def shifted(stco: Column, shift: Column, last: Column) -> Column:
    """Chunk offsets moved by shift, or the last one set to `last` where that is not null."""
    table = binary.read_offsets(stco, F.lit("stco"))
    moved = F.transform(table, lambda v, k: F.when(last.isNotNull() & (k == F.size(table) - 1), last).otherwise(v + shift))
    return F.concat(F.substring(stco, 1, 8), F.unhex(F.array_join(F.transform(moved, lambda v: F.hex(binary.encoded(v, 4))), "")))


def _tracks(nodes: DataFrame) -> DataFrame:
    """(file_id, trak, place, handler, tables by name, ...) of the tracks."""
    trak = F.regexp_extract("path", r"^(moov\[\d+\]/trak\[\d+\])(/|$)", 1)
    inside = nodes.withColumn("trak", trak).where("trak <> ''").withColumn("rel", trees.plain(F.expr("substring(path, length(trak) + 2)")))

    def first(rel: str, value: Column) -> Column:
        return F.min_by(F.when(F.col("rel") == rel, value), F.when(F.col("rel") == rel, F.col("place")))

    payloads = [first(rel, F.struct("path", "payload")).alias(rel.rsplit("/", 1)[-1]) for rel in TABLES]
    stsd = first("mdia/minf/stbl/stsd", F.struct("path", "payload", "before")).alias("stsd")
    format_ = F.min_by(F.when(F.col("rel").rlike("^mdia/minf/stbl/stsd/[^/]+$"), F.col("type")), F.when(F.col("rel").rlike("^mdia/minf/stbl/stsd/[^/]+$"), F.col("place"))).alias("format")
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("stsz", "stco", "co64")]
    place = F.max(F.when(F.col("rel") == "", F.col("place"))).alias("place")
    inside = inside.where(F.col("rel").isin("", "mdia/minf/stbl/stsd", *TABLES) | F.col("rel").rlike("^mdia/minf/stbl/stsd/[^/]+$") | F.col("type").isin("stsz", "stco", "co64"))
    rows = inside.groupBy("file_id", "trak").agg(place, stsd, format_, *payloads, *counts)
    kind = F.when(F.octet_length("hdlr.payload") >= 12, F.substring("hdlr.payload", 9, 4).cast("string"))
    return rows.withColumn("handler", kind)


def _facts(lengths: DataFrame, top: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each file: where its boxes lie, its sound track with all that is computed from it, and why it is declined."""
    at = {kind: F.max(F.when(F.col("type") == kind, F.struct("start", "size", "header_size"))).alias(f"_{kind}") for kind in ("ftyp", "moov", "mdat")}
    counts = [F.count_if(F.col("type") == kind) for kind in ("ftyp", "moov", "mdat")]
    boxes = top.groupBy("file_id").agg(
        *at.values(), F.bool_or(~F.col("type").isin(*KNOWN)).alias("_unknown"), ((counts[0] != 1) | (counts[1] != 1) | (counts[2] != 1)).alias("_not_one"), F.max("end").alias("_end"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type").isin(*DROPPED), F.struct("child_ordinal", "type")))), lambda x: x["type"]).alias("dropped"), F.max("error").alias("_error"),
    )
    media = F.struct((F.col("_mdat.start") + F.col("_mdat.header_size")).alias("start"), (F.col("_mdat.start") + F.col("_mdat.size")).alias("end"))
    whole = lengths.select("file_id", F.col("file_size").alias("_length")).join(boxes, "file_id", "left").withColumn("_media", media)
    tracks = kept(_tracks(nodes))
    kind = F.col("type")
    heads = nodes.where(kind.isin("tkhd", "mvhd", "stco", "co64")).groupBy("file_id").agg(
        F.max(F.when(kind == "tkhd", binary.track_number(F.col("payload")))).alias("_most"), F.bool_or(F.when(kind == "tkhd", binary.track_number(F.col("payload")).isNull())).alias("_unnumbered"),
        F.min_by(F.when((kind == "mvhd") & (F.col("depth") == 1), F.struct("path", "payload")), F.when((kind == "mvhd") & (F.col("depth") == 1), F.col("place"))).alias("mvhd"),
        F.count_if(kind == "co64").alias("_wide"), F.bool_or((kind == "stco") & ~binary.is_exact_table(F.col("payload"), 4)).alias("_inexact"),
    )
    sounds = tracks.groupBy("file_id").agg(F.count_if(F.col("handler") == "vide").alias("_videos"), F.count_if(F.col("handler") == "soun").alias("_sounds"), F.max("place").alias("_last"))
    sound = tracks.where("handler = 'soun'").groupBy("file_id").agg(F.min_by(F.struct("trak", "format", "stsd", "n_stsz", "n_stco", *[t.rsplit("/", 1)[-1] for t in TABLES]), "place").alias("s"))
    rows = whole
    for side in (heads, sounds, sound):
        rows = rows.join(side, "file_id", "left")
    n, timescale = binary.unsigned(F.col("s.stsz.payload"), 8, 4), _timescale(F.col("s.mdhd.payload"))
    rows = rows.withColumn("_sizes", size_error(F.col("s.stsz.payload")))
    may = F.col("_sizes").isNull() & F.col("s.stsz.payload").isNotNull()  # no table is unpacked before its length is known
    rows = rows.withColumns({
        "source_samples": F.when(may, n), "_bytes": F.when(may, binary.read_stsz(F.col("s.stsz.payload"))["total"]), "_ticks": exact.timeline_of(binary.read_stts(F.col("s.stts.payload"))),
        "_duration": binary.media_duration(F.col("s.mdhd.payload")), "_chunks": binary.unsigned(F.col("s.stco.payload"), 4, 4), "_entries": binary.unsigned(F.coalesce("s.stsd.before", "s.stsd.payload"), 4, 4),
    })
    bitrate, fault = exact.bitrate_over(F.col("_bytes"), timescale, F.col("_duration"))
    rows = rows.withColumns({"_bitrate": F.when(may, bitrate), "_fault": F.when(may, fault)})
    tests = {
        "unknown-boxes": F.col("_unknown"), "not-one-of-each": F.coalesce("_not_one", F.lit(True)), "trailing-bytes": F.col("_end") != F.col("_length"), "damaged-index": F.col("_error").isNotNull(), "wide-offsets": F.col("_wide") > 0,
        "inexact-offsets": F.col("_inexact"), "no-video": F.coalesce("_videos", F.lit(0)) == 0, "not-one-audio": F.col("_sounds") != 1, "not-aac": _format(F.col("s")) != "mp4a",
        "no-sample-table": F.coalesce((F.col("s.n_stsz") != 1) | (F.col("s.n_stco") != 1), F.lit(True)) | F.col("s.stts").isNull() | F.col("s.stsc").isNull() | F.col("s.stsz").isNull() | F.col("s.mdhd").isNull(),
        "not-one-description": F.coalesce(F.col("_entries") != 1, F.lit(True)), **{code: F.col("_sizes") == code for code in ("inexact-sizes", "uniform-sizes", "no-samples", "too-many-samples")},
        "inexact-runs": ~binary.is_exact_table(F.col("s.stts.payload"), 8) | ~binary.is_exact_table(F.col("s.stsc.payload"), 12), "empty-timeline": F.col("_ticks") <= 0, "long-timeline": F.col("_ticks") > exact.MOST_EXACT,
        "no-clock": F.col("_fault") == exact.CLOCK, "high-bitrate": F.col("_fault") == exact.LARGE, "damaged-description": F.col("s.stsd.before").isNull(), "no-header": F.col("mvhd").isNull() | F.col("_unnumbered"),
        "no-number-left": F.col("_most") >= MOST_ID - 1, "no-chunks": F.col("_chunks") == 0,
    }
    return rows.withColumn("error", F.coalesce(*[F.when(test, code) for code, test in tests.items()]))


def _timescale(mdhd: Column) -> Column:
    return F.when(binary.unsigned(mdhd, 0, 1) == 1, binary.unsigned(mdhd, 20, 4)).otherwise(binary.unsigned(mdhd, 12, 4))


def _format(sound: Column) -> Column:
    """The format of a track: of its first entry, or read from a description that was not taken apart."""
    return F.coalesce(sound["format"], F.substring(sound["stsd"]["payload"], 13, 4).cast("string"), F.lit(""))


def _edits(nodes: DataFrame, facts: DataFrame, tag: str | None) -> DataFrame:
    """The rows of the new index, with chunk offsets as they were and a placeholder."""
    pad, clone = F.col("source_samples") * PAD_TIMES, F.concat(F.regexp_extract("s.trak", r"^(.*)\[", 1), F.lit("[+]"))
    ticks = F.col("_ticks").cast("long")

    def renamed(path: Column) -> Column:
        return F.concat(clone, F.substring(path, F.length("s.trak") + 1, F.length(path)))

    nodes = trees.without_edit_lists(nodes.join(facts.select("file_id"), "file_id", "left_semi"))
    changes = facts.select("file_id", F.inline(F.array(F.struct(F.col("s.mdhd.path").alias("path"), binary.with_media_duration(F.col("s.mdhd.payload"), ticks).alias("payload")), F.struct(F.col("mvhd.path").alias("path"), binary.with_next_track_number(F.col("mvhd.payload"), F.col("_most") + 2).alias("payload")))))
    described = nodes.where("type IN ('esds', 'btrt')").join(facts.select("file_id", F.concat("s.stsd.path", F.lit("/")).alias("_stsd"), "_bitrate"), "file_id").where(F.col("parent").startswith(F.col("_stsd")) & F.col("parent").rlike(r"/mp4a\[0\]$"))
    rated = F.when(F.col("type") == "esds", descriptors.with_maximum_bitrate(F.col("payload"), F.col("_bitrate"))).otherwise(descriptors.with_box_bitrate(F.col("payload"), F.col("_bitrate")))
    nodes = trees.replaced(nodes, changes.unionByName(described.select("file_id", "path", rated.alias("payload"))))
    nodes = nodes.unionByName(trees.copied(nodes, facts.select("file_id", F.col("s.trak").alias("path"), clone.alias("copy"), (F.col("_last") + 0.5).alias("place"))))
    table = F.col("s.stco.payload")
    grown = {
        "tkhd": binary.with_track_number(F.col("s.tkhd.payload"), F.col("_most") + 1), "mdhd": binary.with_media_duration(F.col("s.mdhd.payload"), ticks + pad), "stts": grown_runs(F.col("s.stts.payload"), pad),
        "stsz": grown_sizes(F.col("s.stsz.payload"), pad), "stsc": grown_chunks(F.col("s.stsc.payload"), F.col("_chunks"), pad), "stco": grown_offsets(table),
    }
    more = facts.select("file_id", F.inline(F.array(*[F.struct(renamed(F.col(f"s.{name}.path")).alias("path"), payload.alias("payload")) for name, payload in grown.items()])))
    nodes = trees.replaced(nodes, more)
    return nodes if tag is None else trees.tagged_encoder(nodes, tag)


def transform(files: DataFrame, tag: str | None = None, key: str = "file_id", content: str = "content") -> DataFrame:
    """A row for each file (file_id, content), as FRONTS with classification, compliant and validation.

    front: the bytes before the media; the media is media_size bytes of the source from media_start on; behind it come
    pad_samples times PATTERN.  tag: the text of an encoder tag, or None to leave tags as they are.
    """
    files = files.select(F.col(key).cast("string").alias("file_id"), F.col(content).alias("content"))
    top = kept(containers.boxes(files, deepest=0))
    brand = F.expr("substring(content, CAST(start + 1 AS int), CAST(size AS int))")
    brands = files.join(top.where("type = 'ftyp'"), "file_id").groupBy("file_id").agg(F.min_by(brand, "start").alias("_brand"))
    return transform_index(files.select("file_id", F.octet_length("content").cast("long").alias("file_size")), top, brands, files, tag)


def transform_index(lengths: DataFrame, top: DataFrame, brands: DataFrame, indexes: DataFrame, tag: str | None = None) -> DataFrame:
    """transform() of files of which only headers and indexes were read.

    lengths: (file_id, file_size); top: their top-level boxes as containers.BOXES; brands: (file_id, _brand), the whole
    ftyp box; indexes: (file_id, content) with the moov box, alone or not.
    """
    nodes = kept(trees.parts(indexes, entries=True))
    facts = kept(_facts(lengths, top, nodes))
    good = facts.where("error IS NULL")
    edited = kept(_edits(nodes, good, tag))
    own = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("before", "payload", "after")), F.lit(8).cast("long"))
    sizes = edited.groupBy("file_id").agg(F.sum(own).alias("_index"))  # an index that fits a row has headers of eight bytes alone
    laid = good.join(sizes, "file_id").join(brands, "file_id")
    begins = F.octet_length("_brand") + F.col("_index") + F.col("_mdat.header_size")
    length = F.col("_mdat.size") - F.col("_mdat.header_size")
    laid = laid.withColumns({"_begins": begins, "offset_shift": begins - F.col("_media.start"), "_tail": begins + length})
    tables = edited.where("type = 'stco'").join(laid.select("file_id", "offset_shift", "_begins", "_tail", F.concat(F.regexp_extract("s.trak", r"^(.*)\[", 1), F.lit("[+]/")).alias("_clone")), "file_id")
    cloned = F.col("path").startswith(F.col("_clone"))
    old = binary.read_offsets(F.col("payload"), F.lit("stco"))
    real = F.when(cloned, F.slice(old, 1, F.size(old) - 1)).otherwise(old)
    outside = F.exists(real, lambda v: (v + F.col("offset_shift") < F.col("_begins")) | (v + F.col("offset_shift") >= F.col("_tail")))
    tables = kept(tables.withColumns({"_cloned": cloned, "_fault": F.when(outside, "offset-outside-media").when(F.col("_tail") > MOST_ID, "offset-too-large")}))
    faults = tables.groupBy("file_id").agg(F.min("_fault").alias("_late"))
    placed = tables.where("_fault IS NULL").select("file_id", "path", shifted(F.col("payload"), F.col("offset_shift"), F.when(F.col("_cloned"), F.col("_tail"))).alias("payload"))
    settled = kept(trees.assembled(trees.replaced(edited.join(faults.where("_late IS NULL"), "file_id", "left_semi"), placed)))
    read = _read_again(settled, tables)
    removed = trees.edit_lists(nodes).groupBy("file_id").agg(F.count_distinct("parent").alias("edit_lists_removed"))
    made = laid.select("file_id", "_brand", "offset_shift").join(faults, "file_id").join(settled, "file_id", "left").join(read, "file_id", "left")
    rows = facts.join(made, "file_id", "left").join(removed, "file_id", "left").withColumn("error", F.coalesce("error", "_late", F.when(~F.coalesce("_same", F.lit(False)), "offset-outside-media")))
    pad = F.col("source_samples") * PAD_TIMES
    values = {
        "front": F.concat("_brand", "content"), "media_start": F.col("_mdat.start"), "media_size": F.col("_mdat.size"), "pad_samples": pad, "pad_bytes": pad * PAD_BYTES, "cloned_track": F.col("_most") + 1, "source_samples": F.col("source_samples"),
        "offset_shift": F.col("offset_shift"), "edit_lists_removed": F.coalesce("edit_lists_removed", F.lit(0)), "dropped": F.col("dropped"),
    }
    shown = [F.when(F.col("error").isNull(), value).alias(name) for name, value in values.items()]
    return rows.select("file_id", *shown, "error", F.lit(CLASSIFICATION).alias("classification"), F.lit(False).alias("compliant"), F.lit(VALIDATION).alias("validation"))


def _read_again(settled: DataFrame, tables: DataFrame) -> DataFrame:
    """(file_id, _same): whether each table of a finished index, in order, holds what was meant."""
    found = trees.parts(settled).where("type = 'stco'").groupBy("file_id").agg(F.sort_array(F.collect_list(F.col("payload"))).alias("_is"))
    meant = tables.groupBy("file_id").agg(F.sort_array(F.collect_list(shifted(F.col("payload"), F.col("offset_shift"), F.when(F.col("_cloned"), F.col("_tail"))))).alias("_meant"))
    return found.join(meant, "file_id").select("file_id", (F.col("_is") == F.col("_meant")).alias("_same"))


def whole(made: DataFrame, files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """(file_id, content) of what transform() has made of files whose bytes are a column, tail and all."""
    source = files.select(F.col(key).cast("string").alias("file_id"), F.col(content).alias("_content"))
    media = F.expr("substring(_content, CAST(media_start + 1 AS int), CAST(media_size AS int))")
    tail = F.unhex(F.repeat(F.lit(PATTERN.hex()), F.col("pad_samples").cast("int")))
    return made.where("error IS NULL").join(source, "file_id").select("file_id", F.concat("front", media, tail).alias("content"))
