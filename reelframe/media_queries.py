"""More queries with DuckDB SQL: containers with sound and picture made of columns, trees, exact sums, and what rewrites leave.

They register themselves with reelframe.registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import binary, decoders, descriptors, formats
from reelframe.functions.binary import boxed, number, zeros
from reelframe.operators import analysis, compare, exact, timing
from reelframe.plans import steps
from reelframe.registry import _FACTS_SQL, _event_gaps, _facts, _fixed_sql, _hist_sql, _made_containers, query
from reelframe.session import spread, table
from reelframe.sources import containers, observed, rewrites, trees
from reelframe.storage import kept


def _text(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("binary")


def _list_sql(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


# ---------------------------------------------------------------- containers with sound and picture

#: Values that the containers of parts take in turn.
_AVC, _CHROMA = (66, 77, 88, 100, 110, 122, 244, 50), ("monochrome", "4:2:0", "4:2:2", "4:4:4")
_TRANSFER = (1, 16, 18, 2)
_PART = "SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS file_id, CAST(p_size AS BIGINT) AS s, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_brand FROM part"


def _one_of(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, file_size, content): for each part a picture by one of two codecs, sound with descriptors and packed sizes, an edit list, colours and an encoder tag, as its columns say."""
    k, s, cents = F.col("p_partkey"), F.col("p_size").cast("long"), F.round(F.col("p_retailprice") * 100).cast("long")
    nothing = zeros(0)

    def trak(kind: str, track: Column, scale: int, edits: Column, *tables: Column) -> Column:
        head = boxed("mdia", boxed("mdhd", zeros(12), number(scale), number(s * scale), zeros(4)), boxed("hdlr", zeros(8), _text(kind), zeros(13)), boxed("minf", boxed("stbl", *tables)))
        return boxed("trak", boxed("tkhd", zeros(12), number(track), zeros(68)), edits, head)

    avc = boxed("avcC", number(1, 1), number(_one_of(_AVC, s), 1), zeros(1), number(10 + k % 50, 1), number(0xFFE1, 2), number(3, 2), _text("sps"), number(1, 1), number(2, 2), _text("pp"), number(0xFC + k % 4, 1), number(0xF8 + k % 5, 1), zeros(2))
    hevc = boxed("hvcC", number(1, 1), number(F.when(k % 3 == 0, 32).otherwise(0) + k % 7, 1), zeros(10), number(30 + k % 150, 1), zeros(3), number(0xFC + k % 4, 1), number(0xF8 + k % 5, 1), zeros(5))
    colr = F.when(k % 4 != 0, boxed("colr", _text("nclx"), number(1 + k % 2, 2), number(_one_of(_TRANSFER, F.floor(k / 2)), 2), number(1, 2), zeros(1))).otherwise(nothing)
    picture = F.when(k % 2 == 0, boxed("avc1", zeros(78), avc, colr)).otherwise(boxed("hvc1", zeros(78), hevc, colr))
    edits = F.when(k % 3 == 0, boxed("edts", boxed("elst", zeros(4), number(1), number(s), number(F.when(k % 6 == 0, (1 << 32) - 1).otherwise(s)), number(65536)))).otherwise(nothing)
    video = trak("vide", F.lit(1), 15360, edits, boxed("stsd", zeros(4), number(1), picture), boxed("stts", zeros(4), number(2), number(s * 30 - 1), number(512), number(1), number(512 + s)), boxed("stsz", zeros(4), number(1000), number(s * 30)), boxed("stco", zeros(4), number(1), number(8)))
    config = (1 + k % 5) * 2048 + s % 13 * 128 + k % 8 * 8
    esds = boxed("esds", zeros(4), number(0x0319, 2), number(0x000100, 3), number(0x0411, 2), number(0x4015, 2), zeros(3), number(cents + 9), number(F.when(k % 7 == 0, 0).otherwise(cents)), number(0x0502, 2), number(config, 2))
    parts = [F.when(k % 3 != 1, esds).otherwise(nothing), F.when(k % 4 != 3, boxed("btrt", zeros(8), number(cents + 1))).otherwise(nothing)]
    sound = boxed("mp4a", zeros(16), number(1, 2), number(16, 2), zeros(4), number(44100 * 65536), *parts)
    z = k % 15 + 1
    four = F.unhex(F.concat(F.repeat(F.lower(F.hex(z)), s.cast("int")), F.when(s % 2 == 1, "0").otherwise("")))
    packed = F.when(k % 4 == 0, F.concat(number(4, 1), number(s), four)).when(k % 4 == 1, F.concat(number(8, 1), number(s), F.unhex(F.repeat(F.lpad(F.hex(z), 2, "0"), s.cast("int"))))).otherwise(F.concat(number(16, 1), number(s), F.unhex(F.repeat(F.lpad(F.hex(z), 4, "0"), s.cast("int")))))
    sizes = F.when(k % 4 == 3, boxed("stsz", zeros(8), number(s), F.unhex(F.repeat(F.lpad(F.hex(z), 8, "0"), s.cast("int"))))).otherwise(boxed("stz2", zeros(7), packed))
    audio = trak("soun", k + 2, 48000, nothing, boxed("stsd", zeros(4), number(1), sound), boxed("stts", zeros(4), number(1), number(s * 10), number(4800)), sizes, boxed("stco", zeros(4), number(s + 1), number(8)))
    too = boxed(F.unhex(F.lit("A9746F6F")), boxed("data", zeros(8), _text(F.col("p_brand")), zeros(2)))
    older = boxed(F.unhex(F.lit("A9746F6F")), zeros(4), _text(F.col("p_brand")))
    udta = F.when(k % 4 == 1, boxed("udta", older)).when(k % 2 == 0, boxed("udta", boxed("meta", zeros(4), boxed("hdlr", zeros(25)), boxed("ilst", too)))).otherwise(nothing)
    mvhd = boxed("mvhd", zeros(12), number(F.when(k % 10 == 0, 0).otherwise(1000)), number(s * 2000), zeros(80))
    moov = boxed("moov", mvhd, video, audio, F.when(k % 11 == 0, boxed("mvex")).otherwise(nothing), udta)
    media = F.when(k % 9 == 0, F.concat(number(1), _text("mdat"), number(24, 8), zeros(8))).otherwise(boxed("mdat", zeros(8)))
    ftyp = boxed("ftyp", _text("isom"), number(s), F.unhex(F.repeat(F.lit("6D703432"), (k % 4).cast("int"))))
    return table(spark, sf_dir, "part").select(k.cast("string").alias("file_id"), cents.alias("file_size"), F.concat(ftyp, moov, media).alias("content"))


@query(f"""
WITH p AS ({_PART}), q AS (SELECT *, {_list_sql(_AVC)}[1 + s % 8] AS profile FROM p)
SELECT file_id, CASE WHEN k % 2 = 0 THEN 'avc1' ELSE 'hvc1' END AS format,
  CASE WHEN k % 2 = 0 THEN CASE profile {" ".join(f"WHEN {n} THEN '{name}'" for n, name in decoders.AVC_PROFILES.items())} ELSE 'profile ' || profile END
  ELSE CASE k % 7 {" ".join(f"WHEN {n} THEN '{name}'" for n, name in decoders.HEVC_PROFILES.items() if n < 7)} ELSE 'profile ' || (k % 7) END || CASE WHEN k % 3 = 0 THEN ' (High tier)' ELSE ' (Main tier)' END END AS profile,
  CASE WHEN k % 2 = 0 THEN ((10 + k % 50) // 10) || '.' || ((10 + k % 50) % 10) ELSE ((30 + k % 150) // 30) || '.' || CAST(floor((30 + k % 150) % 30 / CAST(3 AS DOUBLE) + 0.5) AS BIGINT) END AS level,
  CASE WHEN k % 2 = 1 OR profile IN (100, 110, 122, 244) THEN {_list_sql(_CHROMA)}[1 + k % 4] WHEN profile IN (66, 77, 88) THEN '4:2:0' END AS chroma,
  CAST(CASE WHEN k % 2 = 1 OR profile IN (100, 110, 122, 244) THEN 8 + k % 5 WHEN profile IN (66, 77, 88) THEN 8 END AS INT) AS bit_depth FROM q
""")
def container_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two picture codecs declare."""
    found = analysis.tracks(containers.boxes(_rich(spark, sf_dir), payloads=True))
    return found.where("kind = 'video'").select("file_id", "format", "profile", "level", "chroma", "bit_depth")


@query(f"""
WITH p AS ({_PART}), q AS (SELECT *, k % 3 <> 1 AS told FROM p)
SELECT file_id, k + 2 AS track_id, CAST(CASE WHEN told THEN {_list_sql(decoders.AAC_CHANNELS)}[1 + k % 8] ELSE 1 END AS BIGINT) AS channels, CAST(CASE WHEN told THEN {_list_sql(decoders.AAC_RATES)}[1 + s % 13] ELSE 44100 END AS BIGINT) AS rate,
  CASE WHEN told THEN {_list_sql(decoders.AAC_TYPES[n] for n in range(1, 6))}[1 + k % 5] END AS audio_profile, CASE WHEN told AND k % 7 <> 0 THEN cents WHEN k % 4 <> 3 THEN cents + 1 END AS declared_bitrate,
  s AS samples, s * (k % 15 + 1) AS bytes, CAST(s * (k % 15 + 1) * 8 AS DOUBLE) / CAST(s AS DOUBLE) AS bitrate, 'stco' AS offsets_kind, s + 1 AS chunks FROM q
""")
def container_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound by its descriptors where it has them, sizes in 4, 8, 16 and 32 bits, and a count of chunks that is more than there are."""
    found = analysis.tracks(containers.boxes(_rich(spark, sf_dir), payloads=True))
    return found.where("kind = 'audio'").select("file_id", "track_id", "channels", "rate", "audio_profile", "declared_bitrate", "samples", "bytes", "bitrate", "offsets_kind", "chunks")


@query(f"""
WITH p AS ({_PART}), q AS (SELECT *, 1 + k % 2 AS pri, {_list_sql(_TRANSFER)}[1 + k // 2 % 4] AS tra, k % 4 <> 0 AS tagged FROM p)
SELECT file_id, CASE WHEN k % 10 = 0 THEN CAST(s AS DOUBLE) ELSE CAST(2 * s AS DOUBLE) END AS duration, CASE WHEN k % 10 <> 0 THEN CAST(cents * 8 AS DOUBLE) / CAST(2 * s AS DOUBLE) END AS overall_bitrate, k + 2 AS max_track_id,
  k % 11 = 0 AS fragmented, k % 9 = 0 AS large, true AS faststart, CASE WHEN k % 4 = 1 OR k % 2 = 0 THEN p_brand END AS encoder, CASE WHEN k % 3 = 0 THEN k % 6 = 0 END AS edit_list, CASE WHEN k % 6 = 0 THEN -1 WHEN k % 3 = 0 THEN s END AS first_time,
  tagged AND tra IN (16, 18) AS hdr, NOT tagged OR pri = 2 OR tra = 2 AS unspecified, tagged AND pri = 1 AND tra = 1 AS rec709, 'isom' AS major, s AS minor, CAST(k % 4 AS INT) AS brands,
  CAST(s AS DOUBLE) / CAST(512 AS DOUBLE) * 100 AS jitter, CAST(15360 AS DOUBLE) / CAST(512 + s AS DOUBLE) AS min_fps FROM q
""")
def container_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of a whole file."""
    files = _rich(spark, sf_dir)
    said = analysis.reports(files, containers.boxes(files, payloads=True))
    color = [F.col(f"color.{name}").alias(name) for name in ("hdr", "unspecified", "rec709")]
    return said.select("file_id", "duration", "overall_bitrate", "max_track_id", "fragmented", "large", "faststart", "encoder", "edit_list", F.col("edit.first_time").alias("first_time"), *color, F.col("brand.major").alias("major"), F.col("brand.minor").alias("minor"), F.size("brand.compatible").alias("brands"), "jitter", "min_fps")


@query(f"""
WITH p AS ({_PART}) SELECT file_id, 3 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 1 OR k % 2 = 0 THEN 1 ELSE 0 END AS children, 'moov[1]/trak[1]' AS first_trak, 2 AS tables, 24 AS clock_bytes, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS metas FROM p
""")
def tree_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, first children, boxes of a type and payloads by path."""
    files = _rich(spark, sf_dir)
    found = containers.boxes(files, payloads=True)
    counts = found.groupBy("file_id").agg(F.count_if(F.col("path").rlike(r"^moov\[1\]/[^/]*$")).alias("_direct"))
    direct = containers.children(found, "moov").groupBy("file_id").agg(F.count(F.lit(1)).alias("children"))
    first = containers.first_child(found, "moov", "trak").select("file_id", F.col("path").alias("first_trak"))
    tables = containers.find_all(found, "stco").groupBy("file_id").agg(F.count(F.lit(1)).alias("tables"))
    clock = found.where("path = 'moov[1]/trak[1]/mdia[' || if(CAST(file_id AS long) % 3 = 0, 2, 1) || ']/mdhd[0]'").select("file_id", F.octet_length("payload").cast("long").alias("clock_bytes"))
    metas = counts.join(containers.find_all(found, "meta").groupBy("file_id").agg(F.count(F.lit(1)).alias("m")), "file_id", "left").select("file_id", F.coalesce("m", F.lit(0)).alias("metas"))
    return direct.join(first, "file_id").join(tables, "file_id").join(clock, "file_id").join(metas, "file_id")


@query(f"""
WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS file_id, p_partkey AS k, 540 + p_partkey * 36 % 1512 AS w, 540 + p_partkey * 60 % 1440 AS h FROM part),
d AS (SELECT *, CASE WHEN k % 4 = 0 THEN h || ' x ' || w ELSE w || ' x ' || h END AS dims FROM r)
SELECT file_id, unnest(['Index', 'Frame timing', 'Frame size', 'Frame rate', 'Codec']) AS label, unnest(['end of file', 'constant', dims, '30 fps', 'H.264 / AVC']) AS before, unnest(['front', 'constant', dims, '30 fps', 'H.264 / AVC']) AS after FROM d
UNION ALL SELECT file_id, 'Colour', CASE WHEN k % 3 <> 0 THEN 'not tagged' WHEN k % 20 IN (16, 18) THEN 'HDR · ' || name WHEN k % 20 = 1 THEN 'Rec.709' ELSE 'BT.709 / ' || coalesce(name, 'unknown (' || (k % 20) || ')') || ' / BT.709' END, 'Rec.709'
FROM d LEFT JOIN (VALUES {", ".join(f"({k}, '{v}')" for k, v in decoders.TRANSFERS.items())}) AS t(v, name) ON v = k % 20
""")
def report_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of containers and of their rewrites, row by row."""
    files = _made_containers(spark, sf_dir)
    made = rewrites.rewrite(files, retag=True).withColumn("file_size", F.octet_length("content").cast("long"))
    both = [analysis.reports(f, containers.boxes(f, payloads=True)) for f in (files, made)]
    pairs = both[0].select("file_id", F.struct(*both[0].columns).alias("before")).join(both[1].select("file_id", F.struct(*both[1].columns).alias("after")), "file_id")
    rows = compare.report_comparison(pairs, "file_id")
    return rows.where(F.col("label").isin("Index", "Frame timing", "Frame size", "Frame rate", "Codec", "Colour")).select("file_id", "label", "before", "after")


# ---------------------------------------------------------------- trees


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document an index of two tracks, one or both with an edit list, and a list of tags with its text as a title; of each third its source as an encoder too."""
    d, tag = F.col("doc_id"), F.unhex(F.lit("A9746F6F"))
    edts = boxed("edts", boxed("elst", zeros(20)))
    first = boxed("trak", boxed("tkhd", zeros(84)), edts)
    second = boxed("trak", boxed("tkhd", zeros(84)), F.when(d % 2 == 0, edts).otherwise(zeros(0)))
    title = boxed(F.unhex(F.lit("A96E616D")), boxed("data", zeros(8), _text(F.col("text"))))
    encoder = F.when(d % 3 == 0, boxed(tag, boxed("data", zeros(8), _text("old")))).otherwise(zeros(0))
    moov = boxed("moov", first, second, boxed("udta", boxed("meta", zeros(4), boxed("ilst", encoder, title))))
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("file_id"), boxed("ftyp", _text("isom"), zeros(4)).alias("_ftyp"), moov.alias("_moov")).select("file_id", F.concat("_ftyp", "_moov").alias("content"))


def _box_sql(kind: str, body: str) -> str:
    return f"from_hex(printf('%08x', 8 + octet_length({body}))) || from_hex('{kind}') || {body}"


def _titled_sql() -> str:
    """The bytes of the edited index, box by box: no edit lists, the encoder in place of an old one or behind the title."""
    hexed = {name: name.encode("latin-1").hex() for name in ("moov", "trak", "tkhd", "udta", "meta", "ilst", "data", "\xa9too", "\xa9nam")}
    steps = [
        ("t0", hexed["tkhd"], f"from_hex('{'00' * 84}')"), ("t1", hexed["trak"], "t0"), ("n0", hexed["data"], "(from_hex('0000000000000000') || encode(text))"), ("n1", hexed["\xa9nam"], "n0"), ("e0", hexed["data"], "(from_hex('0000000100000000') || encode('made here'))"), ("e1", hexed["\xa9too"], "e0"),
        ("l", hexed["ilst"], "(CASE WHEN doc_id % 3 = 0 THEN e1 || n1 ELSE n1 || e1 END)"), ("m", hexed["meta"], "(from_hex('00000000') || l)"), ("u", hexed["udta"], "m"), ("v", hexed["moov"], "(t1 || t1 || u)"),
    ]
    sql, source = "", "documents"
    for name, kind, body in steps:
        sql += f", s_{name} AS (SELECT *, {_box_sql(kind, body)} AS {name} FROM {source})"
        source = f"s_{name}"
    return f"WITH {sql[2:]} SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS removed, CAST(octet_length(v) AS BIGINT) AS size, sha256(v) AS digest FROM s_v"


@query(_titled_sql())
def tree_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes without edit lists and with an encoder tag: how many lists went, the measured size, and a digest of the bytes."""
    nodes = trees.parts(_titled(spark, sf_dir))
    removed = trees.edit_lists(nodes).groupBy("file_id").agg(F.count_distinct("parent").alias("removed"))
    edited = trees.tagged_encoder(trees.without_edit_lists(nodes), "made here")
    sizes = trees.measured(edited).where("path NOT LIKE '%/%'").select("file_id", "size")
    return removed.join(sizes, "file_id").join(trees.assembled(edited).select("file_id", F.sha2("content", 256).alias("digest")), "file_id")


# ---------------------------------------------------------------- exact sums, descriptors, tables

_RUNS_SQL = """
SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 7 THEN CAST(4294967296 + l_partkey AS BIGINT) WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity AS BIGINT) ELSE l_partkey * 2000003 % 4294967296 END AS count,
  CASE WHEN l_suppkey % 10 = 4 THEN CAST(0 AS BIGINT) WHEN l_suppkey % 3 = 0 THEN CAST(l_linenumber AS BIGINT) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * 613 % 4294967296 END AS delta FROM lineitem
"""


@query(f"""
WITH r AS ({_RUNS_SQL}), s AS (SELECT l_suppkey, sum(count::HUGEINT * delta) AS ticks, max(count) AS most FROM r GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN most <= 4294967295 AND ticks BETWEEN 1 AND 9007199254740991 THEN CAST(ticks AS BIGINT) END AS ticks, CASE WHEN most > 4294967295 THEN 'field out of range' WHEN ticks <= 0 THEN 'empty' WHEN ticks > 9007199254740991 THEN 'too large' END AS error FROM s
""")
def wide_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of timelines in ticks, of which many pass 2^63."""
    rows = table(spark, sf_dir, "lineitem")
    count = F.when(F.col("l_suppkey") % 10 == 7, F.col("l_partkey") + (1 << 32)).when(F.col("l_suppkey") % 3 == 0, F.col("l_quantity").cast("long")).otherwise(F.col("l_partkey") * 2_000_003 % (1 << 32))
    delta = F.when(F.col("l_suppkey") % 10 == 4, F.lit(0).cast("long")).when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber").cast("long")).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long") * 613 % (1 << 32))
    return exact.timelines(rows.select("l_suppkey", count.alias("count"), delta.alias("delta")), "l_suppkey")


@query("""
WITH s AS (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS size, CASE WHEN o_custkey % 9 = 1 THEN 0 WHEN o_custkey % 2 = 0 THEN 48000 ELSE 4000000000 END AS scale, CASE WHEN o_custkey % 9 = 2 THEN 0 ELSE o_custkey * 1000003 + 1 END AS ticks FROM orders),
a AS (SELECT o_custkey, CAST(sum(size) AS BIGINT) AS bytes, max(scale)::HUGEINT AS scale, max(ticks)::HUGEINT AS ticks FROM s GROUP BY o_custkey)
SELECT o_custkey, bytes, CASE WHEN scale > 0 AND ticks > 0 AND 8 * bytes::HUGEINT * scale < ticks * 4294967296 THEN CAST(8 * bytes::HUGEINT * scale // ticks AS BIGINT) END AS bitrate,
  CASE WHEN scale <= 0 OR ticks <= 0 THEN 'no duration or clock' WHEN 8 * bytes::HUGEINT * scale >= ticks * 4294967296 THEN 'too large' END AS error FROM a
""")
def wide_bitrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest bitrates by exact division, or why there is none."""
    c = F.col("o_custkey")
    scale = F.when(c % 9 == 1, 0).when(c % 2 == 0, 48000).otherwise(4_000_000_000)
    ticks = F.when(c % 9 == 2, 0).otherwise(c * 1_000_003 + 1)
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), scale.cast("long").alias("scale"), ticks.cast("long").alias("ticks"))
    return exact.maximum_bitrates(rows, "o_custkey", "size", F.max("scale"), F.max("ticks"))


@query("""
WITH p AS (SELECT page_id, length(html) AS n, 1 + page_id % 4 AS form, page_id % 5 = 0 AS other FROM pages)
SELECT page_id, CASE WHEN NOT other THEN 777 END AS before, CASE WHEN NOT other THEN n END AS after, CAST(32 + 2 * (form - 1) AS INT) AS bytes, true AS rest_same FROM p
""")
def descriptor_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest bitrate in descriptors with lengths of one to four bytes set to the length of a page; one with another tag stays."""
    p, n = F.col("page_id"), F.length("html").cast("long")

    def length(value: int) -> Column:
        return F.unhex(F.concat(F.repeat(F.lit("80"), (p % 4).cast("int")), F.lit(f"{value:02X}")))

    data = F.concat(zeros(4), number(F.when(p % 5 == 0, 5).otherwise(3), 1), length(30), number(0x000100, 3), number(4, 1), length(21), number(0x4015, 2), zeros(3), number(777), zeros(8), number(0x05021190, 4))
    rows = table(spark, sf_dir, "pages").select("page_id", n.alias("n"), data.alias("data"))
    made = rows.select("page_id", "data", descriptors.with_maximum_bitrate(F.col("data"), F.col("n")).alias("new"))
    back = descriptors.with_maximum_bitrate(F.col("new"), F.lit(777))
    return made.select("page_id", descriptors.maximum_bitrate(F.col("data")).alias("before"), descriptors.maximum_bitrate(F.col("new")).alias("after"), F.octet_length("new").alias("bytes"), (back == F.col("data")).alias("rest_same"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE conv_id % 4 WHEN 1 THEN 'uniform-sizes' WHEN 2 THEN 'inexact-sizes' WHEN 3 THEN CASE WHEN n = 0 THEN 'no-samples' END END AS error, 10 * n AS count, total + 72 * n AS total, 2 AS runs, 9 * n AS added FROM c
""")
def table_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of sizes and runs grown by nine samples for each, and why one is not, by its declared count alone."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("v")))).alias("a"))
    c, sizes = F.col("conv_id"), binary.write_stsz(F.transform("a", lambda x: x["v"]))
    pad = F.size("a").cast("long") * 9
    odd = F.when(c % 4 == 1, F.concat(zeros(7), number(5, 1), F.substring(sizes, F.lit(9), F.octet_length(sizes)))).when(c % 4 == 2, F.concat(zeros(8), number((1 << 32) - 1))).otherwise(sizes)
    stts = binary.write_stts(F.array(F.struct(F.size("a").cast("long").alias("count"), F.lit(1024).cast("long").alias("delta"))))
    grown = binary.read_stsz(observed.grown_sizes(sizes, pad))
    runs = binary.read_stts(observed.grown_runs(stts, pad))
    return rows.select("conv_id", observed.size_error(odd).alias("error"), grown["count"].alias("count"), grown["total"].alias("total"), F.size(runs).cast("long").alias("runs"), F.element_at(runs, 2)["count"].alias("added"))


# ---------------------------------------------------------------- the rewrite that breaks the standard


def _sounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part a picture and a sound track of p_size samples; of seven parts one has no sound, one another codec, one bytes behind its boxes and one 64-bit offsets."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")

    def trak(track: int, kind: Column, scale: int, *tables: Column) -> Column:
        head = boxed("mdia", boxed("mdhd", zeros(12), number(scale), number(s * 1000), zeros(4)), boxed("hdlr", zeros(8), kind.cast("binary"), zeros(13)), boxed("minf", boxed("stbl", *tables)))
        return boxed("trak", boxed("tkhd", zeros(12), number(track), zeros(68)), boxed("edts", boxed("elst", zeros(20))), head)

    offsets = F.when(k % 7 == 3, "co64").otherwise("stco")
    video = trak(1, F.lit("vide"), 600, boxed("stsd", zeros(4), number(1), boxed("avc1", zeros(78), boxed("avcC", zeros(1)))), boxed("stts", zeros(4), number(1), number(2), number(5)), boxed("stsz", zeros(4), number(4), number(2)), boxed("stsc", zeros(4), number(1), number(1), number(2), number(1)), boxed(offsets, zeros(4), number(1), number(24)))
    esds = boxed("esds", zeros(4), number(0x0319, 2), number(0x000100, 3), number(0x0411, 2), number(0x4015, 2), zeros(3), number(9), number(8), number(0x05021190))
    entry = boxed(F.when(k % 7 == 1, "ac-3").otherwise("mp4a"), zeros(28), esds, boxed("btrt", zeros(12)))
    sizes = boxed("stsz", zeros(8), number(s), F.unhex(F.repeat(F.lit("00000003"), s.cast("int"))))
    audio = trak(2, F.when(k % 7 == 0, "text").otherwise("soun"), 44100, boxed("stsd", zeros(4), number(1), entry), boxed("stts", zeros(4), number(1), number(s), number(1024)), sizes, boxed("stsc", zeros(4), number(1), number(1), number(s), number(1)), boxed("stco", zeros(4), number(2), number(28), number(30)))
    moov = boxed("moov", boxed("mvhd", zeros(96), number(9)), video, audio)
    content = F.concat(boxed("ftyp", _text("isom"), zeros(4)), boxed("mdat", _text(F.concat(F.lit("VVVV"), F.repeat(F.lit("aaa"), s.cast("int"))))), moov, F.when(k % 7 == 2, zeros(5)).otherwise(zeros(0)))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(k.cast("string").alias("file_id"), content.alias("content"))


_ERROR_SQL = "CASE k % 7 WHEN 0 THEN 'not-one-audio' WHEN 1 THEN 'not-aac' WHEN 2 THEN 'trailing-bytes' WHEN 3 THEN 'wide-offsets' END"


@query(f"""
WITH p AS ({_PART}), e AS (SELECT *, {_ERROR_SQL} AS error FROM p)
SELECT file_id, error, CASE WHEN error IS NULL THEN 9 * s END AS pad_samples, CASE WHEN error IS NULL THEN 72 * s END AS pad_bytes, CASE WHEN error IS NULL THEN 3 END AS cloned_track, CASE WHEN error IS NULL THEN s END AS source_samples,
  CASE WHEN error IS NULL THEN 8 + 108 + 392 + 2 * (393 + 4 * s) + 24 + 36 * s END AS offset_shift, CASE WHEN error IS NULL THEN 2 END AS edit_lists_removed, 'OBSERVED' AS classification, false AS compliant, 'NOT APPROVED' AS validation FROM e
""")
def observed_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in rewrite of containers: what it did, or why it declined, and what is said of it."""
    return observed.transform(_sounding(spark, sf_dir)).select("file_id", "error", "pad_samples", "pad_bytes", "cloned_track", "source_samples", "offset_shift", "edit_lists_removed", "classification", "compliant", "validation")


@query(f"""
WITH p AS ({_PART}), e AS (SELECT *, {_ERROR_SQL} AS error FROM p)
SELECT file_id, CAST(10 AS DOUBLE) AS ratio, 72 * s AS trailing_bytes, 9 * s AS times, 1024 * s + 9 * s AS ticks, 24 * s * 44100 // (s * 1000) AS bitrate FROM e WHERE error IS NULL
""")
def observed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rewrite leaves: ten times the samples in a second sound track, a pattern behind all boxes, and a bitrate that was set."""
    files = _sounding(spark, sf_dir)
    made = kept(observed.whole(observed.transform(files), files))
    before, after = (analysis.tracks(containers.boxes(f, payloads=True, kinds=analysis.TRACK_TYPES, columns=analysis.TRACK_COLUMNS), timed=False) for f in (files, made))
    ratio = compare.cloned_sound(before, after)
    last = containers.boxes(made, deepest=0, columns=("file_id", "end")).groupBy("file_id").agg(F.max("end").alias("_end"))
    tail = F.expr("substring(content, CAST(_end + 1 AS int), octet_length(content))")
    ends = made.join(last, "file_id").select("file_id", F.octet_length(tail).cast("long").alias("trailing_bytes"), compare.repeated_pattern(tail).alias("times"))
    heads = containers.boxes(made, payloads=True, kinds=("mdhd",), columns=("file_id", "path", "payload"))
    clocks = heads.where("path LIKE 'moov[1]/trak[3]/%/mdhd[0]'").select("file_id", binary.media_duration(F.col("payload")).alias("ticks"))
    rates = trees.parts(made, entries=True).where("type = 'esds' AND path LIKE 'moov[1]/trak[3]/%'").select("file_id", descriptors.maximum_bitrate(F.col("payload")).alias("bitrate"))
    return ratio.join(ends, "file_id").join(clocks, "file_id").join(rates, "file_id")


@query(f"""
WITH {_FACTS_SQL} SELECT file_id, 'Observed transform' AS title, 'native' AS engine, 0 AS args, '{"|".join(steps.OBSERVED)}' AS steps, false AS recommended FROM facts
""")
def observed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the opt-in rewrite for each report; no diagnosis recommends it."""
    rows = _facts(spark, sf_dir).withColumns({"hdr": F.lit(False), "width": F.lit(1080), "height": F.lit(1920), "fps": F.lit(30.0)})
    made = steps.plans(rows).where("mode = 'observed'")
    labels = F.array_join(F.transform("steps", lambda x: x["label"]), "|")
    return made.select("file_id", "title", "engine", F.size("args").alias("args"), labels.alias("steps"), F.lit(False).alias("recommended"))


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity / CAST(8 AS DOUBLE) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE {_fixed_sql("x", 2)} END || ' fps' AS label FROM t
""")
def rate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rates as findings name them."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", formats.fps(F.col("l_quantity") / 8, rounded=False).alias("label"))


@query(f"WITH {_hist_sql('events')}, n AS (SELECT key, count(*) AS runs FROM runs GROUP BY key) SELECT key, max(n.runs) AS runs, count(*) AS gaps, CAST(max(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS dominant_share FROM hist JOIN n USING (key) GROUP BY key")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, different gaps and the share of the most frequent gap of each user."""
    return timing.run_counts(timing.histogram(_event_gaps(spark, sf_dir)))


@query(f"""
WITH p AS ({_PART}) SELECT file_id, 1 AS videos, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS sounds, CASE WHEN k % 7 IN (0, 1) THEN 0 ELSE 1 END AS aac FROM p
""")
def track_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks of each file are picture, sound, and sound in AAC, by their handlers and sample entries."""
    rows = analysis.track_boxes(containers.boxes(_sounding(spark, sf_dir), payloads=True))
    h, d = F.col("hdlr"), F.col("stsd")
    return rows.groupBy("file_id").agg(*[F.count_if(test).alias(name) for name, test in (("videos", decoders.is_video(h)), ("sounds", decoders.is_audio(h)), ("aac", decoders.is_aac(h, d)))])


@query("""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, doc_id % 12 AS pads, strlen(text) AS n FROM documents),
b AS (SELECT *, unnest(range(pads + 2)) AS ordinal FROM d), s AS (SELECT *, CASE WHEN ordinal = 0 THEN 16 WHEN ordinal <= pads THEN 9 ELSE 8 + n END AS size, 16 + 9 * pads + 8 + n AS total FROM b)
SELECT file_id, CAST(ordinal AS INT) AS ordinal, CASE WHEN ordinal = 0 THEN 'ftyp' WHEN ordinal <= pads THEN 'free' ELSE 'mdat' END AS type, size, greatest(CAST(0.4 AS DOUBLE), CAST(size AS DOUBLE) / CAST(total AS DOUBLE) * 100) AS share, ordinal < 8 AS in_legend FROM s
""")
def box_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of top-level boxes, and which a legend names, in containers with a document as media and up to eleven paddings."""
    pads = F.unhex(F.repeat(F.lit("000000096672656500"), (F.col("doc_id") % 12).cast("int")))
    content = F.concat(boxed("ftyp", _text("isom"), zeros(4)), pads, boxed("mdat", _text(F.col("text"))))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), content.alias("content")).withColumn("file_size", F.octet_length("content").cast("long"))
    return analysis.layout(files, containers.boxes(files))
