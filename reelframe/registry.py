"""All queries of the library by name, with DuckDB SQL where SQL can express them.

A query applies an operator to the driver's tables; the operators themselves take any frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelframe.functions import binary, decoders, formats
from reelframe.operators import analysis, compare, lookup, rules, running, timing
from reelframe.plans import planner, steps
from reelframe.session import spread, table
from reelframe.sources import containers, rewrites

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- timing of gaps


def _runs_sql(kind: str) -> str:
    return {
        "events": "SELECT user_id AS key, row_number() OVER w AS ord, date_diff('microsecond', lag(ts) OVER w, ts) AS delta, 1 AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
        "lineitem": "SELECT l_suppkey AS key, CAST(l_quantity AS BIGINT) AS ord, CAST(l_quantity AS BIGINT) AS delta, 1 AS n FROM lineitem",
        "conversations": "SELECT conv_id AS key, turn AS ord, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS delta, 1 AS n FROM conversations",
    }[kind]


def _hist_sql(kind: str) -> str:
    return f"runs AS (SELECT * FROM ({_runs_sql(kind)}) WHERE delta IS NOT NULL AND n > 0), hist AS (SELECT key, delta, sum(n) AS c, min(ord) AS first FROM runs GROUP BY key, delta)"


def _timing_sql(kind: str) -> str:
    return f"""
WITH {_hist_sql(kind)},
cum AS (SELECT *, sum(c) OVER (PARTITION BY key) AS n, sum(CASE WHEN delta > 0 THEN c ELSE 0 END) OVER (PARTITION BY key ORDER BY delta) AS cum FROM hist),
top AS (SELECT key, delta AS dominant, c AS dom FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, first) AS r FROM hist) WHERE r = 1),
med AS (SELECT key, min(delta) AS median FROM cum WHERE delta > 0 AND 2 * cum >= n GROUP BY key),
ref AS (SELECT key, dominant, dom, coalesce(median, dominant) AS reference FROM top LEFT JOIN med USING (key)),
agg AS (SELECT key, CAST(sum(c) AS BIGINT) AS n, count(*) AS gaps, any_value(dominant) AS dominant, CAST(any_value(dom) AS BIGINT) AS dom,
  min(CASE WHEN delta > 0 THEN delta END) AS low, max(CASE WHEN delta > 0 THEN delta END) AS high, any_value(reference) AS reference,
  CAST(sum(CASE WHEN delta > 0 AND 100 * abs(delta - reference) <= greatest(reference, 200) THEN c ELSE 0 END) AS BIGINT) AS steady
  FROM hist JOIN ref USING (key) GROUP BY key)
SELECT *, CASE WHEN 1000 * steady >= 995 * n THEN 'cfr' WHEN 1000 * steady >= 950 * n THEN 'near-cfr' ELSE 'vfr' END AS mode FROM agg
"""


def _event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)").alias("at"))
    return timing.gaps(events, "user_id", "at")


@query(_timing_sql("events"))
def timing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.summarize(timing.histogram(_event_gaps(spark, sf_dir)))


@query(_timing_sql("lineitem"))
def timing_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("long")
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), quantity.alias("ord"), quantity.alias("delta"), F.lit(1).cast("long").alias("n"))
    return timing.summarize(timing.histogram(runs))


@query(_timing_sql("conversations"))
def timing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return timing.summarize(timing.histogram(timing.gaps(turns, "conv_id", "turn")))


@query(f"WITH {_hist_sql('events')} SELECT key, delta, CAST(c AS BIGINT) AS c FROM hist")
def delta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.histogram(_event_gaps(spark, sf_dir)).select("key", "delta", "c")


@query(f"WITH {_hist_sql('conversations')} SELECT key, delta AS dominant, CAST(c AS BIGINT) AS dom FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, first) AS r FROM hist) WHERE r = 1")
def dominant_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing_conversations(spark, sf_dir).select("key", "dominant", "dom")


@query(f"WITH {_hist_sql('lineitem')} SELECT key, min(delta) AS reference FROM (SELECT *, sum(c) OVER (PARTITION BY key) AS n, sum(c) OVER (PARTITION BY key ORDER BY delta) AS cum FROM hist) WHERE 2 * cum >= n GROUP BY key")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing_lineitem(spark, sf_dir).select("key", "reference")


@query("""
WITH t AS (SELECT user_id, event_type, ts, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS run FROM t)
SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run
""")
def run_length_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.run_lengths(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "user_id", "ts", "event_type")


# ---------------------------------------------------------------- running values, picks, rates


@query("SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS BIGINT) AS start FROM documents")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.running_sum(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), "start").drop("n_chars")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def primary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.primary(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query("""
SELECT l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, sum(CAST(l_quantity AS BIGINT))::BIGINT AS seconds,
  CASE WHEN sum(CAST(l_quantity AS BIGINT)) > 0 THEN CAST(8 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS bitrate
FROM lineitem GROUP BY l_suppkey
""")
def bitrate_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents, seconds = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    return running.rate(table(spark, sf_dir, "lineitem"), "l_suppkey", cents, seconds).withColumnRenamed("amount", "cents")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 40")
def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.tail(table(spark, sf_dir, "events"), "user_id", "ts", 40).select("user_id", "event_id", "event_type")


@query("SELECT key, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id AS key, event_type, min(ts) AS first FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY ALL) GROUP BY key")
def unknown_types_distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").where(~F.col("event_type").isin("click", "view")).groupBy(F.col("user_id").alias("key"), "event_type").agg(F.min("ts").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return kinds.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("types"))


# ---------------------------------------------------------------- lookups and nearest entries

_LABELS = ", ".join(f"({k}, '{v}')" for k, v in lookup.PRIMARIES.items())
_RUNGS = ", ".join(f"('{n}', {w}, {h}, {k}, '{'square' if w == h else 'portrait' if h > w else 'landscape'}')" for k, (n, w, h) in enumerate(lookup.RUNGS))
_SIZES = "SELECT p_partkey AS file_id, CAST(540 + (p_partkey * 36) % 1512 AS INT) AS width, CAST(540 + (p_partkey * 60) % 1440 AS INT) AS height, CAST(p_size * 2 AS DOUBLE) AS fps, * FROM part"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = (540 + F.col("p_partkey") * 36 % 1512).cast("int"), (540 + F.col("p_partkey") * 60 % 1440).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), width.alias("width"), height.alias("height"), (F.col("p_size") * 2).cast("double").alias("fps"), "*")


@query(f"WITH names(k, v) AS (VALUES {_LABELS}) SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'not tagged' ELSE coalesce(v, 'unknown (' || n_nationkey || ')') END AS label FROM nation LEFT JOIN names ON k = n_nationkey")
def label_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.when(F.col("n_nationkey") != 3, F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", lookup.label(tagged).alias("label"))


@query(f"""
WITH rungs(name, w, h, ord, shape) AS (VALUES {_RUNGS}), s AS ({_SIZES}),
near AS (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY abs(w * h - width * height), ord) AS r FROM s JOIN rungs ON shape = CASE WHEN width = height THEN 'square' WHEN height > width THEN 'portrait' ELSE 'landscape' END)
SELECT s.file_id, CASE WHEN NOT EXISTS (SELECT 1 FROM rungs WHERE w = width AND h = height) THEN name END AS rung,
  EXISTS (SELECT 1 FROM rungs WHERE w = width AND h = height) AS on_target FROM s JOIN near ON near.file_id = s.file_id AND r = 1
""")
def nearest_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("file_id", lookup.nearest_rung(F.col("width"), F.col("height"))["name"].alias("rung"), lookup.on_target(F.col("width"), F.col("height")).alias("on_target"))


@query(f"""
WITH rates(rate) AS (VALUES (24), (25), (30), (50), (60)), s AS ({_SIZES})
SELECT file_id, rate FROM (SELECT file_id, rate, row_number() OVER (PARTITION BY file_id ORDER BY abs(rate - least(fps, 60)), rate) AS r FROM s CROSS JOIN rates) WHERE r = 1
""")
def nearest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("file_id", lookup.nearest_rate(F.col("fps")).alias("rate"))


@query(f"""
WITH s AS ({_SIZES})
SELECT file_id, CAST(floor(CAST(width * height AS DOUBLE) * fps * CAST(0.06 AS DOUBLE) + 0.5) AS BIGINT) AS soft,
  CAST(floor(least(CAST(40000000 AS DOUBLE), greatest(CAST(2000000 AS DOUBLE), CAST(width * height AS DOUBLE) * fps * CAST(0.2 AS DOUBLE))) + 0.5) AS BIGINT) AS target FROM s
""")
def clamp_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, r = F.col("width").cast("double"), F.col("height"), F.col("fps")
    return _sized(spark, sf_dir).select("file_id", lookup.soft_bitrate(w, h, r).alias("soft"), lookup.target_bitrate(w, h, r).alias("target"))


# ---------------------------------------------------------------- rules

#: A report made of a part, in SQL that both engines read.
_REPORT = {
    "file_id": "p_partkey", "fragmented": "p_partkey % 11 = 0", "faststart": "p_partkey % 3 <> 0", "has_video": "p_partkey % 13 <> 0", "has_audio": "p_partkey % 5 <> 0", "sample_entries": "1 + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END",
    "timing_mode": "CASE p_partkey % 4 WHEN 0 THEN 'vfr' WHEN 1 THEN 'near-cfr' ELSE 'cfr' END", "fps": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_size * 2 AS double) END", "edit_list": "p_partkey % 7 = 0", "hdr": "p_partkey % 10 = 1",
    "color_unspecified": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 2 = 0 END", "video_format": "CASE p_partkey % 6 WHEN 0 THEN 'hvc1' WHEN 1 THEN 'vp09' ELSE 'avc1' END", "chroma": "CASE p_partkey % 8 WHEN 0 THEN '4:2:2' WHEN 1 THEN NULL ELSE '4:2:0' END",
    "bit_depth": "CASE WHEN p_partkey % 6 = 0 THEN 10 ELSE 8 END", "width": "CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 1080 ELSE CAST(500 + p_partkey % 900 AS int) END", "height": "CASE WHEN p_partkey % 3 = 0 THEN 1920 ELSE CAST(700 + p_partkey % 800 AS int) END",
    "bitrate": "CAST(p_retailprice * 3000 AS double)", "audio_format": "CASE WHEN p_partkey % 14 = 0 THEN 'ac-3' ELSE 'mp4a' END", "audio_profile": "CASE p_partkey % 12 WHEN 0 THEN 'HE-AAC' WHEN 1 THEN NULL ELSE 'AAC-LC' END",
    "audio_rate": "CASE WHEN p_partkey % 15 = 0 THEN 44100 ELSE 48000 END", "audio_channels": "CASE p_partkey % 16 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END",
}
_REPORT_SQL = f"reports AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _REPORT.items())} FROM part)"
_FOUND_SQL = f"{_REPORT_SQL}, found AS ({' UNION ALL '.join(f"SELECT file_id, {k} AS rule_ord, '{name}' AS id, '{severity}' AS severity, '{fix}' AS fix FROM reports WHERE {cond}" for k, (name, severity, fix, cond) in enumerate(rules.RULES))})"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in _REPORT.items()])


@query(f"WITH {_FOUND_SQL} SELECT * FROM found")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(_reports(spark, sf_dir))


@query(f"""
WITH {_FOUND_SQL}, ranked AS (SELECT *, CASE severity WHEN 'blocker' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank, CASE fix WHEN 'master' THEN 3 WHEN 'retag' THEN 2 WHEN 'remux' THEN 1 ELSE 0 END AS cost FROM found)
SELECT file_id, coalesce(arg_max(fix, cost) FILTER (rank < 2 AND fix <> 'reexport'), 'none') AS recommended, coalesce(bool_and(rank = 2), true) AS clean,
  coalesce(string_agg(id, ',' ORDER BY rank, rule_ord) FILTER (fix = 'reexport'), '') AS reexport, coalesce(string_agg(id, ',' ORDER BY rank, rule_ord), '') AS ids
FROM reports LEFT JOIN ranked USING (file_id) GROUP BY file_id
""")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.diagnosis(_reports(spark, sf_dir))


@query(f"WITH {_FOUND_SQL} SELECT severity, count(*) AS n FROM found GROUP BY severity")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.severity_counts(findings(spark, sf_dir))


# ---------------------------------------------------------------- comparison


@query("""
WITH d AS (SELECT source, n_chars, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents),
s AS (SELECT source, lead(source) OVER (ORDER BY source) AS other FROM (SELECT DISTINCT source FROM documents)),
a AS (SELECT d.source AS pair, d.* FROM d JOIN s USING (source) WHERE other IS NOT NULL), b AS (SELECT s.source AS pair, d.* FROM d JOIN s ON d.source = s.other)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.ord, b.ord) AS ord, a.n_chars AS before_n_chars, a.lang AS before_lang, b.n_chars AS after_n_chars, b.lang AS after_lang,
  a.n_chars IS DISTINCT FROM b.n_chars OR a.lang IS DISTINCT FROM b.lang AS differs FROM a FULL JOIN b ON a.pair = b.pair AND a.ord = b.ord
""")
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source against those of the next one, by position."""
    documents = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang")
    sources = documents.select("source").distinct().withColumn("other", F.lead("source").over(Window.orderBy("source"))).where("other IS NOT NULL")  # a row a source
    rows = running.numbered(documents, "source", "doc_id").withColumn("ord", F.col("ord").cast("int"))
    before = rows.join(sources, "source").withColumn("pair", F.col("source"))
    after = rows.join(sources.select(F.col("source").alias("pair"), F.col("other").alias("source")), "source")
    return compare.positional_diff(before, after, ["pair", "ord"], ["n_chars", "lang"])


@query("""
WITH c AS (SELECT c_nationkey AS nation, count(*) AS n, min(c_custkey) AS least FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS n, min(s_suppkey) AS least FROM supplier GROUP BY 1),
p AS (SELECT c.nation, c.n AS cn, s.n AS sn, c.least AS cl, s.least AS sl FROM c JOIN s USING (nation))
SELECT nation, field, before, after, before IS NOT DISTINCT FROM after AS same FROM (
  SELECT nation, 'count' AS field, CAST(cn AS VARCHAR) AS before, CAST(sn AS VARCHAR) AS after FROM p UNION ALL SELECT nation, 'least', CAST(cl AS VARCHAR), CAST(sl AS VARCHAR) FROM p)
""")
def field_diff_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("cn"), F.min("c_custkey").alias("cl"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("sn"), F.min("s_suppkey").alias("sl"))
    return compare.field_diff(c.join(s, "nation"), "nation", {"count": ("cn", "sn"), "least": ("cl", "sl")})


# ---------------------------------------------------------------- plans


@query("""
WITH t AS (SELECT doc_id, list_filter(['ftyp', CASE WHEN doc_id % 3 = 0 THEN 'uuid' ELSE 'free' END, 'moov', CASE WHEN doc_id % 4 = 0 THEN 'moov' ELSE 'skip' END, CASE WHEN doc_id % 5 = 0 THEN 'wide' ELSE 'mdat' END, CASE WHEN doc_id % 7 = 0 THEN 'mdat' ELSE 'free' END], lambda x: NOT (x = 'ftyp' AND doc_id % 11 = 0)) AS types, doc_id % 13 = 0 AS fragmented FROM documents),
n AS (SELECT *, len(list_filter(types, lambda x: x = 'mdat')) AS m, len(list_filter(types, lambda x: x = 'moov')) AS v, list_contains(types, 'uuid') AS u, list_contains(types, 'ftyp') AS f FROM t)
SELECT doc_id, CASE WHEN fragmented THEN 'the file is fragmented, which needs a real remuxer' WHEN u THEN 'unexpected top-level box(es): uuid' WHEN m = 0 THEN 'no mdat box' WHEN m <> 1 THEN 'media is split across ' || m || ' mdat boxes'
  WHEN v <> 1 THEN 'expected exactly one moov box' WHEN NOT f THEN 'no ftyp box to identify the container' ELSE '' END AS reason FROM n
""")
def support_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    types = F.array_compact(F.array(
        F.when(d % 11 != 0, "ftyp"), F.when(d % 3 == 0, "uuid").otherwise("free"), F.lit("moov"), F.when(d % 4 == 0, "moov").otherwise("skip"),
        F.when(d % 5 == 0, "wide").otherwise("mdat"), F.when(d % 7 == 0, "mdat").otherwise("free"),
    ))
    return table(spark, sf_dir, "documents").select("doc_id", planner.rewrite_reason(types, d % 13 == 0).alias("reason"))


_ESTIMATE_SQL = """
s AS (SELECT doc_id AS file_id, n_chars * 20000 AS file_size, CAST(doc_id % 60 AS DOUBLE) AS duration, CAST(720 AS INT) AS width, CAST(640 + doc_id % 1280 AS INT) AS height, CAST(24 + doc_id % 50 AS DOUBLE) AS fps, doc_id % 2 = 0 AS native FROM documents),
m AS (SELECT *, unnest(['remux', 'retag', 'master', 'observed']) AS mode, file_size / CAST(1000000 AS DOUBLE) AS mb, (CASE WHEN duration = 0 THEN CAST(1 AS DOUBLE) ELSE duration END) * least(fps, CAST(60 AS DOUBLE)) AS frames FROM s),
e AS (SELECT file_id, mode, CASE WHEN mode = 'observed' THEN 'observed' WHEN mode <> 'master' AND native THEN 'native' ELSE 'ffmpeg' END AS engine,
  CASE WHEN mode = 'observed' THEN greatest(CAST(0.3 AS DOUBLE), mb * CAST(0.008 AS DOUBLE)) WHEN mode = 'master' THEN greatest(CAST(5 AS DOUBLE), floor(CAST(width AS DOUBLE) * height * frames / CAST(2000000 AS DOUBLE) + 0.5))
  WHEN native THEN greatest(CAST(0.2 AS DOUBLE), mb * CAST(0.002 AS DOUBLE)) ELSE greatest(CAST(2 AS DOUBLE), floor(mb * CAST(0.08 AS DOUBLE) + 0.5)) END AS seconds FROM m)
"""


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        d.alias("file_id"), (F.col("n_chars") * 20000).alias("file_size"), (d % 60).cast("double").alias("duration"), F.lit(720).alias("width"), (640 + d % 1280).cast("int").alias("height"), (24 + d % 50).cast("double").alias("fps"), (d % 2 == 0).alias("native")
    )
    return planner.estimates(rows)


@query(f"WITH {_ESTIMATE_SQL} SELECT * FROM e")
def mode_plan_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimated(spark, sf_dir)


@query(f"""
WITH rungs(name, w, h, ord, shape) AS (VALUES {_RUNGS}), rates(rate) AS (VALUES (24), (25), (30), (50), (60)), s AS ({_SIZES}),
near AS (SELECT file_id, w, h, row_number() OVER (PARTITION BY file_id ORDER BY abs(w * h - width * height), ord) AS r FROM s JOIN rungs ON shape = CASE WHEN width = height THEN 'square' WHEN height > width THEN 'portrait' ELSE 'landscape' END),
rated AS (SELECT file_id, rate, row_number() OVER (PARTITION BY file_id ORDER BY abs(rate - least(fps, 60)), rate) AS q FROM s CROSS JOIN rates),
t AS (SELECT s.file_id, CASE WHEN w * h < width * height THEN w ELSE width END AS tw, CASE WHEN w * h < width * height THEN h ELSE height END AS th, rate, width, height, fps FROM s JOIN near ON near.file_id = s.file_id AND r = 1 JOIN rated ON rated.file_id = s.file_id AND q = 1)
SELECT file_id, tw AS width, th AS height, rate AS fps, CAST(floor(least(CAST(40000000 AS DOUBLE), greatest(CAST(2000000 AS DOUBLE), CAST(tw AS DOUBLE) * th * rate * CAST(0.2 AS DOUBLE))) + 0.5) AS BIGINT) AS bitrate,
  tw <> width OR th <> height AS scaled, abs(rate - fps) > 0.01 AS rate_changed FROM t
""")
def master_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("file_id", planner.master_plan(F.col("width"), F.col("height"), F.col("fps")).alias("p")).select("file_id", "p.*")


# ---------------------------------------------------------------- formats


@query(f"""
WITH {_ESTIMATE_SQL} SELECT file_id, mode, CASE WHEN seconds < 0.5 THEN 'instant' WHEN seconds < 2 THEN 'under a second' WHEN seconds < 10 THEN 'a few seconds' WHEN seconds < 60 THEN 'around ' || CAST(floor(seconds / 5 + 0.5) * 5 AS BIGINT) || ' seconds'
  WHEN seconds / 60 < 10 THEN 'around ' || CAST(floor(seconds / 60 + 0.5) AS BIGINT) || CASE WHEN floor(seconds / 60 + 0.5) = 1 THEN ' minute' ELSE ' minutes' END ELSE CAST(floor(seconds / 60 / 5 + 0.5) * 5 AS BIGINT) || '+ minutes' END AS phrase FROM e
""")
def format_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimated(spark, sf_dir).select("file_id", "mode", formats.estimate(F.col("seconds")).alias("phrase"))


@query("""
WITH t AS (SELECT doc_id, CAST(floor(CAST(n_chars AS DOUBLE) / 2 + 0.5) AS BIGINT) AS s FROM documents)
SELECT doc_id, CASE WHEN s <= 0 THEN '—' WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s % 3600 // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS said FROM t
""")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", formats.duration(F.col("n_chars").cast("double") / 2).alias("said"))


@query(r"""
SELECT page_id, substr(regexp_replace(CASE WHEN regexp_replace(url, '\.[^./\\]+$', '') = '' THEN 'video' ELSE regexp_replace(url, '\.[^./\\]+$', '') END, '[\\/:*?"<>|]+', '_', 'g'), 1, 80) || '_clean.mp4' AS name FROM pages
""")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", formats.output_name(F.col("url"), "clean").alias("name"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN 'B' WHEN n_chars < 1048576 THEN 'KB' ELSE 'MB' END AS unit, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS DOUBLE) WHEN n_chars < 1048576 THEN n_chars / CAST(1024 AS DOUBLE) ELSE n_chars / CAST(1048576 AS DOUBLE) END AS scaled FROM documents")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", formats.size_band(F.col("n_chars")).alias("b")).select("doc_id", "b.unit", "b.scaled")


# ---------------------------------------------------------------- binary tables


@query("SELECT l_suppkey, count(*) AS samples, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ticks FROM lineitem GROUP BY l_suppkey")
def stts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps to a time-to-sample payload and back."""
    hist = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("long").alias("delta")).agg(F.count(F.lit(1)).alias("count"))
    coded = hist.groupBy("l_suppkey").agg(binary.write_stts(F.array_sort(F.collect_list(F.struct("count", "delta")))).alias("data"))
    runs = coded.select("l_suppkey", F.inline(binary.read_stts(F.col("data"))))
    return runs.groupBy("l_suppkey").agg(F.sum("count").alias("samples"), F.sum(F.col("count") * F.col("delta")).alias("ticks"))


def _conversation_arrays(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", value.cast("long").alias("v")))).alias("a"))
    return rows.select("conv_id", F.transform("a", lambda x: x["v"]).alias("v"))


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY conv_id")
def stsz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversation_arrays(spark, sf_dir, F.length("text"))
    return rows.select("conv_id", binary.read_stsz(binary.write_stsz(F.col("v"))).alias("r")).select("conv_id", F.col("r.count").alias("n"), "r.total")


@query("""
SELECT conv_id, CASE WHEN max(v) >= 4294967296 THEN 'co64' ELSE 'stco' END AS kind, CAST(sum(v) AS BIGINT) AS total, count(*) AS n
FROM (SELECT conv_id, (turn + 1) * 40000000 * (conv_id % 40) AS v FROM conversations) GROUP BY conv_id
""")
def stco_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversation_arrays(spark, sf_dir, (F.col("turn") + 1) * 40_000_000 * (F.col("conv_id") % 40))
    coded = rows.select("conv_id", binary.write_offsets(F.col("v")).alias("w"))
    back = coded.select("conv_id", F.col("w.kind").alias("kind"), binary.read_offsets(F.col("w.data"), F.col("w.kind")).alias("v"))
    return back.select("conv_id", "kind", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("v").cast("long").alias("n"))


@query("SELECT doc_id, CAST(list_sum(list_transform(string_split(md5(CAST(doc_id AS VARCHAR)), ''), lambda c: instr('0123456789abcdef', c) - 1)) AS BIGINT) AS total FROM documents")
def stz2_nibbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(binary.nibbles(data), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, strlen(text) AS n FROM documents)
SELECT file_id, unnest([0, 1, 2, 3, 4]) AS node_id, unnest(['ftyp[0]', 'moov[1]', 'moov[1]/udta[0]', 'mdat[2]', 'free[3]']) AS path, CAST(unnest([0, 16, 24, 36, 44 + n]) AS BIGINT) AS start, CAST(unnest([16, 20, 12, 8 + n, 8]) AS BIGINT) AS size FROM d
""")
def box_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers made of the documents, and all their boxes."""

    box = binary.boxed
    empty, text = F.unhex(F.lit("")), F.col("text").cast("binary")
    content = F.concat(box("ftyp", F.lit("isom0000").cast("binary")), box("moov", box("udta", F.unhex(F.lit("00000000")))), box("mdat", text), box("free", empty))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), content.alias("content"))
    return containers.boxes(files).select("file_id", "node_id", "path", "start", "size")


def _fixed_sql(x: str, digits: int) -> str:
    halves = f"(CAST({x} AS DOUBLE) * {2 ** (digits + 1)})"
    return f"printf('%.{digits}f', CASE WHEN {halves} = floor({halves}) AND CAST(floor({halves}) AS BIGINT) % 2 = 1 THEN {x} + CAST({2.0 ** -(digits + 9)!r} AS DOUBLE) ELSE CAST({x} AS DOUBLE) END)"


@query(f"""
WITH t AS (SELECT doc_id, n_chars * 1237 AS v FROM documents), s AS (SELECT *, v / CAST(1024 AS DOUBLE) AS k, v / CAST(1024 AS DOUBLE) / CAST(1024 AS DOUBLE) AS m, v / CAST(1000000 AS DOUBLE) AS mb FROM t)
SELECT doc_id, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN CASE WHEN k < 10 THEN {_fixed_sql("k", 1)} ELSE {_fixed_sql("k", 0)} END || ' KB' ELSE CASE WHEN m < 10 THEN {_fixed_sql("m", 1)} ELSE {_fixed_sql("m", 0)} END || ' MB' END AS size,
  CASE WHEN v < 1000000 THEN CAST(floor(v / CAST(1000 AS DOUBLE) + 0.5) AS BIGINT) || ' kbps' WHEN v < 10000000 THEN {_fixed_sql("mb", 2)} || ' Mbps' ELSE {_fixed_sql("mb", 1)} || ' Mbps' END AS bitrate, {_fixed_sql("mb", 1)} || ' Mbps' AS megabits FROM s
""")
def format_size_and_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("n_chars") * 1237
    return table(spark, sf_dir, "documents").select("doc_id", formats.size(value).alias("size"), formats.bitrate(value).alias("bitrate"), formats.megabits(value).alias("megabits"))


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity / CAST(8 AS DOUBLE) AS r, floor(l_quantity / CAST(8 AS DOUBLE) * 100 + 0.5) / CAST(100 AS DOUBLE) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE {_fixed_sql("x", 2)} END || ' fps' AS fps, CAST(floor(r * 100 + 0.5) AS BIGINT) || '%' AS share, l_partkey || ' x ' || l_suppkey AS dims FROM t
""")
def format_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("l_quantity") / 8
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", formats.fps(rate).alias("fps"), formats.percent(rate).alias("share"), formats.dimensions(F.col("l_partkey"), F.col("l_suppkey")).alias("dims")
    )


@query(f"""
WITH t AS (SELECT doc_id, 1000 + doc_id % 500 AS a, 700 + doc_id % 900 AS b FROM documents), s AS (SELECT *, abs(b - a) AS d, abs((b - a) / CAST(a AS DOUBLE)) * 100 AS p, CASE WHEN b > a THEN '+' ELSE '-' END AS sign FROM t)
SELECT doc_id, CASE WHEN a = b THEN 'unchanged' ELSE sign || d || ' B (' || sign || {_fixed_sql("p", 1)} || '%)' END AS text, CASE WHEN b > a THEN 'warn' ELSE 'good' END AS tone FROM s
""")
def format_size_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", formats.size_delta(1000 + d % 500, 700 + d % 900).alias("r")).select("doc_id", "r.*")


@query(f"""
WITH {_FOUND_SQL}, n AS (SELECT file_id, count(id) FILTER (severity = 'blocker') AS b, count(id) FILTER (severity = 'warning') AS w, count(id) FILTER (severity = 'note') AS o FROM reports LEFT JOIN found USING (file_id) GROUP BY file_id)
SELECT file_id, coalesce(nullif(concat_ws(', ', CASE WHEN b > 0 THEN b || ' blocker(s)' END, CASE WHEN w > 0 THEN w || ' worth fixing' END, CASE WHEN o > 0 THEN o || ' note(s)' END), ''), 'nothing to fix') AS said FROM n
""")
def describe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(spark, sf_dir)
    n = findings(spark, sf_dir).groupBy("file_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES])
    counts = [F.coalesce(s, F.lit(0)) for s in rules.SEVERITIES]
    return reports.select("file_id").join(n, "file_id", "left").select("file_id", formats.severity_text(*counts).alias("said"))


_ARGS_TAIL = "-c:v libx264 -profile:v high -preset veryfast -crf 18"


@query(f"""
WITH p AS ({ORACLE_SQL["master_plan"]}), t AS (SELECT *, file_id % 10 = 1 AS hdr, file_id % 5 <> 0 AS audio FROM p)
SELECT file_id, '-i {{input}} -map 0:v:0' || CASE WHEN audio THEN ' -map 0:a:0' ELSE '' END || ' -c copy -color_primaries bt709 -color_trc bt709 -colorspace bt709 -movflags +faststart' AS retag,
  '-i {{input}} -map 0:v:0' || CASE WHEN audio THEN ' -map 0:a:0' ELSE '' END || ' -vf ' || CASE WHEN scaled THEN 'scale=' || width || ':' || height || ':flags=lanczos' ELSE 'scale=trunc(iw/2)*2:trunc(ih/2)*2' END
  || CASE WHEN hdr THEN '' ELSE ',setparams=color_primaries=bt709:color_trc=bt709:colorspace=bt709' END || ',format=yuv420p -fps_mode cfr -r ' || fps || ' {_ARGS_TAIL} -maxrate ' || bitrate || ' -bufsize ' || (bitrate * 2)
  || ' -pix_fmt yuv420p -x264-params keyint=' || (fps * 2) || ':min-keyint=' || fps || ':scenecut=40' || CASE WHEN audio THEN ' -c:a aac -b:a ' || {planner.AUDIO_BITRATE} || ' -ar 48000 -ac 2' ELSE '' END || ' -movflags +faststart' AS master FROM t
""")
def plan_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sized(spark, sf_dir).select("file_id", planner.master_plan(F.col("width"), F.col("height"), F.col("fps")).alias("p"))
    hdr, audio = F.col("file_id") % 10 == 1, F.col("file_id") % 5 != 0
    return rows.select("file_id", F.array_join(planner.copy_arguments(audio, True), " ").alias("retag"), F.array_join(planner.master_arguments(F.col("p"), hdr, audio), " ").alias("master"))


# ---------------------------------------------------------------- containers


def _made_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for each part: ftyp, padding, media, then an index with one video whose size, clock and chunks follow from the part."""

    box, u, zeros = binary.boxed, binary.number, binary.zeros
    k = F.col("p_partkey")
    width, height, seconds = 540 + k * 36 % 1512, 540 + k * 60 % 1440, F.col("p_size")
    matrix = [F.when(k % 4 == 0, v).otherwise(w) for v, w in zip((0, 4294901760, 0, 65536, 0), (65536, 0, 0, 0, 65536), strict=True)]
    tkhd = box("tkhd", zeros(12), u(k), zeros(24), *[u(v) for v in matrix], zeros(16), u(width * 65536), u(height * 65536))
    mdhd = box("mdhd", zeros(12), u(15360), u(seconds * 15360), u(5575, 2), zeros(2))
    hdlr = box("hdlr", zeros(8), F.lit("vide").cast("binary"), zeros(13))
    colr = F.when(k % 3 == 0, box("colr", F.lit("nclx").cast("binary"), u(1, 2), u(k % 20, 2), u(1, 2), zeros(1))).otherwise(F.unhex(F.lit("")))
    entry = box("avc1", zeros(6), u(1, 2), zeros(16), u(width, 2), u(height, 2), zeros(50), colr)
    tables = [box("stsd", zeros(4), u(1), entry), box("stts", zeros(4), u(1), u(seconds * 30), u(512)), box("stsz", zeros(4), u(1000), u(seconds * 30)), box("stco", zeros(4), u(2), u(40), u(44))]
    trak = box("trak", tkhd, box("mdia", mdhd, hdlr, box("minf", box("stbl", *tables))))
    ftyp, media = box("ftyp", F.lit("isom").cast("binary"), u(512), F.lit("isom").cast("binary")), box("mdat", F.lit("AAAABBBB").cast("binary"))
    moov = box("moov", box("mvhd", zeros(12), u(1000), u(seconds * 1000), zeros(80)), trak)
    content = F.concat(ftyp, F.when(k % 2 == 0, F.concat(box("free", zeros(4)), media, moov)).otherwise(F.concat(box("free", zeros(4)), media, moov, box("skip"))))
    return table(spark, sf_dir, "part").select(k.cast("string").alias("file_id"), content.alias("content")).withColumn("file_size", F.octet_length("content").cast("long"))


_TRANSFER_SQL = ", ".join(f"({k}, '{v}')" for k, v in decoders.TRANSFERS.items())


@query(f"""
WITH names(v, name) AS (VALUES {_TRANSFER_SQL}), s AS (SELECT p_partkey AS k, 540 + p_partkey * 36 % 1512 AS w, 540 + p_partkey * 60 % 1440 AS h, p_size FROM part)
SELECT CAST(k AS VARCHAR) AS file_id, k AS track_id, 'H.264 / AVC' AS codec, CAST(p_size AS DOUBLE) AS seconds, p_size * 30 AS samples, p_size * 30000 AS bytes, CAST(240000 AS DOUBLE) AS bitrate,
  CASE WHEN k % 4 = 0 THEN 90 ELSE 0 END AS rotation, CASE WHEN k % 4 = 0 THEN h ELSE w END AS width, CASE WHEN k % 4 = 0 THEN w ELSE h END AS height, 'cfr' AS timing_mode, CAST(30 AS DOUBLE) AS fps,
  CASE WHEN k % 3 <> 0 THEN 'not tagged' ELSE coalesce(name, 'unknown (' || (k % 20) || ')') END AS transfer FROM s LEFT JOIN names ON v = k % 20
""")
def container_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks decoded from the containers."""
    found = analysis.tracks(containers.boxes(_made_containers(spark, sf_dir), payloads=True))
    return found.select("file_id", "track_id", "codec", "seconds", "samples", "bytes", "bitrate", "rotation", "width", "height", "timing_mode", "fps", F.col("color.transfer_label").alias("transfer"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS file_id, 2 AS offsets_moved, true AS faststart, 'ftyp,moov,mdat' AS types, 'BT.709' AS transfer FROM part
""")
def container_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers rewritten with their index first and colours tagged, decoded again."""
    made = rewrites.rewrite(_made_containers(spark, sf_dir), retag=True)
    boxes = containers.boxes(made, payloads=True)
    found = analysis.tracks(boxes)
    said = analysis.reports(made.withColumn("file_size", F.octet_length("content")), boxes, found)
    tags = found.select("file_id", F.col("color.transfer_label").alias("transfer"))
    return made.select("file_id", "offsets_moved").join(said.select("file_id", "faststart", F.array_join("types", ",").alias("types")), "file_id").join(tags, "file_id")


# ---------------------------------------------------------------- plans in steps, comparisons of bytes


@query(f"""
WITH d AS ({ORACLE_SQL["diagnosis"]}) SELECT file_id, CASE WHEN recommended = 'none' THEN 'remux' ELSE recommended END AS mode FROM d
""")
def default_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis(spark, sf_dir).select("file_id", steps.default_mode(F.col("recommended")).alias("mode"))


@query("""
WITH m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Failed to IMPORT ' WHEN 1 THEN 'Network down: import ' WHEN 2 THEN 'bad magic number ' WHEN 3 THEN 'needs SharedArrayBuffer ' WHEN 4 THEN 'load failed: wasm ' ELSE 'stopped ' END || doc_id AS said FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(said, '(?i)import') AND regexp_matches(said, '(?i)fail') THEN 'build' WHEN regexp_matches(said, '(?i)fetch|network|load failed') THEN 'download' WHEN regexp_matches(said, '(?i)webassembly|wasm|magic|compileerror') THEN 'module'
  WHEN regexp_matches(said, '(?i)sharedarraybuffer|crossoriginisolated') THEN 'threads' ELSE 'other' END AS failure FROM m
""")
def load_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = ("Failed to IMPORT ", "Network down: import ", "bad magic number ", "needs SharedArrayBuffer ", "load failed: wasm ", "stopped ")
    said = F.concat(F.element_at(F.array(*[F.lit(s) for s in starts]), (F.col("doc_id") % 6 + 1).cast("int")), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", steps.load_failure(said).alias("failure"))


@query("""
SELECT doc_id, doc_id % 5 <> 0 AS same_length, doc_id % 7 = 0 AND doc_id % 5 <> 0 AS identical, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 32 ELSE -1 END AS first_difference FROM documents
""")
def byte_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests against copies in which one byte is another, or that are longer."""
    d, digest = F.col("doc_id"), F.md5(F.col("doc_id").cast("string").cast("binary"))
    changed = F.when(d % 7 == 0, digest).otherwise(F.overlay(digest, F.lit("!"), (d % 32 + 1).cast("int"), F.lit(1)))
    after = F.concat(changed, F.when(d % 5 == 0, "longer").otherwise(""))
    pairs = table(spark, sf_dir, "documents").select("doc_id", digest.cast("binary").alias("before"), after.cast("binary").alias("after"))
    return compare.byte_comparison(pairs, "doc_id").fillna(-1, ["first_difference"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 40 ELSE 0 END AS times FROM documents")
def repeated_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    tail = F.concat(F.repeat(F.lit("00000004"), (d % 40 * 2).cast("int")), F.when(d % 3 == 0, F.lit("000000")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(compare.repeated_pattern(F.unhex(tail)), F.lit(0)).alias("times"))


@query(f"""
WITH rungs(name, w, h, ord, shape) AS (VALUES {_RUNGS}), s AS ({_SIZES}),
near AS (SELECT file_id, name, w, h, row_number() OVER (PARTITION BY file_id ORDER BY abs(w * h - width * height), ord) AS r FROM s JOIN rungs ON shape = CASE WHEN width = height THEN 'square' WHEN height > width THEN 'portrait' ELSE 'landscape' END
  WHERE NOT EXISTS (SELECT 1 FROM rungs x WHERE x.w = width AND x.h = height)),
counted AS (SELECT name, w, h, count(*) AS files FROM near WHERE r = 1 GROUP BY ALL)
SELECT name, files, CAST(rate AS INT) AS rate, CAST(floor(least(CAST(40000000 AS DOUBLE), greatest(CAST(2000000 AS DOUBLE), CAST(w AS DOUBLE) * h * rate * CAST(0.2 AS DOUBLE))) + 0.5) AS BIGINT) AS bitrate FROM counted CROSS JOIN (VALUES (30), (60)) AS r(rate)
""")
def guide_bitrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide's table for the sizes that the files need: how many files come to each, and its bitrate at 30 and 60 frames a second."""
    sizes = F.element_at(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for _, w, h in lookup.RUNGS]), F.array_position(F.array(*[F.lit(name) for name, _, _ in lookup.RUNGS]), F.col("name")).cast("int"))
    near = _sized(spark, sf_dir).select(lookup.nearest_rung(F.col("width"), F.col("height"))["name"].alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    rows = near.select("name", "files", sizes.alias("size"), F.explode(F.array(F.lit(30), F.lit(60))).alias("rate"))
    return rows.select("name", "files", "rate", lookup.target_bitrate(F.col("size.w").cast("double"), F.col("size.h"), F.col("rate")).alias("bitrate"))


#: Facts of a report made of a document, in SQL that both engines read.
_FACTS = {
    "file_id": "doc_id", "fragmented": "doc_id % 13 = 0", "has_audio": "doc_id % 5 <> 0", "has_video": "doc_id % 23 <> 0", "trailing_bytes": "CASE WHEN doc_id % 17 = 0 THEN 8 ELSE 0 END", "wide_offsets": "doc_id % 19 = 0", "max_track_id": "CASE WHEN doc_id % 29 = 0 THEN 4294967294 ELSE 2 END",
    "audio_tracks": "CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END", "audio_format": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'ac-3' ELSE 'mp4a' END", "audio_codec": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'Dolby Digital' ELSE 'AAC' END",
    "audio_entries": "CASE WHEN doc_id % 31 = 0 THEN 2 ELSE 1 END", "audio_offsets": "CASE WHEN doc_id % 37 = 0 THEN 'none' ELSE 'stco' END", "audio_samples": "CAST(doc_id % 41 AS bigint) * 20000", "audio_chunks": "CAST(doc_id % 3 AS bigint)",
}
_FACTS_SQL = f"facts AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _FACTS.items())} FROM documents)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, split = (F.array(*[F.lit(t) for t in kinds]) for kinds in (("ftyp", "moov", "mdat"), ("ftyp", "free", "mdat", "mdat", "moov")))
    return table(spark, sf_dir, "documents").selectExpr(*[f"{v} AS {k}" for k, v in _FACTS.items()]).withColumn("types", F.when(F.col("file_id") % 4 == 0, split).otherwise(whole))


@query(f"""
WITH {_FACTS_SQL}, r AS (SELECT file_id, CASE WHEN fragmented THEN 'the file is fragmented' WHEN file_id % 4 = 0 THEN 'the file needs exactly one mdat box; found 2' WHEN trailing_bytes > 0 THEN 'the source already contains bytes outside its declared top-level boxes'
  WHEN NOT has_video THEN 'there is no video track' WHEN wide_offsets THEN 'every chunk-offset table must use the observed 32-bit stco form' WHEN max_track_id > 2 THEN 'there is no room for both a cloned track_ID and the next_track_ID counter'
  WHEN audio_tracks = 0 THEN 'there is no AAC audio track to clone' WHEN audio_tracks > 1 THEN 'the transform requires exactly one AAC audio track; found 2' WHEN audio_format <> 'mp4a' THEN 'the audio is ' || audio_codec || ', not AAC, so the exact replication does not apply'
  WHEN audio_entries > 1 THEN 'the AAC track must contain exactly one sample description' WHEN audio_offsets <> 'stco' THEN 'the AAC track must use a 32-bit stco chunk-offset table' WHEN audio_samples = 0 OR audio_chunks = 0 THEN 'the AAC sample or chunk table is empty'
  WHEN audio_samples * 992 + 36 > 268435456 THEN 'the grown tables would pass the memory limit' ELSE '' END AS reason FROM facts)
SELECT file_id, reason, reason = '' AS supported, reason = 'there is no AAC audio track to clone' OR reason LIKE 'the audio is %' AS needs_aac FROM r
""")
def observed_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).select("file_id", steps.observed_reason().alias("reason"))
    return rows.select("file_id", "reason", (F.col("reason") == "").alias("supported"), steps.needs_aac(F.col("reason")).alias("needs_aac"))


_COPY_STEPS_SQL = "CASE WHEN reason = '' THEN 'Rewrite the index|Tag colour as Rec.709|Reference the payload, do not copy it' ELSE 'Use the transcoding engine|Copy streams|Tag colour as Rec.709|Move index to the front' END || CASE WHEN has_audio THEN '' ELSE '|No audio track' END"


@query(f"""
WITH {_FACTS_SQL}, r AS (SELECT *, CASE WHEN fragmented THEN 'the file is fragmented, which needs a real remuxer' WHEN file_id % 4 = 0 THEN 'media is split across 2 mdat boxes' ELSE '' END AS reason FROM facts)
SELECT file_id, CASE WHEN reason = '' THEN 'native' ELSE 'ffmpeg' END AS engine, {_COPY_STEPS_SQL} AS steps, reason FROM r
""")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine and steps of a rewrite with colour tags."""
    rows = _facts(spark, sf_dir).withColumn("reason", planner.rewrite_reason(F.col("types"), F.col("fragmented")))
    labels = F.transform(steps.copy_steps(F.col("reason"), F.col("has_audio"), True), lambda s: s["label"])
    return rows.select("file_id", F.when(F.col("reason") == "", "native").otherwise("ffmpeg").alias("engine"), F.array_join(labels, "|").alias("steps"), "reason")


# ---------------------------------------------------------------- damaged and unusual containers


def _odd_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part two tracks with offsets into one mdat; between them nothing, a malformed box, many boxes, or an offset of 64 bits or beyond the media."""
    k, _box, u = F.col("p_partkey"), binary.boxed, binary.number

    def trak(table: Column) -> Column:
        return _box("trak", _box("mdia", _box("minf", _box("stbl", table))))

    narrow = _box("stco", u(0), u(1), u(24))
    second = F.when(k % 5 == 3, _box("co64", u(0), u(1), u(28, 8))).when(k % 5 == 4, _box("stco", u(0), u(1), u(32))).otherwise(_box("stco", u(0), u(1), u(28)))
    between = F.when(k % 5 == 1, F.concat(u(4), F.lit("free").cast("binary"))).when(k % 5 == 2, F.unhex(F.repeat(F.lit("0000000866726565"), 5000))).otherwise(F.unhex(F.lit("")))
    content = F.concat(_box("ftyp", F.lit("isom").cast("binary"), u(0)), _box("mdat", F.lit("AAAABBBB").cast("binary")), _box("moov", trak(narrow), between, trak(second)))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(k.cast("string").alias("file_id"), content.alias("content"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS file_id, CASE WHEN p_partkey % 5 = 1 THEN 0 ELSE 2 END AS tracks, CASE p_partkey % 5 WHEN 1 THEN 3 WHEN 2 THEN 5013 ELSE 13 END AS boxes,
  CASE WHEN p_partkey % 5 = 1 THEN 'malformed ''free'' box at offset 92, where 60 byte(s) are left' END AS error FROM part
""")
def container_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of containers of which some have a damaged index."""
    found = containers.boxes(_odd_containers(spark, sf_dir), columns=("file_id", "type", "error", "boxes"), runs=True)
    tracks = F.sum(F.when(F.col("type") == "trak", F.col("boxes")).otherwise(0))
    each = found.groupBy("file_id", "error").agg(tracks.alias("tracks"), F.sum("boxes").alias("boxes"))  # sums alone are hashed; a least text would have all rows sorted
    return each.groupBy("file_id").agg(F.sum("tracks").alias("tracks"), F.sum("boxes").alias("boxes"), F.min("error").alias("error"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS file_id, CASE p_partkey % 5 WHEN 1 THEN 'malformed ''free'' box at offset 60, where 60 byte(s) are left' WHEN 4 THEN 'a chunk offset lies outside the media' END AS error,
  CASE p_partkey % 5 WHEN 1 THEN '' WHEN 4 THEN '' WHEN 2 THEN '40136,40140' ELSE '136,140' END AS offsets FROM part
""")
def container_rewrites_declined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same containers rewritten: why one is declined, or its new offsets."""
    made = rewrites.rewrite(_odd_containers(spark, sf_dir))
    tables = containers.boxes(made, payloads=True, kinds=("stco", "co64"), columns=("file_id", "node_id", "type", "payload"))
    at = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", binary.read_offsets(F.col("payload"), F.col("type")).alias("o")))), lambda x: F.array_join(x["o"].cast("array<string>"), ",")), ",")
    return made.select("file_id", "error").join(tables.groupBy("file_id").agg(at.alias("offsets")), "file_id", "left").withColumn("offsets", F.coalesce("offsets", F.lit("")))


@query("SELECT conv_id, count(*) AS chunks, CAST(sum((turn + 1) * length(text)) AS BIGINT) AS total, true AS exact FROM conversations GROUP BY conv_id")
def stsc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of samples a chunk to a sample-to-chunk payload and back."""
    run = F.struct((F.col("turn") + 1).cast("long").alias("first_chunk"), F.length("text").cast("long").alias("samples_per_chunk"), F.lit(1).cast("long").alias("description"))
    coded = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(binary.write_stsc(F.array_sort(F.collect_list(run))).alias("data"))
    back = coded.select("conv_id", binary.read_stsc(F.col("data")).alias("r"), binary.is_exact_table(F.col("data"), 12).alias("exact"))
    return back.select("conv_id", F.size("r").cast("long").alias("chunks"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["first_chunk"] * x["samples_per_chunk"]).alias("total"), "exact")


@query("SELECT doc_id, doc_id * 3 AS ticks, doc_id + 7 AS track, doc_id + 8 AS next_track, 100 + CASE WHEN doc_id % 2 = 1 THEN 12 ELSE 0 END AS bytes, doc_id % 3 = 0 AS exact FROM documents")
def header_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of headers of both versions written and read again, and whether a table is as long as it says."""
    d, wide = F.col("doc_id"), F.col("doc_id") % 2 == 1
    start = F.unhex(F.when(wide, "01000000").otherwise("00000000"))

    def blank(n: int) -> Column:
        return F.concat(start, F.unhex(F.repeat(F.lit("00"), n)))

    mdhd, tkhd, mvhd = binary.with_media_duration(F.when(wide, blank(32)).otherwise(blank(20)), d * 3), binary.with_track_number(blank(92), d + 7), binary.with_next_track_number(F.when(wide, blank(108)).otherwise(blank(96)), d + 8)
    exact = binary.is_exact_table(F.unhex(F.concat(F.lit("0000000000000001"), F.when(d % 3 == 0, "00000000").otherwise("0000000000"))), 4)
    return table(spark, sf_dir, "documents").select("doc_id", binary.media_duration(mdhd).alias("ticks"), binary.track_number(tkhd).alias("track"), binary.next_track_number(mvhd).alias("next_track"), F.octet_length(mvhd).cast("long").alias("bytes"), exact.alias("exact"))


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 256 BETWEEN 32 AND 126 THEN chr(CAST(doc_id % 256 AS INT)) ELSE '\x' || lower(lpad(to_hex(doc_id % 256), 2, '0')) END || 'too' AS shown, true AS same FROM documents
""")
def box_type_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box types shown, and turned back into bytes."""
    raw = F.concat(binary.encoded(F.col("doc_id") % 256, 1), F.lit("too").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", decoders.fourcc(F.col("raw"), 0).alias("shown"), "raw").select("doc_id", "shown", (binary.unescaped(F.col("shown")) == F.col("raw")).alias("same"))


@query("""
SELECT n AS level, (n // 10) || '.' || (n % 10) AS avc, (n // 30) || '.' || CAST(floor(n % 30 / CAST(3 AS DOUBLE) + 0.5) AS BIGINT) AS hevc FROM (SELECT p_partkey % 256 AS n FROM part)
""")
def codec_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 256
    return table(spark, sf_dir, "part").select(n.alias("level"), formats.avc_level(n).alias("avc"), formats.hevc_level(n).alias("hevc"))


@query(r"""
WITH f AS (SELECT page_id, page_id % 7 AS queue, CASE page_id % 4 WHEN 0 THEN 'clip.MP4' WHEN 1 THEN 'clip.mov.txt' WHEN 2 THEN 'a.m4v' ELSE 'photo.jpg' END AS name, CASE WHEN page_id % 9 = 3 THEN 'video/mp4' END AS kind FROM pages)
SELECT page_id, queue, row_number() OVER (PARTITION BY queue ORDER BY page_id) <= 8 AS taken FROM f WHERE lower(name) LIKE '%.mp4' OR lower(name) LIKE '%.mov' OR lower(name) LIKE '%.m4v' OR kind = 'video/mp4'
""")
def intake_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are accepted by name or type, of which each queue takes eight."""
    p = F.col("page_id")
    name = F.when(p % 4 == 0, "clip.MP4").when(p % 4 == 1, "clip.mov.txt").when(p % 4 == 2, "a.m4v").otherwise("photo.jpg")
    files = table(spark, sf_dir, "pages").select("page_id", (p % 7).alias("queue"), name.alias("name"), F.when(p % 9 == 3, "video/mp4").alias("kind"))
    return containers.intake(files.where(containers.accepted(F.col("name"), F.col("kind"))), "queue", "page_id").select("page_id", "queue", "taken")


@query(f"""
WITH {_FOUND_SQL} SELECT file_id, rule_ord, CASE severity WHEN 'blocker' THEN 'Blocker' WHEN 'warning' THEN 'Worth fixing' ELSE 'For information' END AS severity, CASE fix WHEN 'none' THEN 'No action needed' WHEN 'remux' THEN 'Fixed by remux' WHEN 'retag' THEN 'Fixed by colour tagging' WHEN 'master' THEN 'Needs a re-encode' ELSE 'Re-export from your editor' END AS fix FROM found
""")
def finding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("file_id", "rule_ord", rules.shown(F.col("severity"), rules.SEVERITY_LABELS).alias("severity"), rules.shown(F.col("fix"), rules.FIX_LABELS).alias("fix"))
