"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its text.  The ledger, a table in the shared folder, has a
row for each pair of a blob and a version of the rules.  A scan looks up which pairs it lacks, scans their blobs once and
appends their findings; then the findings of the version asked for are joined back to every path (document) that holds
the blob.  Texts that can have no copy (see exact_dedup) are scanned where they are read; only the others shuffle to find
one representative.  Blobs of more than a HOT_GROUPS-th of all rows are dealt out over SALTS keys for the join.

Spans count code points, end exclusive, leftmost and not overlapping within a kind.  Positions come from splitting a
text at the matches: the running sum of the lengths of pieces and matches gives each start.

Defined results: a null text counts as empty and has no findings; a null id keeps its row; repeated rows each get the
findings of their blob; a text of any length is scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import cut, exists, hot_size, new_path, packed, unpacked
from reelframe.llm.exact_dedup import HOT_GROUPS, with_repeat_flag

OUTPUTS = ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
RULES_VERSION = "base-1"
SALTS, BROADCAST_BLOBS = 64, 1_000_000


def either_case(word: str) -> str:
    """A pattern for word with its ASCII letters in either case, the same to every regex engine."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEYWORD = f"({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token')))}|{either_case('api')}_?{either_case('key')})"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short holds no shorter match that is long enough, so the least length can stand in these two.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: kind, pattern, group whose length decides, least length of it; the order breaks ties of the start.
RULES = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]
LEDGER = "blob string, rules_version string, n_assign bigint, n_access bigint, n_hex bigint, spans string"


def _running(lengths: Column) -> Column:
    """The running sums of an array.  Blocks of about the square root of its size keep what is copied within bounds."""
    none = F.array().cast("array<bigint>")

    def summed(values: Column, start: Column) -> Column:
        first = F.struct(start.cast("bigint").alias("at"), none.alias("sums"))
        each = F.aggregate(values, first, lambda s, v: F.struct((s["at"] + v).alias("at"), F.array_append(s["sums"], s["at"] + v).alias("sums")))
        return each["sums"]

    zero, n = F.lit(0).cast("bigint"), F.size(lengths)
    step = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1, step), lambda k: F.slice(lengths, k + 1, step))
    ends = summed(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, v: a + v)), zero)
    starts = F.concat(F.array(zero), F.slice(ends, 1, F.size(ends) - 1))
    return F.when(n > 0, F.flatten(F.zip_with(blocks, starts, summed))).otherwise(none)


def _spans(kind: int, pattern: str, group: int, least: int) -> Column:
    """An array of struct(start, kind, end) of what a rule finds in _text."""
    text, p = F.col("_text"), F.lit(pattern)
    matches = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.length(m).cast("bigint"))
    parts = F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length)
    pieces = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), lambda x: F.length(x).cast("bigint"))
    ends = _running(F.zip_with(pieces, matches, lambda x, m: x + m))
    found = F.zip_with(F.arrays_zip(ends.alias("end"), matches.alias("match")), parts, lambda x, n: F.when(n >= least, F.struct((x["end"] - x["match"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return F.when(text.rlike(pattern), F.array_compact(found)).otherwise(none)


def find_spans(blobs: DataFrame, rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    """(_blob, _text) to (blob, n_assign, n_access, n_hex, spans), a row for each blob; nothing shuffles."""
    kinds = {name: k for k, (name, *_) in enumerate(RULES)}
    found = [_spans(kinds[name], pattern, group, least) for name, pattern, group, least in rules]
    rows = blobs.select(F.col("_blob").alias("blob"), F.array_sort(F.concat(*found)).alias("found"))
    names = F.array(*[F.lit(name) for name in kinds])
    said = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")

    def counted(k: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")

    return rows.select("blob", *[counted(k).alias(f"n_{name}") for name, k in kinds.items()], said.alias("spans"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All entries of a ledger, as LEDGER; a ledger that does not exist has none."""
    return spark.read.schema(LEDGER).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], LEDGER)


def update_ledger(df: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, str, int, int]] = RULES, version: str = RULES_VERSION) -> None:
    """Scans the blobs of df that the ledger does not have under `version` and appends their entries."""
    spark = df.sparkSession
    rows = packed(df, text_col, id_col, OUTPUTS, [])
    flagged = with_repeat_flag(rows.select("_text"), rows.count()).select("_maybe", "_text", F.sha2("_text", 256).alias("_blob"))
    blobs = flagged.where("not _maybe").select("_blob", "_text").unionByName(flagged.where("_maybe").select("_blob", "_text").dropDuplicates(["_blob"]))
    if exists(spark, ledger):  # else nothing is seen yet
        known = read_ledger(spark, ledger).where(F.col("rules_version") == version).select(F.col("blob").alias("_blob"))
        unseen = cut(rows.select(F.sha2("_text", 256).alias("_blob")).distinct().join(known, "_blob", "left_anti"))
        if (n := unseen.count()) <= BROADCAST_BLOBS:  # else the texts shuffle to meet them
            unseen = F.broadcast(unseen)
        if not n:
            return
        blobs = blobs.join(unseen, "_blob", "left_semi")
    find_spans(blobs, rules).select("blob", F.lit(version).alias("rules_version"), "n_assign", "n_access", "n_hex", "spans").write.mode("append").parquet(ledger)


def _findings(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    """The entries with findings, one for each blob even if two runs added it at once."""
    return read_ledger(spark, ledger).where((F.col("rules_version") == version) & (F.col("spans") != "")).drop("rules_version").dropDuplicates(["blob"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, ledger: str | None = None, rules: list[tuple[str, str, int, int]] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """df with the findings of its texts under a version of the rules.

    ledger: the path of a ledger in the shared folder, which is brought up to date first; a new one if not given.
    rules: name (one of those in RULES), pattern, group whose length decides, least length.  carry: columns to return.
    """
    spark = df.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    update_ledger(df, ledger, id_col, text_col, rules, version)
    found = _findings(spark, ledger, version)
    paths = packed(df, text_col, id_col, OUTPUTS, carry).select("_id", "_row", F.sha2("_text", 256).alias("blob"))
    size = paths.count()
    hot = F.broadcast(paths.groupBy("blob").count().where(F.col("count") > F.lit(hot_size(size, HOT_GROUPS) + 1)).select("blob", F.lit(True).alias("_hot")))  # fewer than HOT_GROUPS
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    met = paths.join(hot, "blob", "left").withColumn("_salt", salt).drop("_hot").join(found.join(hot, "blob", "left").withColumn("_salt", salts).drop("_hot"), ["blob", "_salt"], "left")
    spans = F.coalesce(F.col("spans"), F.lit(""))
    counts = {f"n_{name}": F.coalesce(F.col(f"n_{name}"), F.lit(0).cast("long")) for name, *_ in RULES}
    return unpacked(met, blob=F.col("blob"), **counts, base_sha256=F.sha2(spans, 256), spans=spans)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, changed: str = "_changed") -> DataFrame:
    """df with what the rules find masked in text_col, and the column `changed`; texts do not shuffle.

    The ledger tells which blobs have findings.  Up to BROADCAST_BLOBS of them are broadcast, so that all other texts are
    left alone at once; beyond that each text is searched again.
    """
    ledger = ledger or new_path(df.sparkSession, "ledger")
    update_ledger(df, ledger, id_col, text_col)
    held = cut(_findings(df.sparkSession, ledger, RULES_VERSION).select(F.col("blob").alias("_blob")))
    text = F.col(f"`{text_col}`")
    if held.count() > BROADCAST_BLOBS:
        masked = redacted(text)
        return df.withColumn(changed, ~masked.eqNullSafe(text)).withColumn(text_col, masked)
    marked = df.join(F.broadcast(held), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256) == F.col("_blob"), "left").withColumn(changed, F.col("_blob").isNotNull()).drop("_blob")
    return marked.withColumn(text_col, F.when(F.col(changed), redacted(text)).otherwise(text))


def redacted(text: Column, mask: str = "[secret]") -> Column:
    """text with the values that the rules find replaced by mask: the value of an assignment, a whole key or hex run."""
    cuts = F.arrays_zip(
        F.split(text, ASSIGN, -1).alias("piece"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("value")
    )

    def rebuilt(x: Column) -> Column:
        kept = F.substring(x["match"], F.lit(1), F.length(x["match"]) - F.length(x["value"]))
        shown = F.when(F.length(x["value"]) >= RULES[0][3], F.concat(kept, F.lit(mask))).otherwise(x["match"])
        return F.concat(x["piece"], F.coalesce(shown, F.lit("")))

    masked = F.when(text.rlike(ASSIGN), F.array_join(F.transform(cuts, rebuilt), "")).otherwise(text)
    for pattern in (ACCESS, HEX):
        masked = F.regexp_replace(masked, F.lit(pattern), F.lit(mask))
    return masked
