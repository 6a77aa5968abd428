"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions only.

Pass 1 gives each text's 64-bit hash a word of the filter and two bits in it.  What is entered in one task is combined
there, so one row for each hash and task is exchanged; a hash that was entered more than once has its bits set in the
filter.  Pass 2 lets a row pass straight through unless both its bits are set in its word.  Only the rows that may be
repeated shuffle, to be compared by SHA-256.  Groups of more than a HOT_GROUPS-th of all rows, of which there are fewer
than HOT_GROUPS, reach their rows by a broadcast, so no task gets a whole large group.

The filter has BITS_PER_ROW bits for each row, at any size, of which only words with a set bit are kept: a row of 16
bytes for each repeated text at most.  It is broadcast.  Where that would be more than max_words words, the filter is
folded: words that are equal in their low bits become one, so more rows shuffle and the result stays the same.

Defined results: a null text counts as empty, empty texts are equal to each other, and no normalisation happens.  A
null id never stays when its group has another id.  Rows that repeat both id and text count in group_size;
mark_duplicates marks all of them kept if their id is the one that stays, drop_duplicates returns one of them.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import HOT_GROUPS, cut, meet, packed, unpacked

OUTPUTS = ["keep_id", "group_size", "kept", "text_sha256"]
MAX_WORDS = 1 << 22
BITS_PER_ROW = 16


def filter_bits(rows: int) -> int:
    """The filter's size: a power of two of at least BITS_PER_ROW bits a row, up to the bits that a hash can choose from."""
    return min(1 << 57, max(1 << 10, 1 << (BITS_PER_ROW * max(1, rows) - 1).bit_length()))


def word_of(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed.bitwiseAND(F.lit(bits - 1).cast("long")), 6)


def bits_of(hashed: Column) -> Column:
    """Two bits of a word, by the lowest and the highest six bits of the hash."""
    one = F.lit(1).cast("long")
    low, high = hashed.bitwiseAND(F.lit(63)), F.shiftrightunsigned(hashed, 58)
    return F.call_function("shiftleft", one, low.cast("int")).bitwiseOR(F.call_function("shiftleft", one, high.cast("int")))


def repeat_filter(hashes: DataFrame, bits: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """Pass 1: (word, mask) of what more than one row of the column _hash has entered, and the bits left after folding."""
    entered = hashes.groupBy(word_of(F.col("_hash"), bits).alias("word"), bits_of(F.col("_hash")).alias("mask")).count().where("count > 1")
    words = cut(entered.groupBy("word").agg(F.bit_or("mask").alias("mask")))
    return folded(words, bits, max_words)


def folded(words: DataFrame, bits: int, max_words: int) -> tuple[DataFrame, int]:
    """The filter in at most max_words words, and its bits."""
    if words.count() > max_words:
        bits = min(bits, max_words * 64)
        words = words.groupBy(word_of(F.shiftleft("word", 6), bits).alias("word")).agg(F.bit_or("mask").alias("mask"))
    return words, bits


def in_filter(rows: DataFrame, hashed: str, words: DataFrame, bits: int) -> DataFrame:
    """rows with _maybe: whether both bits of the column `hashed` are set."""
    side = F.broadcast(words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask")))
    own = bits_of(F.col(hashed))
    met = rows.join(side, F.col("_word") == word_of(F.col(hashed), bits), "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_mask").bitwiseAND(own) == own, F.lit(False))).drop("_word", "_mask")


def with_repeat_flag(rows: DataFrame, count: int, max_words: int = MAX_WORDS) -> DataFrame:
    """rows (with _text, `count` of them) and _maybe: false where no other row can have an equal text."""
    hashed = rows.withColumn("_hash", F.xxhash64("_text"))
    words, bits = repeat_filter(hashed.select("_hash"), filter_bits(count), max_words)
    return in_filter(hashed, "_hash", words, bits).select(*rows.columns, "_maybe")


def _parts(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None, max_words: int, outputs: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = packed(df, text_col, id_col, outputs, carry)
    count = rows.count()
    flagged = with_repeat_flag(rows, count, max_words)
    digest = flagged.select("_id", "_row", "_maybe", F.sha2("_text", 256).alias("_sha"))
    maybe = digest.where("_maybe")
    groups = maybe.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).withColumn("_rows", F.col("_size"))
    passed = digest.where("not _maybe").select("_id", "_row", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    return passed, meet(maybe, groups, "_sha", count, "_rows", HOT_GROUPS).select("_id", "_row", "_sha", "_keep", "_size")


def _result(rows: DataFrame) -> DataFrame:
    return unpacked(rows, keep_id=F.col("_keep"), group_size=F.col("_size"), kept=F.col("_id").eqNullSafe(F.col("_keep")), text_sha256=F.col("_sha"))


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """Every row of df with keep_id, group_size, kept and text_sha256; of equal texts the largest id stays."""
    passed, compared = _parts(df, id_col, text_col, carry, max_words, OUTPUTS)
    return _result(passed.unionByName(compared))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """One row for each distinct text, with the columns of df."""
    passed, compared = _parts(df, id_col, text_col, None, max_words, [])
    stays = compared.where(F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha"])
    return unpacked(passed.unionByName(stays))
