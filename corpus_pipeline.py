"""A training corpus from raw documents: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.  A
column of docs that a stage does not know passes through.

Stages that hand texts to Python set the session's bytes in a batch to BATCH_BYTES, which stays set, as a frame is computed
only after its stage has returned.  With Spark's 64 MB a task's whole partition goes over at once, and is in memory up to
three times on either side.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import char_models, exact_dedup, near_dedup, secret_scan, tier_packing
from reelframe.llm.common import new_path, table


BATCH_BYTES = 4 << 20


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a character model of some language accepts; those with no letters, or unlike any language, go."""
    _bounded(spark)
    models = char_models.train(docs, F.lit(True))
    named = [f"_{k}" for k in range(len(docs.columns))]  # so that no result column replaces one of docs
    at = dict(zip(docs.columns, named, strict=True))
    kept = char_models.identify(docs.toDF(*named), models, at["doc_id"], at["text"]).where("accepted")
    return kept.select(*named).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, Jaccard 0.8), that with the smallest doc_id."""
    _bounded(spark)
    return near_dedup.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; found secrets are masked in the text, and n_chars follows."""
    flag = next(f"_{k}" for k in range(len(docs.columns) + 1) if f"_{k}" not in docs.columns)
    out = secret_scan.redact(docs, changed=flag)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(flag), F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    _bounded(spark)
    return tier_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packing)]
#: Character models and packing have no form in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
