"""Columns of the caller that are named like a result column pass through the pipeline's language stage."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_language_stage_keeps_columns_named_like_results(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "*", (F.col("doc_id") * 2).alias("score"), F.lit("mine").alias("lang_pred"), F.lit(-1.0).alias("cross_entropy"), F.lit("no").alias("accepted")
    )
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.schema.simpleString() == docs.schema.simpleString()
    rows = kept.collect()
    assert len(rows) >= 0.99 * docs.count()
    assert all(tuple(r)[-4:] == (r["doc_id"] * 2, "mine", -1.0, "no") for r in rows)
