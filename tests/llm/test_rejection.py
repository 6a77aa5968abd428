"""Short texts of languages that were not learned are rejected; short texts of learned ones stay."""

import numpy as np
from pyspark.sql import functions as F

from reelframe.llm import char_models

FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Tutti gli esseri umani nascono liberi ed eguali",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
]


def test_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    models = char_models.train(docs, ~held_out)
    assert not models.predict(FOREIGN)["accepted"].any()
    clean = [r["text"] for r in docs.where(held_out & F.col("text").rlike(r"^[\p{L} .,]{400}")).select("text").limit(1000).collect()]
    for size in (60, 200, 400):
        assert len(clean) > 300 and np.mean(models.predict([t[:size] for t in clean])["accepted"]) > 0.99
