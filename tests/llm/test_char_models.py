"""Character models of many languages."""

from pyspark.sql import functions as F

from reelframe.llm import char_models


def test_more_than_500_languages_are_learned(spark):
    def text(k, j):
        word = "".join(chr(0x4E00 + 8 * k + x) for x in range(8))  # letters of its own
        return " ".join(word[x % 5 :] for x in range(j, j + 6))

    rows = [(10 * k + j, f"lang{k:03}", text(k, j)) for k in range(520) for j in range(9 if k < 510 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    models = char_models.train(docs, F.lit(True))
    assert len(models.models) == 520
    asked = [0, 505, *range(510, 520)]
    assert list(models.predict([text(k, 3) for k in asked])["lang_pred"]) == [f"lang{k:03}" for k in asked]
