"""What the pipeline's stages hand to Python at once, and what they bring to blocks, stays small."""

import pyarrow as pa
import pytest

import corpus_pipeline
from reelframe.llm import near_dedup

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["language", "near_dedup", "packing"])
def test_stages_hand_few_bytes_at_once_to_python(spark, name):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])

    docs = spark.createDataFrame([(k, "en", f"the word {k} " * 400) for k in range(3000)], "doc_id long, lang string, text string").coalesce(1)
    before = spark.conf.get(LIMIT)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(5), "")
        seen = [r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect()]
    finally:
        spark.conf.set(LIMIT, before)
    assert sum(seen) > 3 * corpus_pipeline.BATCH_BYTES and max(seen) < 1.1 * corpus_pipeline.BATCH_BYTES


def test_long_sets_bring_numbers_of_shared_shingles(spark, monkeypatch):
    """Holders of one passage, each with many words of its own: of a prefix only what others hold goes to blocks, in ints."""
    brought = []
    shared = near_dedup._held

    def seen(firsts, small_bucket):
        held, entries = shared(firsts, small_bucket)
        brought.append(held)
        return held, entries

    monkeypatch.setattr(near_dedup, "_held", seen)
    passage = " ".join(f"p{j}" for j in range(120))
    rows = [(k, f"{passage} " + " ".join(f"d{k}x{j}" for j in range(200))) for k in range(40)] + [(100, f"{passage} " + " ".join(f"d7x{j}" for j in range(205)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, pivots=0, small_bucket=4).collect()}
    assert got == {k: 7 if k == 100 else k for k, _ in rows}
    held = brought[0]
    assert dict(held.dtypes)["key"] == "int"
    numbers = [r["key"] for r in held.select("key").distinct().collect()]
    assert len(numbers) == held.select("key", "size").distinct().count() and min(numbers) >= 0 and max(numbers) < 100 * len(numbers)


def test_pairs_of_long_sets_that_cannot_be_alike_stay_in_their_block():
    """Two sets of 400 whose prefixes of 101 share 50: with all 299 behind them, 349 of 356 needed."""
    block = [(2, k, k, 400, None, near_dedup.np.arange(50, dtype="int32")) for k in (1, 2)]
    assert near_dedup._block_links(0, block) == ([], [])
    alike = [(2, k, k, 400, None, near_dedup.np.arange(57, dtype="int32")) for k in (1, 2)]
    assert (1, 2) in near_dedup._block_links(0, alike)[1]
