"""How many sets near_dedup brings to the blocks of large buckets, and that no link is lost by bringing fewer."""

import random

from test_near_dedup import brute_groups

from reelframe.llm import near_dedup


def test_a_passage_of_many_holders_brings_each_set_a_few_times(spark, monkeypatch):
    """Holders of one passage, of many sizes, hardly any alike: the shingles of the passage are one bucket, cut by sizes."""
    rng = random.Random(3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    passage = " ".join(f"p{j}" for j in range(20))
    rows = [(k, f"{passage} " + " ".join(f"d{k}x{j}" for j in range(rng.choice([0, 1, 4, 9, 20, 40, 60])))) for k in range(120)]
    rows += [(200 + k, rows[k][1] + " tail") for k in range(0, 120, 9)]
    brought, placed = [], near_dedup._placed

    def counted(mixed):
        brought.append(placed(mixed).count())
        return placed(mixed)

    monkeypatch.setattr(near_dedup, "_placed", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, pivots=0, small_bucket=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_groups(rows)
    assert 0 < brought[0] < 6 * len(rows)


def test_long_sets_meet_the_members_of_blocks_in_one_row_each(spark, monkeypatch):
    """Holders of one passage, hundreds of shingles each: what is matched with the members of blocks is sets, not shingles."""
    passage = " ".join(f"p{j}" for j in range(280))
    rows = [(k, f"{passage} " + " ".join(f"d{k}x{j}" for j in range(50))) for k in range(30)]
    rows += [(100 + k, rows[k][1] + " tail") for k in range(0, 30, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, join = [], type(docs).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if how == "left_semi":
            made.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "join", counted)
    got = near_dedup.near_duplicates(docs, pivots=0, small_bucket=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_groups(rows)
    assert 0 < sum(made) <= len(rows)
