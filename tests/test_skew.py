"""Joins and rankings under hot and null keys: the same rows on both sides of every threshold."""

import pytest

from factloom.operators import more, skew
from factloom.session import Scratch


@pytest.mark.parametrize("least", [10, 10**9])
def test_balanced_left_join(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "LEAST_HOT", least)
    rows = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 and i % 2 else f"k{i % 50}") for i in range(900)] + [(9_000, "missing"), (9_001, "\u00001")]
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(40)], "k string, v int")
    want = {r.k: r.v for r in right.collect()}
    got = skew.balanced_left_join(left, right, "k", "id", Scratch(spark, "t"))
    assert sorted(got.columns) == ["id", "k", "v"]
    assert sorted((r.id, r.k or "", r.v or 0) for r in got.collect()) == sorted((i, k or "", want.get(k, 0)) for i, k in rows)


def test_null_keys_are_spread(spark):
    left = spark.range(3_000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'k' || id END AS k")
    keys = left.where("k IS NULL").select(skew.away_from_null("k", "id").alias("x")).groupBy("x").count().collect()
    assert len(keys) > 200 and max(r["count"] for r in keys) <= 4 * 1_000 / len(keys)


def test_evaluation_counts_what_ranks_before(spark):
    ranked = [(1, "a", 3.0), (1, "b", 2.0), (1, "c", 2.0), (1, "d", 1.0), (2, "a", 1.0), (3, "x", 9.0)]
    expected = [(1, "c"), (1, "d"), (2, "z"), (4, "a"), (1, "c")]
    got = more.evaluation(spark.createDataFrame(ranked, "qid int, doc string, score double"), spark.createDataFrame(expected, "qid int, doc string"), 2).first()
    assert (got.n, got.recall, got.mrr) == (3, 0.0, round(1 / 3 / 3, 6))
