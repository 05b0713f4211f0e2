"""Ranks and scores from counts of equal rows: each row is computed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quernel.operators import aggregates, metrics, series
from quernel.plans import rules


def counting(spark):
    """A function that gives its argument back and counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, "double"), calls


def test_regime_rows_are_computed_once(spark):
    same, calls = counting(spark)
    rows = spark.range(400).select(F.lit("f").alias("feature"), F.when(F.col("id") % 2 == 0, "low").otherwise("high").alias("regime"), same(F.col("id").cast("double")).alias("dose"), (F.col("id") % 9).cast("double").alias("label"))
    rows = rows.withColumns({k: (F.col("label") > v).cast("int") for k, v in (("y_ok", 3), ("y_low", 5), ("y_high", 6), ("y_out_spec", 4))})
    assert len(rules.regime_summary(rows).collect()) == 2
    assert calls.value <= 800  # 400 rows, twice where the condition isn't pushed into one evaluation


def test_scores_are_computed_once(spark):
    same, calls = counting(spark)
    rows = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("y"), same((F.col("id") % 50 / 50).cast("double")).alias("p"))
    assert metrics.ranking_metrics(rows, "y", "p").first()["n"] == 1000
    assert calls.value <= 2000


@pytest.mark.parametrize("most", [100_000, 5])
def test_weighted_ranks_and_sums(spark, monkeypatch, most):
    monkeypatch.setattr(series, "BLOCK_ROWS", most)
    df = spark.createDataFrame([("x", 1.0, 2), ("x", 1.0, 1), ("x", 3.0, 4), ("y", 5.0, 2), *[("z", float(i), 1) for i in range(40)]], "k string, v double, w long")
    got = {(r["k"], r["v"]): (r["count"], r["before"], r["rank"]) for r in series.value_ranks(df, "v", ["k"], "w").collect()}
    assert got == {("x", 1.0): (3, 0, 2.0), ("x", 3.0): (4, 3, 5.5), ("y", 5.0): (2, 0, 1.5), **{("z", float(i)): (1, i, i + 1.0) for i in range(40)}}
    sums = series.running_sums(df.groupBy("k", "v").agg(F.sum("w").alias("w"), F.count("*").alias("n")), "v", ["w", "n"], ["k"]).where("k = 'x'")
    assert {(r["v"], r["w"], r["before_w"], r["before_n"]) for r in sums.collect()} == {(1.0, 3, 0, 0), (3.0, 4, 3, 2)}


@pytest.mark.parametrize("most", [100_000, 5])
def test_spearman_of_many_equal_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(series, "BLOCK_ROWS", most)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 30, 3000), rng.integers(0, 4, 3000)
    b = np.where(rng.random(3000) < 0.3, a // 8, b)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    df = spark.createDataFrame([(int(x), int(y), 7) for x, y in zip(a, b, strict=True)], "a long, b long, c long")
    got = {r["y"]: r for r in aggregates.correlations(df, [("a", "b"), ("a", "c")], "spearman").collect()}
    assert got["b"]["n"] == 3000 and abs(got["b"]["r"] - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-12
    assert got["c"]["n"] == 3000 and got["c"]["r"] is None


@pytest.mark.parametrize("candidates", [2, 3, 7, 8, 71])
def test_hinge_search_takes_any_number_of_candidates(spark, candidates):
    df = spark.range(600).select((F.col("id") % 300).cast("double").alias("x"), F.greatest(F.lit(0.0), F.col("id") % 300 - 149.5).alias("y"))
    got = aggregates.hinge_search(df, "x", "y", candidates).first()
    assert got["n_before"] + got["n_after"] == 600
    assert got["n_before"] == 2 * (int(got["threshold"]) + 1)  # x up to the threshold
