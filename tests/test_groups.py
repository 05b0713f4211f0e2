"""Joins with a table of one row a group, and ranks by ranges."""

from pyspark.sql import functions as F
from quernel.operators import aggregates, series


def test_the_large_table_is_not_sent_through_the_driver(spark):
    rows = spark.range(100_000).select((F.col("id") % 3).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("v"))
    n, m = rows.groupBy("k").count(), rows.groupBy(F.col("k").alias("m")).agg(F.max("v").alias("most"))
    out = series.join_small(rows, n.join(m, n["k"] == m["m"]).drop("m"), ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert out.count() == 500_000


def test_ranks_by_ranges_equal_one_window(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 10 != 0, (F.col("id") * 7919) % 613).cast("double").alias("v"))
    whole = {tuple(r) for r in series.value_ranks(df, "v", ["k"]).collect()}
    monkeypatch.setattr(series, "BLOCK_ROWS", 50)
    out = series.value_ranks(df, "v", ["k"])
    assert {tuple(r) for r in out.collect()} == whole and "filter(" not in out._jdf.queryExecution().analyzed().toString().lower()


def test_bootstrap_is_the_same_by_ranges(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 97).cast("double").alias("x"), ((F.col("id") * 31) % 17).cast("double").alias("y"))
    whole = {tuple(r) for r in aggregates.bootstrap_thresholds(df, "x", "y", 3).collect()}
    monkeypatch.setattr(series, "HELD_ROWS", 50)
    monkeypatch.setattr(series, "BLOCK_ROWS", 50)
    got = {r["round"]: r["threshold"] for r in aggregates.bootstrap_thresholds(df, "x", "y", 3).collect()}
    assert set(got) == {1, 2, 3} and all(abs(got[r] - t) < 1e-9 for r, t in whole)
