"""Scores of a clustering in two passes, against the single measures."""

import random

import pytest
from pyspark.sql import functions as F
from quernel.operators import metrics, ml


def test_scores_of_two_passes_equal_the_single_measures(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i % 3, rng.gauss(i % 3 - 1, 0.5), rng.gauss(0, 1)) for i in range(300)], "c int, x double, y double")
    for rows in (df, df.where("c = 0"), df.where("c = 1").limit(1).union(df.where("c = 0"))):
        got = metrics.cluster_scores(rows, "c", ["x", "y"]).first().asDict()
        want = metrics.silhouette(rows, "c", ["x", "y"]).first().asDict()
        if rows is df:
            want |= metrics.cluster_quality(rows, "c", ["x", "y"]).first().asDict()
        assert {k: got[k] for k in want} == {k: v if v is None else pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_features_of_a_sweep_are_prepared_once(spark, monkeypatch):
    prepared = []
    keep = ml._prepare
    monkeypatch.setattr(ml, "_prepare", lambda features: prepared.append(features) or keep(features))
    df = spark.range(400).select((F.col("id") % 2 * 10 + F.col("id") % 7).cast("double").alias("f1"), (F.col("id") % 5).cast("double").alias("f2"), (F.col("id") % 3 / 10 + 8.4).alias("label"))
    rows = ml.sweep_clusters(df, ["f1", "f2"], "label", ks=(2,), seeds=(0, 1), kinds=("kmeans", "mixture", "bisecting")).collect()
    assert len(prepared) == 1 and [(r["kind"], r["k"]) for r in rows] == [("kmeans", 2), ("mixture", 2), ("bisecting", 2)]
