"""The nearest row in time without a tolerance."""

import random
from datetime import datetime, timedelta

import pytest
from quernel.operators import joins
from quernel.plans import features

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize(("later", "width"), [(False, 86_400.0), (True, 600.0), (False, 60.0)])
def test_nearest_equals_brute_force(spark, later, width):
    rng = random.Random(6)
    times = sorted({rng.choice([rng.randint(0, 3000), rng.randint(90_000, 91_000)]) for _ in range(60)})
    right = [(T0 + timedelta(seconds=t), float(t), 1) for t in times] + [(None, -1.0, 1)]
    left = [(i, T0 + timedelta(seconds=rng.choice([rng.randint(-2000, 95_000), rng.randint(0, 3000)]))) for i in range(150)] + [(999, None)]
    got = joins.nearest(spark.createDataFrame(left, "id long, at timestamp_ntz"), spark.createDataFrame(right, "ts timestamp_ntz, v double, t int"), "at", "ts", ["v"], later, width)
    assert got.columns == ["id", "at", "v", "match_ts", "match_delta_s"]
    found = {r["id"]: r["v"] for r in got.collect()}
    assert len(found) == 151 and found[999] is None
    for i, at in left[:-1]:
        s = (at - T0).total_seconds()
        assert found[i] == min(times, key=lambda t: (abs(t - s), -t if later else t)), (i, s)


def test_grid_without_tolerance(spark):
    points = spark.createDataFrame([(T0, 1.0), (T0 + timedelta(minutes=10), 2.0), (T0 + timedelta(hours=2), 3.0)], "ts timestamp_ntz, v double")
    got = {r["grid_ts"]: r["v"] for r in features.on_grid(points, "ts", "v", 300).collect()}
    assert len(got) == 25 and got[T0 + timedelta(minutes=5)] == 2.0 and got[T0 + timedelta(minutes=60)] == 2.0 and got[T0 + timedelta(minutes=65)] == 3.0
    assert joins.nearest(points.withColumnRenamed("ts", "at").drop("v"), points.where("false"), "at", "ts", ["v"]).where("v is null").count() == 3
