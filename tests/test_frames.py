"""Statistics of frames in time and neighbours in time, in work that is linear in the rows."""

import random
import re
from datetime import datetime, timedelta
from statistics import fmean, linear_regression, stdev

import pytest
from quernel import queries_plans  # noqa: F401  registers its queries
from quernel.operators import joins, series
from quernel.plans import features
from quernel.queries import QUERIES

T0 = datetime(2026, 1, 1)
STATS = {k: k for k in ("rows", "n", "mean", "std", "min", "max", "slope")}


@pytest.mark.parametrize("left_open", [True, False])
def test_frame_stats_equal_plain_loops(spark, left_open):
    rng = random.Random(3)
    times = [rng.choice([0, 600, 1200, 3600, rng.randint(0, 9000)]) for _ in range(150)]
    points = [(rng.choice("ab"), T0 + timedelta(seconds=t), None if rng.random() < 0.1 else rng.randint(0, 99) / 4) for t in times] + [("a", None, 5.0), ("a", None, None)]
    rows = [(i, k, t) for i, (k, t, _) in enumerate(points)] + [(900, "a", T0 + timedelta(days=9)), (901, "c", T0), (902, None, T0)]
    got = series.frame_stats(spark.createDataFrame(rows, "id long, k string, at timestamp_ntz"), spark.createDataFrame(points, "k string, ts timestamp_ntz, v double"), ["k"], "at", "ts", 600, "v", STATS, left_open)
    assert got.columns == ["id", "k", "at", *STATS]
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, key, at in rows:
        low = None if at is None else at - timedelta(seconds=600)
        near = [(t, v) for k, t, v in points if k == key and ((t is None) if at is None else (t is not None and (low < t if left_open else low <= t) and t <= at))]
        values = [(t, v) for t, v in near if v is not None]
        vs = [v for _, v in values]
        xs = [0 if t is None else (t - T0).total_seconds() / 60 for t, _ in values]
        want = {"rows": len(near), "n": len(vs), "mean": fmean(vs) if vs else None, "std": stdev(vs) if len(vs) > 1 else None, "min": min(vs, default=None), "max": max(vs, default=None), "slope": linear_regression(xs, vs).slope if len(set(xs)) > 1 else None}
        assert {k: found[i][k] for k in STATS} == {k: None if v is None else pytest.approx(v, abs=1e-9) for k, v in want.items()}, (i, key, at)


def test_many_points_in_many_frames(spark):
    """60,000 points and anchors within one frame, 1.8 thousand million pairs."""
    e = spark.range(60_000).selectExpr("id", "timestamp_micros(1767225600000000 + id * 10000) AS ts", "cast(id % 7 AS double) AS v")
    out = joins.windows_at(e.select("id", "ts"), e.select("ts", "v"), [], "ts", "ts", 3600, "v", {"n": "n", "most": "max"})
    assert out.selectExpr("sum(n)", "max(most)").first() == (60_000 * 60_001 // 2, 6.0)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["wn03_range_frame", "wn07_runtime_means", "jn09_windows_at_anchors"])
def test_queries_of_frames_in_time_only_run_on(spark, name):
    """No pairs and no frame that is read anew for each row."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString().lower()
    frames = re.findall(r"specifiedwindowframe\(rangeframe, ([^,]+), ([^)]+)", plan)
    assert frames and all(low == "unboundedpreceding$()" for low, _ in frames) and "unboundedfollowing" not in plan and "join" not in plan


def test_anchors_without_time_meet_nothing(spark):
    anchors = spark.createDataFrame([(1, None), (2, T0)], "id long, anchor timestamp_ntz")
    points = spark.createDataFrame([(None, 1.0), (T0 - timedelta(minutes=5), 2.0)], "ts timestamp_ntz, v double")
    got = {r["id"]: (r["x_mean"], r["x_missing_rate"]) for r in features.anchored_stats(anchors, points, "ts", "v", 2, 10, "x").collect()}
    assert got == {1: (None, 1.0), 2: (2.0, 0.9)}


@pytest.mark.parametrize("how", ["asof", "nearest"])
def test_no_frame_is_read_to_its_end_for_each_row(spark, how):
    left, right = spark.createDataFrame([(1, T0)], "id long, at timestamp_ntz"), spark.createDataFrame([(T0, 1.0)], "ts timestamp_ntz, v double")
    out = joins.asof(left, right, [], "at", "ts", ["v"], 600) if how == "asof" else joins.nearest(left, right, "at", "ts", ["v"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()


def test_interpolation_reads_no_frame_to_its_end_for_each_row(spark):
    out = series.interpolate(spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "i int, v double"), [], ["i"], "v")
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower() and [r["v"] for r in out.orderBy("i").collect()] == [1.0, 2.0, 3.0]
