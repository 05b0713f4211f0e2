"""Trailing statistics as a stream and as a batch, from raw points to recommendations."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quernel.plans import rules as R
from quernel.streaming import stateful as S

T0 = datetime(2026, 1, 1)
POINTS = "unit long, tag string, ts timestamp, value double"


def brute(points, grid):
    out, by_key = {}, defaultdict(list)
    for unit, tag, ts, v in points:
        if v is not None and v == v and abs(v) != float("inf") and ts is not None:
            by_key[unit, tag].append((ts, v))
    step = timedelta(minutes=grid.step)
    for key, own in by_key.items():
        at = T0 - timedelta(days=1)
        while at <= max(own)[0] + timedelta(minutes=grid.keep):
            seen = [x for x in own if x[0] <= at]
            if seen and at - max(seen)[0] <= timedelta(minutes=grid.keep):
                inside = [v for t, v in seen if t >= at - timedelta(minutes=grid.window)]
                out[(*key, at)] = (len(inside), round(sum(inside) / len(inside), 6) if inside else None, max(seen)[1], max(seen)[0])
            at += step
    return out


def as_dict(rows):
    return {(r["unit"], r["tag"], r["at"]): (r["n"], None if r["mean"] is None else round(r["mean"], 6), r["last"], r["last_at"]) for r in rows}


def some_points(n=600, seed=1):
    rng = random.Random(seed)
    points = []
    for _ in range(n):
        minutes = rng.choice([rng.uniform(0, 240), rng.uniform(700, 800), rng.randrange(0, 240, 10), rng.randrange(0, 240, 10)])
        points.append((rng.choice([1, 2, None]), rng.choice("ab"), T0 + timedelta(seconds=round(minutes * 60)), rng.choice([rng.random(), rng.random(), 3.0, None, float("nan"), float("inf")])))
    return [*points, (1, "a", None, 1.0), points[0], points[1]]


@pytest.mark.parametrize("grid", [S.Grid(), S.Grid(5, 15, 15), S.Grid(30, 30, 120)])
def test_batch_equals_brute_force(spark, grid):
    points = some_points()
    got = as_dict(S.trailing(spark.createDataFrame(points, POINTS), ["unit", "tag"], "ts", "value", grid).collect())
    assert got == brute(points, grid)


def test_grids_fit_together():
    for bad in ((0, 60, 90), (10, 65, 90), (10, 60, 95), (10, 60, 30)):
        with pytest.raises(ValueError, match="multiples"):
            S.Grid(*bad)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, S.ROCKSDB)
    yield
    spark.conf.unset(key)


def stream_of(spark, batches, folder, build, name):
    """The rows of a stream that gets the batches one after the other."""
    folder.mkdir()
    (folder / "in").mkdir()
    query = build(spark.readStream.schema(POINTS).parquet(str(folder / "in"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "at"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if i == 0:
            running = query.start()
        running.processAllAvailable()
    try:
        return spark.table(name).collect()
    finally:
        running.stop()


def test_stream_equals_batch_under_late_points(spark, rocks, tmp_path):
    """Points come up to 80 minutes late where 90 are waited for; none is lost, and none is given out twice."""
    grid, rng = S.Grid(), random.Random(9)
    points = some_points(500, 7)
    timed = sorted((p for p in points if p[2]), key=lambda p: p[2] + timedelta(minutes=rng.uniform(0, 80)))
    batches = [timed[i : i + 60] for i in range(0, len(timed), 60)] + [[(9, "a", T0 + timedelta(days=3), 1.0)], [(9, "a", T0 + timedelta(days=4), 1.0)]]
    got = stream_of(spark, batches, tmp_path / "a", lambda df: S.trailing(df, ["unit", "tag"], "ts", "value", grid), "trailing_rows")
    assert len(got) == len(as_dict(got))
    own = {k: v for k, v in as_dict(got).items() if k[0] != 9}
    assert own == brute(timed, grid) and len(own) > 100


def test_points_behind_the_watermark_are_dropped(spark, rocks, tmp_path):
    early = [(1, "a", T0 + timedelta(minutes=m), 1.0) for m in range(5, 300, 5)]
    late = [(1, "a", T0 + timedelta(minutes=7), 100.0)]  # the watermark stands at 295 - 90 minutes
    end = [(9, "a", T0 + timedelta(days=3), 1.0)]
    got = stream_of(spark, [early, [(1, "a", T0 + timedelta(minutes=296), 1.0)], late, end, [(9, "a", T0 + timedelta(days=4), 1.0)]], tmp_path / "a", lambda df: S.trailing(df, ["unit", "tag"], "ts", "value"), "dropped_rows")
    want = brute([*early, (1, "a", T0 + timedelta(minutes=296), 1.0)], S.Grid())
    assert {k: v for k, v in as_dict(got).items() if k[0] == 1} == want


def rule_tables(spark):
    rules = [("r1", "b_mean", "low", 0.0, 0.6, "A", "accepted", True, 150, 0.9, 0.05, 0.04, 0.06, -0.1, 0.0), ("r2", "b_mean", "mid", 0.4, 0.5, "B", "accepted", True, 90, 0.8, 0.1, 0.1, 0.04, 0.0, 0.0), ("r3", "a_mean", "high", 0.2, 0.3, "A", "accepted", False, 90, 0.8, 0.1, 0.1, 0.04, 0.0, 0.0),
             ("r4", "a_mean", "low", 0.1, 0.7, "A", "accepted", True, 20, 0.7, 0.1, 0.1, 0.04, 0.0, 0.0), ("r5", "a_mean", "low", 5.0, 6.0, "A", "rejected", True, 900, 1.0, 0.0, 0.0, 0.4, 0.0, 0.0)]
    schema = "rule_id string, feature string, bin string, dose_min double, dose_max double, grade string, status string, time_stable boolean, sample_count int, ok_rate double, high_rate double, low_rate double, ok_lift double, high_delta double, low_delta double"
    accepted = [(*r[:6], R.ACCEPTED if r[6] == "accepted" else r[6], *r[7:]) for r in rules]
    return spark.createDataFrame(accepted, schema), spark.createDataFrame([("a_mean", 0.4, 0.6), ("b_mean", 0.45, 0.55)], "feature string, q33 double, q66 double")


def recommended(spark, points, least=2):
    rules, bounds = rule_tables(spark)
    wide = S.side_by_side(S.trailing(points, ["unit", "tag"], "ts", "value"), ["unit"], "tag", ["a", "b"], least=least)
    return S.with_writeback(R.advise(S.with_ratio(wide, "a_mean", "b_mean", "ratio"), rules, bounds, ["a_mean", "b_mean"], "ratio"), "b_mean", "b_last", "a_last")


def plain(rows):
    return {(r["unit"], r["at"]): tuple(round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items() if k not in ("unit", "at")) for r in rows}


def test_points_to_recommendations_as_a_stream(spark, rocks, tmp_path):
    rng = random.Random(3)
    points = [(u, t, T0 + timedelta(minutes=m, seconds=rng.randrange(60)), rng.random()) for u in (1, 2) for t in "ab" for m in range(0, 200, 7)]
    shuffled = sorted(points, key=lambda p: p[2] + timedelta(minutes=rng.uniform(0, 60)))
    flush = [[(9, "a", T0 + timedelta(days=d), 1.0)] for d in (3, 4, 5)]
    got = stream_of(spark, [shuffled[:50], shuffled[50:], *flush], tmp_path / "a", lambda df: recommended(spark, df), "recommended_rows")
    want = plain(recommended(spark, spark.createDataFrame(points, POINTS)).collect())
    assert {k: v for k, v in plain(got).items() if k[0] != 9} == want and len(want) > 30
    assert any("recommended" in v for v in want.values())


def test_advice_without_joins_is_that_of_the_joins(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.random(), None]), rng.choice([rng.random(), rng.random(), None]), rng.choice([rng.random(), None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a_mean double, b_mean double, dose double")
    rules, bounds = rule_tables(spark)
    theirs = R.recommend(df, rules, bounds, ["a_mean", "b_mean"], "dose")
    mine = R.advise(df, rules, bounds, ["a_mean", "b_mean"], "dose").select(theirs.columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))
    none = R.advise(df, rules.where("false"), bounds, ["a_mean"], "dose").select("n_rules", "status").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "no_recommendation")]


def test_writeback_bounds(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.3, 100.0, 90.0, 20.0), (0.2, 0.4, 0.3, 100.0, 0.0, 20.0), (0.2, 0.4, 0.3, 100.0, 90.0, None), (None, None, None, None, 90.0, 20.0)], "rec_min double, rec_max double, rec_target double, flow double, now double, conc double")
    got = [tuple(None if x is None else round(x, 9) for x in r) for r in S.with_writeback(df, "flow", "now", "conc").select("feed_min", "feed_max", "dry_mass", "writeback_lower", "writeback_upper").collect()]
    assert got == [(20.0, 40.0, 18.0, round(20 / 18, 9), round(40 / 18, 9)), (20.0, 40.0, None, None, None), (20.0, 40.0, None, None, None), (None, None, 18.0, None, None)]


def test_ratio_needs_a_positive_denominator(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 2.0), (-1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r["r"] for r in S.with_ratio(df, "a", "b", "r").select(F.col("r")).collect()] == [0.5, 0.0, None, None, None]
