"""Small cases with stated results."""

import math
import random
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from quernel.functions import bins, scalars
from quernel.operators import aggregates, joins, metrics, series, text
from quernel.plans import rules
from quernel.sources import sinks, tables
from quernel.streaming.scorer import sliding_means


def column(df, name):
    return [r[name] for r in df.collect()]


def at(minute, second=0):
    return T(2026, 1, 1, minute // 60, minute % 60, second)


@pytest.mark.parametrize(("later", "expected"), [(False, 1.0), (True, 2.0)])
def test_asof_ties_go_to_the_earlier_row_unless_asked(spark, later, expected):
    left = spark.createDataFrame([(1, at(5))], "id long, ts timestamp_ntz")
    right = spark.createDataFrame([(at(0), 1.0), (at(10), 2.0)], "ts timestamp_ntz, v double")
    assert column(joins.asof(left, right, [], "ts", "ts", ["v"], 600, later_on_tie=later), "v") == [expected]


def test_asof_respects_tolerance_and_keys(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "b", at(5)), (3, "a", at(90))], "id long, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", at(0), 1.0), ("a", at(7), 2.0)], "k string, ts timestamp_ntz, v double")
    out = {r["id"]: r["v"] for r in joins.asof(left, right, ["k"], "ts", "ts", ["v"], 600).collect()}
    assert out == {1: 2.0, 2: None, 3: None}


def test_interpolation_fills_the_first_rows_of_a_gap(spark):
    values = [0.0, *[None] * 8, 9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert column(series.interpolate(df, [], ["i"], "v", 5).orderBy("i"), "v") == [0, 1, 2, 3, 4, 5, None, None, None, 9]


def test_left_open_frame(spark):
    df = spark.createDataFrame([(at(0), 1.0), (at(60), 2.0), (at(90), 4.0)], "ts timestamp_ntz, v double")
    out = series.range_frame(df, [], "ts", 3600, {"s": F.sum("v")}, left_open=True).orderBy("ts")
    assert column(out, "s") == [1, 2, 6]
    closed = series.range_frame(df, [], "ts", 3600, {"s": F.sum("v")}).orderBy("ts")
    assert column(closed, "s") == [1, 3, 6]


def test_last_value_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None)], "k int, i int, v double")
    assert column(df.groupBy("k").agg(series.last_value("v", F.col("i")).alias("v")), "v") == [5.0]


def test_round_to_minute_is_half_even(spark):
    df = spark.createDataFrame([(at(0, 30),), (at(1, 30),)], "ts timestamp_ntz")
    assert column(df.select(scalars.round_minute(F.col("ts")).alias("m")), "m") == [at(0), at(2)]


def test_null_labels_have_no_flags(spark):
    df = spark.createDataFrame([(None,), (8.2,), (8.71,)], "v double").select(*[c.alias(n) for n, c in scalars.label_flags(F.col("v")).items()])
    assert [tuple(r) for r in df.collect()] == [(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 1)]


def test_quantile_bins_drop_equal_edges(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate((1.0, 1.0, 1.0, 2.0, 3.0, 4.0))], "i int, x double")
    assert column(bins.qcut(df, "x", 4).orderBy("i"), "bin") == [0, 0, 0, 1, 2, 2]


def test_bin_edges_close_right_or_left(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    e = F.array(F.lit(float("-inf")), F.lit(2.0), F.lit(float("inf")))
    assert column(df.select(bins.right_closed(F.col("x"), e).alias("b")), "b") == [0]
    assert column(df.select(bins.left_closed(F.col("x"), F.array(F.lit(2.0))).alias("b")), "b") == [1]


def test_quantiles_are_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert aggregates.quantile_profile(df, "v").first()["q25"] == 1.75


def test_numbers_and_strict_json(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",)], "s string").select(scalars.num(F.col("s")).alias("a"), scalars.strict_num(F.col("s")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(1.5, 1.5), (None, None), (None, None), (float("inf"), None)]
    assert column(sinks.strict(df), "replaced") == [0, 0, 0, 1]


def test_checked_join_stops_on_repeated_keys(spark):
    left, right = spark.range(2), spark.createDataFrame([(0, 1), (0, 2)], "id long, x int")
    with pytest.raises(ValueError, match="repeats"):
        joins.checked_many_to_one(left, right, ["id"])


def test_hinge_search_finds_a_bend(spark):
    df = spark.createDataFrame([(float(i), 1.0 * i if i <= 50 else 50.0 + 3.0 * (i - 50)) for i in range(101)], "x double, y double")
    r = aggregates.hinge_search(df, "x", "y", 71).first()
    assert abs(r["threshold"] - 50) < 1 and abs(r["slope_before"] - 1) < 0.05 and abs(r["slope_after"] - 3) < 0.05
    assert (r["n_before"], r["n_after"], r["supported"]) == (51, 50, True) and r["baseline_sse"] > 1000 and r["delta_aic"] > 100
    flagged = df.withColumn("high", (F.col("x") > 50).cast("int"))
    r = aggregates.hinge_search(flagged, "x", "y", 71, high="high").first()
    assert (r["high_before"], r["high_after"], r["high_delta"]) == (0.0, 1.0, 1.0)
    assert aggregates.hinge_search(df.where("x < 40"), "x", "y").count() == 0  # under 50 rows


def test_pair_regimes_and_synthesis(spark):
    rows = spark.createDataFrame([(i, float(i % 3), float(i // 100), float(i), 8.0 + i / 300) for i in range(300)], "id int, a double, b double, dose double, label double")
    pairs = rules.pair_rows(rows, [("a", "b")], "dose", "label")
    assert {r["regime"] for r in pairs.collect()} == {f"{x}__x__{y}" for x in ("low", "mid", "high") for y in ("low", "mid", "high")}
    summary = rules.regime_summary(rules.regime_rows(rows, ["a"], "dose", "label"), 30)
    got = summary.collect()
    assert len(got) == 3 and all(r["n"] == 100 and abs(r["spearman_label"] - 1) < 1e-9 and r["threshold"] is None and not r["stable_support"] for r in got)
    assert (rules.synthesize(summary).first()["relation_type"], rules.synthesize(summary.limit(0)).first()["relation_type"]) == ("weak_or_unstable", "insufficient_support")


def test_average_precision_counts_steps(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    r = metrics.ranking_metrics(df, "y", "p").first()
    assert abs(r["ap"] - (1 + 2 / 3) / 2) < 1e-12 and abs(r["auc"] - 0.75) < 1e-12


def test_psi_ignores_values_beyond_the_edges(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert abs(aggregates.psi(a, a, ["x"]).first()["psi"]) < 1e-12
    assert aggregates.psi(a, a.select((F.col("x") + 40).alias("x")), ["x"]).first()["psi"] > 0.5


def test_longest_run_and_spikes(spark):
    df = spark.createDataFrame([(i, 100.0 if i == 20 else float(i % 3), i % 5 != 0) for i in range(40)], "i int, v double, f boolean").withColumn("k", F.lit(1))
    assert column(series.longest_true_run(df, ["k"], ["i"], "f"), "longest_run") == [4]
    assert column(series.spikes(df, ["k"], ["i"], "v").where("is_spike"), "i") == []  # the largest step alone sets the floor
    long = spark.createDataFrame([(i, 100.0 if i == 2500 else float(i % 3)) for i in range(5000)], "i int, v double").withColumn("k", F.lit(1))
    assert column(series.spikes(long, ["k"], ["i"], "v").where("is_spike"), "i") == [2500]
    flat = long.withColumn("v", F.when(F.col("i") == 2500, 100.0).otherwise(1.0))
    assert series.spikes(flat, ["k"], ["i"], "v").where("is_spike").isEmpty()  # no deviation around it


def test_rules_prefer_grade_and_fall_back_without_overlap(spark):
    m = spark.createDataFrame([(1, "a", "A", True, 10.0, 20.0, 50, 0.9, 0.05, 0.1, 0.0), (1, "b", "B", True, 30.0, 40.0, 80, 0.8, 0.02, -0.1, 0.05)], "id long, rule_id string, grade string, time_stable boolean, dose_min double, dose_max double, sample_count int, ok_rate double, ok_lift double, high_delta double, low_delta double")
    r = aggregates.combine_rules(m).first()
    assert (r["median_min"], r["median_max"], r["top_rule"], r["intersection_min"], r["rule_ids"]) == (20.0, 30.0, "a", 10.0, "a;b")
    a, b = 3 * math.log(51) * 0.05 / 2, 2 * math.log(81) * 0.02 / 2
    assert abs(r["weighted_min"] - (10 * a + 30 * b) / (a + b)) < 1e-9


RULES = "rule_id string, feature string, bin string, dose_min double, dose_max double, grade string, status string, time_stable boolean, sample_count int, ok_rate double, high_rate double, low_rate double, ok_lift double, high_delta double, low_delta double"


def test_rows_without_a_rule_are_not_recommended(spark):
    rows = spark.createDataFrame([(1, 5.0, 0.0, 0.0), (2, None, None, None), (3, 9.5, None, 0.0), (4, 1.0, None, 1.5), (5, None, 0.0, None)], "id long, dose double, f1 double, f2 double")
    r = spark.createDataFrame([
        ("a", "f1", "low", 1.0, 9.0, "A", "accept_for_manual_case_review", True, 120, 0.9, 0.02, 0.03, 0.06, -0.01, 0.0), ("b", "f2", "low", 3.0, 5.0, "B", "accept_for_manual_case_review", True, 500, 0.8, 0.1, 0.1, 0.04, 0.0, 0.0),
        ("c", "f2", "mid", 100.0, 200.0, "A", "monitor_only", True, 500, 0.8, 0.1, 0.1, 0.04, 0.0, 0.0)], RULES)
    b = spark.createDataFrame([("f1", 1.0, 2.0), ("f2", 1.0, 2.0)], "feature string, q33 double, q66 double")
    out = {x["id"]: (x["action"], x["status"], x["selected_rule_ids"], x["confidence"], x["rec_max"]) for x in rules.recommend(rows, r, b, ["f1", "f2"], "dose").collect()}
    # a better grade wins over more samples, and rules that are only monitored say nothing
    assert out == {
        1: ("hold_in_band", "recommended", "a", "high", 9.0), 2: ("hold_or_manual_check", "no_recommendation", None, "none", None), 3: ("decrease_to_band", "recommended", "b", "medium", 5.0),
        4: ("hold_or_manual_check", "no_recommendation", None, "none", None), 5: ("hold_or_manual_check", "no_recommendation_missing_current_dose", "a", "high", 9.0)}
    assert {x["id"]: x["status"] for x in rules.score(rows, r, b, ["f1", "f2"], "dose").collect()} == {1: 0, 2: 100, 3: 0, 4: 0, 5: 100}


def test_near_repeats_match_brute_force(spark):
    rng = random.Random(4)
    bodies = ["".join(rng.choice("abc ") for _ in range(rng.randint(60, 120))) for _ in range(12)]
    bodies += [b[:30] + "x" + b[31:] for b in bodies[:6]] + [b + " tail" for b in bodies[:3]] + bodies[:2]
    rows = [(i, 0, f"t{i % 2}", b) for i, b in enumerate(bodies)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(i, j) for i, _, t, a in rows for j, _, u, b in rows if i < j and t == u and abs(len(a) - len(b)) <= 20 and 1 - edits(a, b) / max(len(a), len(b)) >= 0.95}
    got = text.near_repeats(spark.createDataFrame(rows, "k long, position int, title string, body string"), "k", 0.95).collect()
    assert {(r["key_a"], r["key_b"]) for r in got} == want and len(got) == len(want) > 5


@pytest.mark.parametrize(("held", "block"), [(1_000_000, 100_000), (0, 100_000), (0, 3)])
def test_quantiles_of_many_groups_match_the_exact_function(spark, monkeypatch, held, block):
    monkeypatch.setattr(series, "HELD_ROWS", held)
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(40))])) for _ in range(2000)] + [("c", None), ("d", 1.5)], "g string, v double")
    fs = [0.0, 0.01, 1 / 3, 0.5, 0.999, 1.0]
    want = {r["g"]: r["q"] for r in df.where("v is not null and not isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, fs))).alias("q")).collect()}
    got = {r["g"]: r["q"] for r in series.quantiles(df, "v", fs, ["g"]).collect()}
    assert set(got) == set(want) == {"a", "b", None, "d"} and all(abs(x - y) < 1e-9 for g in got for x, y in zip(got[g], want[g], strict=True))
    assert series.quantiles(df.where("false"), "v", fs).first()["q"] is None
    two = {r["g"]: (r["v"], r["w"]) for r in series.quantiles_of(df.withColumn("w", -F.col("v")), ["v", "w"], [0.25, 0.5], ["g"]).collect()}
    exact = df.where("not isnan(v)").groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("v"), F.percentile(-F.col("v"), F.array(F.lit(0.25), F.lit(0.5))).alias("w")).where("v is not null")
    assert two == {r["g"]: (r["v"], r["w"]) for r in exact.collect()}
    assert [r["median"] for r in aggregates.mad(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double"), "v", []).collect()] == [1.5]


def test_scans_take_nan_for_null(spark, tmp_path):
    spark.createDataFrame([("2026-01-01 00:00:00", 1.0), ("2026-01-01 00:01:00", float("nan")), (None, 2.0)], "time string, v double").write.parquet(str(tmp_path / "t"))
    assert sorted(map(str, column(tables.scan_series(spark, str(tmp_path / "t")), "v"))) == ["1.0", "None"]


def test_point_files_keep_the_last_number(spark, tmp_path):
    (tmp_path / "p.txt").write_text("B4_ti/1\t2026-01-01 00:00:00\t1.0\tok\nB4_TI-1\t2026-01-01 00:00:00\t2.0\tok\nB4_TI.1\t2026-01-01 00:00:00\tbad\tok\nother\tnever\t1\tok\n")
    assert [tuple(r) for r in tables.read_points(spark, str(tmp_path)).select("tag", "value").collect()] == [("TI_1", 2.0)]


def test_artifact_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rules": [{"rule_id": "r", "feature": "f", "bin": "low", "dose_min": 1, "dose_max": 2}],\n "boundaries": {"f": {"q33": 0.1, "q66": 0.2}}}')
    r, b = tables.read_artifact(spark, str(tmp_path / "a.json"))
    assert r.first()["rule_id"] == "r" and tuple(b.first()) == ("f", 0.1, 0.2)


def test_streams_give_the_same_windows_as_batches(spark, tmp_path):
    rows = tables.synthetic_minutes(spark, 90).select(F.col("time").cast("timestamp").alias("ts"), F.lit("ca").alias("event_type"), F.col("ca").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sliding_means(stream).writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    same = F.round("mean", 6).alias("mean")  # sums depend on the order of rows
    assert aggregates.same_rows(spark.table("means").withColumn("mean", same), sliding_means(rows).withColumn("mean", same))


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, ts timestamp_ntz, v double")
    assert series.range_frame(e, [], "ts", 60, {"s": F.sum("v")}).count() == 0
    assert joins.asof(e, e.select("ts", F.col("v").alias("w")), [], "ts", "ts", ["w"], 60).count() == 0
    assert aggregates.hinge_search(e.withColumn("y", F.col("v")), "v", "y").count() == 0


def test_silhouette_equals_brute_force_and_the_choice_passes_gates(spark):
    points = [(i % 3, float(i % 3) * 4 + (i * 7 % 5), float(i * 3 % 7)) for i in range(30)]
    df = spark.createDataFrame(points, "c int, a double, b double")
    far = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    total = 0.0
    for i, p in enumerate(points):
        mean = {c: [far(p, q) for j, q in enumerate(points) if q[0] == c and j != i] for c in range(3)}
        mean = {c: sum(v) / len(v) for c, v in mean.items()}
        own, other = mean[p[0]], min(v for c, v in mean.items() if c != p[0])
        total += (other - own) / max(own, other)
    r = metrics.silhouette(df, "c", ["a", "b"]).first()
    assert abs(r["silhouette"] - total / 30) < 1e-9 and (r["min_size"], r["max_size"]) == (10, 10)
    assert metrics.silhouette(df.where("c = 0"), "c", ["a", "b"]).first()["silhouette"] is None
    sweep = spark.createDataFrame([("kmeans", k, k == 4, s, 0.1, 0.0, h, 1.0) for k, s, h in ((2, 0.9, 0.3), (3, 0.95, 0.4), (4, 0.99, 0.9), (5, 0.5, 0.9))],
                                  "kind string, k int, tiny boolean, stability double, label_range double, high_range double, silhouette double, davies_bouldin double")
    assert metrics.choose_clustering(sweep).first()["k"] == 3 and metrics.choose_clustering(sweep.where("k > 3")).count() == 0


def test_frames_of_rows_over_the_edges_of_blocks(spark, monkeypatch):
    import math
    import random
    import statistics

    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(k, None if i == 3 and k == "a" else i // 2, i, None if rng.random() < 0.4 else float(rng.randint(0, 50)), "x") for k in ("a", None) for i in range(83)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double, extra string").repartition(5)
    monkeypatch.setattr(series, "BLOCK_ROWS", 7)
    by_key = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for k in ("a", None)}

    def result(out, name):
        assert out.columns[: len(df.columns)] == df.columns
        return {(r["k"], r["i"]): r[name] for r in out.collect()}

    def expected(f):
        return {(k, s[p][2]): f([r[3] for r in s], p) for k, s in by_key.items() for p in range(len(s))}

    def filled(v, p):
        if v[p] is not None:
            return v[p]
        a = next((q for q in range(p, -1, -1) if v[q] is not None), None)
        b = next((q for q in range(p, len(v)) if v[q] is not None), None)
        return None if a is None or b is None or p - a > 2 else v[a] + (v[b] - v[a]) * (p - a) / (b - a)

    def mean(v, p):
        known = [x for x in v[max(0, p - 4) : p + 1] if x is not None]
        return sum(known) / len(known) if len(known) >= 2 else None

    def slope(v, p):
        known = [(q, v[q]) for q in range(max(0, p - 4), p + 1) if v[q] is not None]
        return statistics.linear_regression(*zip(*known, strict=True)).slope if len(known) > 1 else None

    def same(got, want):
        assert got.keys() == want.keys()
        assert all((a is None and want[k] is None) or (a is not None and want[k] is not None and math.isclose(a, want[k], abs_tol=1e-9)) for k, a in got.items())

    order = ["t", "i"]
    same(result(series.interpolate(df, ["k"], order, "v", 2), "v"), expected(filled))
    same(result(series.rolling_rows(df, ["k"], order, "v", 5, "r", 2), "r_mean"), expected(mean))
    same(result(series.rolling_slope(df, ["k"], order, "v", 5), "slope"), expected(slope))
    high = expected(lambda v, p: (v[p] or 0) > 45)
    near = expected(lambda v, p: any((x or 0) > 45 for x in v[max(0, p - 2) : p + 3]))
    assert any(high.values()) and set(result(series.near_flagged(df, ["k"], order, F.col("v") > 45, 2), "i")) == {k for k, x in near.items() if x}

    runs = {}
    for k, s in by_key.items():
        best = now = 0
        for r in s:
            now = now + 1 if r[3] is not None and r[3] < 45 or r[2] in range(20, 50) else 0
            best = max(best, now)
        runs[k] = best
    flagged = df.withColumn("f", (F.col("v") < 45) | F.col("i").between(20, 49))
    assert {r["k"]: r["longest_run"] for r in series.longest_true_run(flagged, ["k"], order, "f").collect()} == runs
    whole = series.spikes(df.fillna(1.0), ["k"], order, "v", 5, 2.0)
    cut = result(whole, "is_spike")
    monkeypatch.setattr(series, "BLOCK_ROWS", 1000)
    assert cut == result(series.spikes(df.fillna(1.0), ["k"], order, "v", 5, 2.0), "is_spike")
    for empty in (df.limit(0), df.limit(0).withColumn("v", F.lit(None).cast("double"))):
        assert series.interpolate(empty, ["k"], order, "v").count() == series.rolling_slope(empty, [], order, "v", 3).count() == 0
