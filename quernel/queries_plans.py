"""Queries of the plans: cleaning, features, policies, validation, files and text. See ``queries`` for the conventions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions import bins as B
from quernel.functions import scalars as S
from quernel.operators import aggregates as A
from quernel.operators import series as W
from quernel.operators import text as X
from quernel.operators import positions, smooth
from quernel.operators.prefix import prefix_quantiles
from quernel.plans import clean, features, policy, rules, validation
from quernel import queries as base
from quernel.queries import HINGE_COLUMNS, HOURLY, SAMPLES, TAGS, hinge_sql, hourly, in_units, query, r6, rounded, samples, table
from quernel.sources import shared, sinks, tables
from quernel.streaming import stateful


# --- sources and sinks --------------------------------------------------------------------------------------------------------


@query("SELECT upper(event_type) AS tag, ts AS time, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def src03_point_files(spark, sf_dir):
    """Points written as files without a header, and read back with duplicates resolved."""
    path = shared.new_path(spark, "points")
    e = table(spark, sf_dir, "events")
    last = W.keep_last(e, ["event_type", "ts"], [F.col("event_id")])
    sinks.write(last.select(F.concat(F.lit("B4_"), "event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("value").cast("string"), F.lit("ok")), path, "tsv")
    return tables.read_points(spark, path)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS time, round(avg(value) FILTER (event_type = 'view'), 6) AS v, round(avg(value) FILTER (event_type = 'click'), 6) AS c FROM events GROUP BY 1")
def src04_wide_csv(spark, sf_dir):
    path = shared.new_path(spark, "wide")
    daily = table(spark, sf_dir, "events").withColumn("time", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    wide = A.long_to_wide(daily, ["time"], "event_type", "value", TAGS)
    sinks.write(wide.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")), path, "csv")
    return rounded(tables.read_wide(spark, path, {"view": "v", "click": "c"}))


@query("SELECT 'a' AS file, count(*) AS n, 1.0::DOUBLE AS time_rate, round(avg((event_id % 10 <> 0)::INT), 6) AS value_rate, avg((event_id % 10 <> 0)::INT) >= 0.8 AS accepted FROM events")
def src10_parse_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("a").alias("file"), F.col("ts").cast("string").alias("t"), F.when(F.col("event_id") % 10 != 0, F.col("value").cast("string")).otherwise("bad").alias("v"))
    return rounded(tables.parse_rates(e, "t", "v"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def src16_json_rows(spark, sf_dir):
    path = shared.new_path(spark, "rows")
    sinks.write(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), path, "json")
    return spark.read.schema("c_custkey long, c_acctbal double").json(path)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def src20_orc_table(spark, sf_dir):
    path = shared.new_path(spark, "table") + ".orc"
    sinks.write(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), path, "orc")
    return tables.read_table(spark, path)


@query("SELECT 'f1' AS feature, 0.25::DOUBLE AS q33, 0.75::DOUBLE AS q66, 'r1' AS rule_id, 10.0::DOUBLE AS dose_min")
def src18_artifact(spark, sf_dir):
    path = shared.new_path(spark, "artifact")
    one = spark.range(1).select(F.lit('{"rules": [{"rule_id": "r1", "feature": "f1", "bin": "low", "dose_min": 10, "dose_max": 20}], "boundaries": {"f1": {"q33": 0.25, "q66": 0.75}}}').alias("value"))
    one.coalesce(1).write.text(path)
    r, b = tables.read_artifact(spark, path)
    return b.join(r, "feature").select("feature", "q33", "q66", "rule_id", "dose_min")


@query("SELECT count(*) AS n, min(m) AS first, max(m) AS last, round(avg(1000 + 50 * sin(i / 10.0)), 6) AS ca FROM (SELECT i, TIMESTAMP '2026-01-01' + INTERVAL (i) MINUTE AS m FROM range(80) t(i))")
def src22_synthetic_minutes(spark, sf_dir):
    return rounded(tables.synthetic_minutes(spark, 80).agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.avg("ca").alias("ca")))


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN round(c_acctbal / c_nationkey, 6) END AS x, (c_nationkey = 0)::INT AS replaced FROM customer")
def snk02_strict(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x = F.when(F.col("c_nationkey") == 0, float("inf")).otherwise(F.col("c_acctbal") / F.col("c_nationkey"))
    return rounded(sinks.strict(c.select("c_custkey", x.alias("x"))))


# --- projections --------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS label, c_acctbal AS value FROM customer")
def prj02_rename(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "label", "c_acctbal": "value"}).select("id", "label", "value")


@query(f"WITH {SAMPLES} SELECT id, dose, f1 FROM samples")
def prj16_safe_projection(spark, sf_dir):
    s = samples(spark, sf_dir).select("id", "dose", "f1", F.col("y_ok").alias("p_ok"), F.col("label").alias("label_target"))
    return s.select(*S.safe_columns(s.columns))


@query("SELECT p_partkey, upper(regexp_replace(p_brand, '\\s+', '', 'g')) LIKE 'BRAND#1%' AS brand, contains(lower(p_type), 'steel') AS steel FROM part")
def prj17_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(F.regexp_replace("p_brand", r"\s+", "")).startswith("BRAND#1").alias("brand"), F.lower("p_type").contains("steel").alias("steel"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value IS NOT NULL")
def prj18_filter_rows(spark, sf_dir):
    return clean.filter_rows(table(spark, sf_dir, "events"), ["value"], "2024-01-10 00:00:00", "ts", True).select("event_id")


@query("SELECT round(l_discount, 9) AS lower, round(l_tax, 9) AS upper, count(*) AS n FROM lineitem GROUP BY 1, 2")
def prj22_band_keys(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(S.band_key(F.col("l_discount"), F.col("l_tax")).alias("k")).agg(F.count("*").alias("n"))
    return n.select("k.*", "n")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-12 06:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def prj24_window_filter(spark, sf_dir):
    end = F.lit("2024-01-12 12:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(F.col("ts").between(end - F.make_dt_interval(hours=F.lit(6)), end)).select("event_id")


@query("SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'balance' END, CASE WHEN c_nationkey > 3 THEN NULL ELSE 'nation' END) AS missing FROM customer")
def prj26_missing_features(spark, sf_dir):
    cols = {"balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "nation": F.when(F.col("c_nationkey") > 3, F.col("c_nationkey"))}
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(S.missing_names(cols), ";").alias("missing"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y_%m') AS period FROM orders")
def prj28_period(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.period(F.col("o_orderdate")).alias("period"))


# --- joins and windows --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS time, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), l AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS time, avg(value) AS t90 FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT time, round(v, 6) AS v, round(t90, 6) AS t90 FROM p LEFT JOIN l USING (time)""")
def jn02_sparse_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p, lab = (tables.minute_means(e.where(F.col("event_type") == t), "ts", "value").withColumnsRenamed({"minute": "time", "value": n}) for t, n in (("view", "v"), ("error", "t90")))
    return rounded(clean.attach_labels(p, lab))


GRID = """WITH p AS (SELECT ts, max(value) AS v, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT floor(min(t) / 3600)::BIGINT AS a, floor(max(t) / 3600)::BIGINT AS z FROM p), g AS (SELECT unnest(range(a, z + 1)) * 3600 AS t FROM b)"""


@query(GRID + """ SELECT to_timestamp(g.t) AT TIME ZONE 'UTC' AS grid_ts, p.v AS value, p.ts AS match_ts FROM g LEFT JOIN LATERAL (SELECT v, ts FROM p WHERE p.t BETWEEN g.t - 7200 AND g.t + 7200 ORDER BY abs(p.t - g.t), p.t DESC LIMIT 1) p ON true""")
def jn08_nearest_on_grid(spark, sf_dir):
    return features.on_grid(table(spark, sf_dir, "events").where("event_type = 'view'"), "ts", "value", 3600, 7200.0).select("grid_ts", "value", "match_ts")


@query(GRID.replace("'view'", "'error'") + """ SELECT to_timestamp(g.t) AT TIME ZONE 'UTC' AS grid_ts, p.v AS value, p.ts AS match_ts FROM g LEFT JOIN LATERAL (SELECT v, ts FROM p ORDER BY abs(p.t - g.t), p.t DESC LIMIT 1) p ON true""")
def jn08_without_tolerance(spark, sf_dir):
    return features.on_grid(table(spark, sf_dir, "events").where("event_type = 'error'"), "ts", "value", 3600).select("grid_ts", "value", "match_ts")


@query("SELECT count(*) AS n, min(score) AS least, max(score) AS most FROM (SELECT a * 100 + b * 10 + c AS score FROM range(3) x(a), range(4) y(b), range(5) z(c))")
def jn19_setting_grid(spark, sf_dir):
    rows = policy.grid({"a": range(3), "b": range(4), "c": range(5)})
    g = spark.createDataFrame(rows, "a long, b long, c long")
    return g.select((F.col("a") * 100 + F.col("b") * 10 + F.col("c")).alias("score")).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, round(value - lag(value) OVER w, 6) AS diff FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def wn04_neighbours(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), r6(F.col("value") - F.lag("value").over(w)).alias("diff"))


@query("""SELECT a.event_id AS id, round(avg(p.value), 6) AS x_mean, round(stddev_samp(p.value), 6) AS x_std, min(p.value) AS x_min, max(p.value) AS x_max, round(max(p.value) - min(p.value), 6) AS x_range,
round(CASE WHEN count(p.value) >= 2 THEN regr_slope(p.value, epoch_us(p.ts) / 60e6 - 28000000) END, 6) AS x_slope, round(1 - count(p.value) / greatest(360, count(p.event_id)), 6) AS x_missing_rate
FROM (SELECT * FROM events WHERE event_type = 'signup') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON p.ts > a.ts - INTERVAL 525 MINUTE AND p.ts <= a.ts - INTERVAL 165 MINUTE GROUP BY 1""")
def wn06_anchored_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    anchors = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("anchor"))
    out = features.anchored_stats(anchors, e.where("event_type = 'view'").select("event_id", "ts", "value"), "ts", "value", 165, 360, "x")
    return rounded(out.drop("anchor"))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS window_mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 10800000000 PRECEDING AND CURRENT ROW)")
def wn07_runtime_means(spark, sf_dir):
    return rounded(features.runtime_means(table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", "value", 180, 5).select("event_id", "window_mean"))


@query("SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS smooth FROM events")
def wn16_smooth(spark, sf_dir):
    out = smooth.centred_median(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 15, 1)
    return rounded(out.select("event_id", "smooth"))


@query("""WITH e AS (SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
d AS (SELECT a.event_id, a.x AS x0, b.x, b.y, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.x - a.x)) AS rn FROM e a JOIN e b USING (user_id)),
reached AS (SELECT *, max(d) FILTER (rn <= 9) OVER (PARTITION BY event_id) AS reach FROM d),
weighed AS (SELECT *, CASE WHEN reach > 0 THEN pow(1 - pow(least(d / reach, 1), 3), 3) WHEN rn <= 9 THEN 1 ELSE 0 END AS w FROM reached),
means AS (SELECT *, sum(w) OVER p AS sw, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM weighed WINDOW p AS (PARTITION BY event_id)),
sums AS (SELECT event_id, any_value(x0) AS x0, any_value(reach) AS reach, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM means GROUP BY event_id)
SELECT event_id, round(my + CASE WHEN sxx > 1e-12 * sw * reach * reach THEN sxy / sxx ELSE 0 END * (x0 - mx), 4) AS smooth FROM sums""")
def wn16_lowess(spark, sf_dir):
    """One pass over nine rows; the robust passes are tested against plain loops."""
    e = table(spark, sf_dir, "events").where("value is not null and ts is not null").select("event_id", "user_id", "value", ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 86_400_000_000.0).alias("x"))
    return smooth.lowess(e, "x", "value", 9, ["user_id"], 0).select("event_id", F.round("smooth", 4).alias("smooth"))


VISIBLE = "WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000000 PRECEDING)"


@query(f"SELECT event_id, count(value) OVER w AS n_visible, CASE WHEN count(value) OVER w >= 10 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS median FROM events {VISIBLE}")
def wn17_walk_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = prefix_quantiles(e, ["user_id"], "us", "value", (0.5,), 86_400_000_000, 10)
    return rounded(out.select("event_id", "n_visible", F.col("q")[0].alias("median")))


@query(f"""WITH q AS (SELECT event_id, count(value) OVER w AS n_visible, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER w)) AS e FROM events {VISIBLE.replace("user_id", "event_type")})
SELECT event_id, n_visible, CASE WHEN n_visible >= 50 THEN len(e) END::INT AS n_edges, CASE WHEN n_visible >= 50 THEN round(e[1], 6) END AS first_edge, CASE WHEN n_visible >= 50 THEN round(e[3], 6) END AS third_edge,
       CASE WHEN n_visible >= 50 THEN round(e[-1], 6) END AS last_edge FROM q""")
def wn17_edges(spark, sf_dir):
    """Bin edges of each event type from what was visible a day before, of some thousand rows a key."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = policy.walk_forward_edges(e, ["event_type"], "us", "value", 5, 86_400_000_000, 50)
    edges = F.col("edges")
    return rounded(out.select("event_id", "n_visible", F.when(edges.isNotNull(), F.size("edges")).alias("n_edges"), F.get("edges", F.lit(0)).alias("first_edge"), F.get("edges", F.lit(2)).alias("third_edge"), F.element_at("edges", -1).alias("last_edge")))


@query(f"""WITH v AS (SELECT event_id, value, count(value) OVER w AS n, quantile_cont(value, 0.25) OVER w AS a, quantile_cont(value, 0.5) OVER w AS m, quantile_cont(value, 0.75) OVER w AS b FROM events {VISIBLE})
SELECT event_id, n AS value_visible, CASE WHEN n >= 4 THEN round((value - m) / coalesce(nullif(b - a, 0), 1), 6) END AS value_scaled FROM v""")
def wn17_scaled(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rounded(policy.walk_forward_scaled(e, ["user_id"], "us", ["value"], 86_400_000_000, 4).select("event_id", "value_visible", "value_scaled"))


@query("SELECT c_mktsegment, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC NULLS LAST, c_acctbal, c_custkey) AS place FROM customer")
def srt01_multi_key(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc_nulls_last("c_nationkey"), "c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey", F.row_number().over(w).alias("place"))


@query("SELECT true AS same, false AS other")
def set03_equality(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    same, other = A.same_rows(n, n.repartition(3)), A.same_rows(n, n.where("n_nationkey > 0"))
    return spark.range(1).select(F.lit(same).alias("same"), F.lit(other).alias("other"))


# --- cleaning, policies, validation -------------------------------------------------------------------------------------------


@query()
def dom00_clean_series(spark, sf_dir):
    return rounded(clean.clean_series(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", F.col("event_id")).select("event_id", "value", "spike", "was_missing"))


@query(f"""WITH {HOURLY}, w AS (SELECT hour AS time, """ + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in TAGS) + """ FROM hourly GROUP BY 1), v AS (""" + " UNION ALL ".join(f"SELECT time, '{t}' AS point, {t} AS value FROM w" for t in TAGS) + """)
SELECT time, point, round(value, 6) AS value, CASE WHEN value < 5 THEN 'below_lower_bound' ELSE 'above_upper_bound' END AS reason FROM v WHERE value < 5 OR value > 60""")
def prj10_violation_rows(spark, sf_dir):
    wide = A.long_to_wide(hourly(spark, sf_dir), ["hour"], "event_type", "value", TAGS).withColumnRenamed("hour", "time")
    return rounded(clean.clean_with_audit(wide, dict.fromkeys(TAGS, (5.0, 60.0)), "view")[1])


MOVED = SAMPLES + ", acted AS (SELECT *, CASE WHEN f1 > 700 THEN 'move' ELSE 'hold' END AS action FROM samples)"
SUMMARY = ", ".join(f"avg({c}) FILTER (action = '{a}') AS {'action' if a == 'move' else 'hold'}_{c}" for a in ("move", "hold") for c in ("y_ok", "y_low", "y_high"))


@query(f"WITH {MOVED}, s AS (SELECT line, count(*) AS n, count(*) FILTER (action = 'move') AS n_actions, {SUMMARY} FROM acted GROUP BY 1) SELECT line, n, n_actions, round(n_actions / n, 6) AS action_rate, " + ", ".join(f"round({p}_{c}, 6) AS {p}_{c}" for p in ("action", "hold") for c in ("y_ok", "y_low", "y_high")) + ", round(action_y_ok - hold_y_ok, 6) AS ok_lift FROM s")
def ag07_branch_summary(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("action", F.when(F.col("f1") > 700, "move").otherwise("hold"))
    return rounded(policy.branch_summary(s, ["line"]))


@query(f"WITH {MOVED}, s AS (SELECT line, count(*) AS n, count(*) FILTER (action = 'move') AS a, {SUMMARY} FROM acted GROUP BY 1) SELECT line, action_y_ok - hold_y_ok >= 0.03 AS lift_ok, action_y_high - hold_y_high <= 0.02 AS risk_ok, a / n <= 0.2 AS rate_ok FROM s")
def dom04_policy_flags(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("action", F.when(F.col("f1") > 700, "move").otherwise("hold"))
    return policy.policy_flags(policy.branch_summary(s, ["line"])).select("line", "lift_ok", "risk_ok", "rate_ok")


@query(f"""WITH {SAMPLES}, b AS (SELECT line, floor(f1 / 100) AS lower, floor(f1 / 100) + 1 AS upper, y_ok FROM samples), c AS (SELECT line, lower, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n DESC, lower) AS place FROM c),
t AS (SELECT line, count(*) AS u, sum(n) FILTER (place <= 5) / sum(n) AS s FROM r GROUP BY 1)
SELECT line, count(*) AS n, 1.0::DOUBLE AS coverage, round(avg(y_ok), 6) AS accuracy, round(quantile_cont(upper - lower, 0.75) - quantile_cont(upper - lower, 0.25), 6) AS width_iqr, any_value(u) AS unique_bands, round(any_value(s), 6) AS top5_share FROM b JOIN t USING (line) GROUP BY 1""")
def ag08_scorecard(spark, sf_dir):
    b = F.floor(F.col("f1") / 100).cast("double")
    s = samples(spark, sf_dir).withColumns({"lower": b, "upper": b + 1, "hit": F.col("y_ok") == 1})
    return rounded(policy.scorecard(s, ["line"], "lower", "upper", "hit"))


@query(f"""WITH {SAMPLES}, e AS (SELECT list_sort(list_distinct(quantile_cont(dose, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e, quantile_cont(f1, [0.25, 0.5, 0.75]) AS a, quantile_cont(f2, [0.25, 0.5, 0.75]) AS c FROM samples),
h AS (SELECT s.*, greatest(len(list_filter(e, lambda q: q < dose)) - 1, 0)::INT AS bin, (f1 - a[2]) / coalesce(nullif(a[3] - a[1], 0), 1) AS x1, (f2 - c[2]) / coalesce(nullif(c[3] - c[1], 0), 1) AS x2 FROM samples s, e),
near AS (SELECT q.id, h.bin, h.y_ok, h.y_high, h.y_low FROM h q JOIN h ON h.id <> q.id AND h.time < q.time WHERE q.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY (abs(q.x1 - h.x1) + abs(q.x2 - h.x2)) / 2, h.id) <= 60),
bins AS (SELECT id, bin, count(*) AS n, avg(y_ok) AS ok, avg(y_high) AS high, avg(y_low) AS low FROM near GROUP BY 1, 2), al AS (SELECT avg(y_ok) AS aok, avg(y_high) AS ah, avg(y_low) AS alow FROM samples),
risk AS (SELECT bin, avg(y_high) >= any_value(ah) + 0.05 AS risky, avg(y_ok) >= any_value(aok) AND avg(y_high) <= any_value(ah) AND avg(y_low) <= any_value(alow) AS safe FROM h, al GROUP BY 1),
now AS (SELECT h.id, h.bin AS cur, b.n AS nn, b.ok AS nok, b.high AS nh, b.low AS nl, risk.risky AS nr FROM h LEFT JOIN bins b ON b.id = h.id AND b.bin = h.bin LEFT JOIN risk ON risk.bin = h.bin WHERE h.id % 100 = 0),
fair AS (SELECT b.*, nok, nr AND safe AND b.bin < cur AS down, risky FROM bins b JOIN now USING (id) JOIN risk ON risk.bin = b.bin WHERE nn >= 10 AND n >= 10 AND ok - nok >= 0.03 AND high - nh <= 0.02 AND low - nl <= 0.02),
pick AS (SELECT id, bin, ok - nok AS gain, down FROM fair WHERE down OR NOT risky QUALIFY row_number() OVER (PARTITION BY id ORDER BY down DESC, CASE WHEN down THEN bin END, ok DESC, n DESC, bin) = 1)
SELECT now.id, cur AS current_bin, coalesce(pick.bin, cur) AS chosen_bin, round(coalesce(gain, 0), 6) AS expected_gain, CASE WHEN pick.id IS NULL THEN 'hold' ELSE 'move' END AS action,
CASE WHEN coalesce(nn, 0) < 10 THEN 'insufficient_current_bin_support' WHEN pick.id IS NULL THEN 'no_safe_candidate' WHEN down THEN 'high_risk_current_bin_decrease_to_safe_bin' ELSE 'safe_better_historical_neighbor_bin' END AS reason FROM now LEFT JOIN pick USING (id)""")
def dom03_neighbour_policy(spark, sf_dir):
    s = B.qcut(samples(spark, sf_dir), "dose", 5)
    q = s.where("id % 100 = 0")
    bins = policy.neighbour_bins(q, s, ["f1", "f2"], 60, "bin", ("time", "time"))
    return rounded(policy.choose(bins, q, policy.risky_bins(s, "bin"), "bin"))


MET = """p AS (SELECT event_id, ts AS pred_ts, value, ts + INTERVAL 174 MINUTE AS q FROM events WHERE event_type = 'view'), l AS (SELECT ts AS label_ts, max(value) AS label FROM events WHERE event_type = 'error' GROUP BY 1),
met AS (SELECT p.*, l.label_ts AS match_ts, l.label FROM p JOIN LATERAL (SELECT * FROM l WHERE l.label_ts BETWEEN p.q - INTERVAL 90 MINUTE AND p.q + INTERVAL 90 MINUTE ORDER BY abs(epoch_us(l.label_ts) - epoch_us(p.q)), l.label_ts LIMIT 1) l ON true)"""


def holdout(spark, sf_dir, **how):
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'view'").select("event_id", F.col("ts").alias("pred_ts"), "value")
    lab = e.where("event_type = 'error'").groupBy(F.col("ts").alias("label_ts")).agg(F.max("value").alias("label"))
    return validation.align(p, lab, **how)


@query(f"WITH {MET} SELECT event_id, match_ts, label FROM met")
def dom12_align_labels(spark, sf_dir):
    return holdout(spark, sf_dir).select("event_id", "match_ts", "label")


@query(f"WITH {MET}, o AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY match_ts ORDER BY abs(epoch_us(match_ts) - epoch_us(q)), pred_ts DESC) = 1) SELECT count(*) AS n, count(*) FILTER (value <= 20) AS n_inside, round(avg((label > 8.7)::INT) FILTER (value <= 20), 6) AS inside_high, round(avg((label > 8.7)::INT) FILTER (value > 20), 6) AS outside_high FROM o")
def dom12_strategy_report(spark, sf_dir):
    one = holdout(spark, sf_dir, one_to_one=True).withColumn("position", F.when(F.col("value") <= 20, "inside_band").otherwise("above_band"))
    return rounded(validation.strategy_report(one, "label", "position").select("n", "n_inside", "inside_high", "outside_high"))


@query("""WITH a AS (SELECT strftime(o_orderdate, '%Y_%m') AS month, count(*) AS orders_n, max(o_totalprice) AS orders_most FROM orders GROUP BY 1), b AS (SELECT strftime(l_shipdate, '%Y_%m') AS month, count(*) AS items_n FROM lineitem GROUP BY 1)
SELECT month, orders_n, orders_most, items_n, CASE WHEN coalesce(orders_n, 0) < 150 THEN 'few_orders_n' WHEN coalesce(items_n, 0) < 600 THEN 'few_items_n' ELSE 'enough' END AS evidence FROM a FULL JOIN b USING (month)""")
def ag17_monthly(spark, sf_dir):
    m = validation.monthly({"orders": (table(spark, sf_dir, "orders"), "o_orderdate", {"n": F.count("*"), "most": F.max("o_totalprice")}), "items": (table(spark, sf_dir, "lineitem"), "l_shipdate", {"n": F.count("*")})})
    return validation.gate(m, {"orders_n": 150, "items_n": 600})


@query("SELECT event_id AS report, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '$.none', NULL FROM events")
def dom13_evidence(spark, sf_dir):
    return validation.evidence(table(spark, sf_dir, "events").withColumnRenamed("event_id", "report"), "props", ["$.k", "$.none"])


@query(f"""WITH {HOURLY}, v AS (SELECT hour, value FROM hourly WHERE event_type = 'view'), c AS (SELECT hour, value FROM hourly WHERE event_type = 'click'), o AS (SELECT unnest([-60, 0, 60, 120]) AS o)
SELECT o::INT AS "offset", count(c.value) AS n, round(corr(v.value, c.value), 6) AS r FROM v JOIN o ON true JOIN c ON c.hour = v.hour - INTERVAL (o) MINUTE GROUP BY 1""")
def dom10_alignment_sweep(spark, sf_dir):
    h = hourly(spark, sf_dir)
    v = h.where("event_type = 'view'").select("hour", F.col("value").alias("v")).withColumn("offset", F.explode(F.array(*map(F.lit, (-60, 0, 60, 120)))))
    v = v.withColumn("at", F.col("hour") - F.make_dt_interval(mins=F.col("offset")))
    met = v.join(h.where("event_type = 'click'").select(F.col("hour").alias("at"), F.col("value").alias("c")), "at")
    return rounded(met.groupBy("offset").agg(F.count("c").alias("n"), F.corr("v", "c").alias("r")))


@query("""WITH lab AS (SELECT event_id AS id, epoch_us(ts) AS a, value AS label FROM events WHERE event_type = 'error' AND value IS NOT NULL),
pts AS (SELECT event_type AS tag, epoch_us(ts) AS t, max(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
lags(scenario, tag, lag) AS (VALUES ('uniform_60', 'view', 60), ('uniform_60', 'click', 60), ('piecewise', 'view', 165), ('piecewise', 'click', 174)),
shifted AS (SELECT scenario, tag, t + lag::BIGINT * 60000000 AS t, v FROM lags JOIN pts USING (tag)),
met AS (SELECT scenario, tag, id, label, v FROM lab JOIN shifted ON t BETWEEN a - 1800000000 AND a + 1800000000 QUALIFY row_number() OVER (PARTITION BY scenario, tag, id ORDER BY abs(t - a), t) = 1)
SELECT scenario, tag AS x, 'label' AS y, count(*) AS n, round(corr(v, label), 6) AS r FROM met WHERE v IS NOT NULL GROUP BY 1, 2""")
def dom11_lag_scenarios(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    labels = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("anchor"), F.col("value").alias("label"))
    points = {t: e.where(F.col("event_type") == t).select("ts", "value") for t in ("view", "click")}
    out = None
    for name, lags in {"uniform_60": {"view": 60, "click": 60}, "piecewise": {"view": 165, "click": 174}}.items():
        d = features.shifted_design(labels, points, lags, "ts", "value", 1800)
        r = A.correlations(d, [("view", "label"), ("click", "label")]).drop("p").withColumn("scenario", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return rounded(out)


FLAG_COLUMNS = ", ".join(f"sum(y_{k})::BIGINT AS y_{k}_count, round(avg(y_{k}), 6) AS y_{k}_rate" for k in ("ok", "low", "high", "out_spec"))


@query(f"""WITH {SAMPLES}, long AS (SELECT id, 'f1' AS feature, f1 AS x FROM samples UNION ALL SELECT id, 'f2', f2 FROM samples), bounds AS (SELECT feature, quantile_cont(x, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM long GROUP BY 1),
reg AS (SELECT feature, CASE WHEN x <= q[1] THEN 'low' WHEN x <= q[2] THEN 'mid' ELSE 'high' END AS regime, samples.* EXCLUDE (regime) FROM long JOIN bounds USING (feature) JOIN samples USING (id)),
e AS (SELECT feature, regime, list_sort(list_distinct(quantile_cont(dose, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM reg GROUP BY 1, 2), b AS (SELECT reg.*, greatest(len(list_filter(e, lambda q: q < dose)) - 1, 0)::INT AS bin FROM reg JOIN e USING (feature, regime)),
r AS (SELECT feature, regime, bin, count(*) AS n, round(min(dose), 6) AS dose_min, round(max(dose), 6) AS dose_max, round(avg(dose), 6) AS dose_mean, round(quantile_cont(dose, 0.5), 6) AS dose_median, round(avg(label), 6) AS label_mean, round(quantile_cont(label, 0.5), 6) AS label_median,
round(stddev_samp(label), 6) AS label_std, {FLAG_COLUMNS} FROM b GROUP BY 1, 2, 3) SELECT *, bin = max(bin) OVER w OR bin = min(bin) OVER w AS is_edge FROM r WINDOW w AS (PARTITION BY feature, regime)""")
def dom01_regime_response(spark, sf_dir):
    return rounded(rules.regime_response(samples(spark, sf_dir), ["f1", "f2"], "dose", "label"))


REGIMES = f"""{SAMPLES}, long AS (SELECT id, 'f1' AS feature, f1::DOUBLE AS v FROM samples UNION ALL SELECT id, 'f2', f2 FROM samples), bounds AS (SELECT feature, quantile_cont(v, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM long GROUP BY 1),
lev AS (SELECT id, feature, CASE WHEN v <= q[1] THEN 'low' WHEN v <= q[2] THEN 'mid' ELSE 'high' END AS regime FROM long JOIN bounds USING (feature)), val AS (SELECT id, dose::DOUBLE / 100000 AS x, label AS y, y_ok, y_high, y_low, y_out_spec FROM samples),
one AS (SELECT feature, lev.regime, val.* FROM lev JOIN val USING (id)), two AS (SELECT 'f1__x__f2' AS feature, a.regime || '__x__' || b.regime AS regime, val.* FROM lev a JOIN lev b USING (id) JOIN val USING (id) WHERE a.feature = 'f1' AND b.feature = 'f2')"""
KEYS = "feature, regime"


def summary_sql(source: str, least: int) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {KEYS} ORDER BY {c}) + (count(*) OVER (PARTITION BY {KEYS}, {c}) - 1) / 2"
    return f"""{hinge_sql(source, KEYS, 71, 120)}, ranked AS (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry, {rank('y_high')} AS rh FROM {source}),
base AS (SELECT {KEYS}, count(*) AS n, avg(y) AS label_mean, avg(y_ok) AS ok_rate, avg(y_high) AS high_rate, avg(y_low) AS low_rate, avg(y_out_spec) AS out_spec_rate, quantile_cont(x, 0.5) AS dose_median,
 quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS dose_iqr, quantile_cont(y, 0.5) AS label_median, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS label_iqr, corr(rx, ry) AS spearman_label, corr(rx, rh) AS spearman_high
 FROM ranked GROUP BY ALL HAVING count(*) >= {least}),
summary AS (SELECT *, coalesce(spearman_label > 0.05, false) AS positive_relation, coalesce(high_delta >= 0.05, false) AS high_dose_risk, coalesce(high_delta >= 0.05 AND delta_aic > 2, false) AS threshold_supported, n >= 120 AS stable_support
 FROM base LEFT JOIN (SELECT {KEYS}, threshold, slope_before, slope_after, delta_aic, high_before, high_after, high_delta FROM hinge) USING ({KEYS}))"""


SUMMARY_COLUMNS = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("label_mean", "ok_rate", "high_rate", "low_rate", "out_spec_rate", "dose_median", "dose_iqr", "label_median", "label_iqr", "spearman_label", "spearman_high", "threshold", "slope_before", "slope_after", "delta_aic", "high_before", "high_after", "high_delta")
) + f", {KEYS}, n, positive_relation, high_dose_risk, threshold_supported, stable_support"


@query(f"WITH {REGIMES}, {hinge_sql('one', KEYS, 31, 50)} SELECT {KEYS}, {HINGE_COLUMNS} FROM hinge")
def dom02_regime_thresholds(spark, sf_dir):
    rows = rules.regime_rows(in_units(samples(spark, sf_dir)), ["f1", "f2"], "dose", "label")
    return rounded(A.hinge_search(rows, "dose", "label", 31, ["feature", "regime"], high="y_high"))


@query(f"WITH {REGIMES}, {summary_sql('two', 100)} SELECT {SUMMARY_COLUMNS} FROM summary")
def dom02_pair_regimes(spark, sf_dir):
    return rounded(rules.regime_summary(rules.pair_rows(in_units(samples(spark, sf_dir)), [("f1", "f2")], "dose", "label"), 100))


@query(f"""WITH {REGIMES}, {summary_sql('one', 30)}, c AS (SELECT count(*) AS regimes, count(*) FILTER (positive_relation) AS positive, count(*) FILTER (high_dose_risk) AS high_dose_risk, count(*) FILTER (threshold_supported) AS threshold,
count(*) FILTER (n >= 120 AND coalesce(spearman_label, 0) < -0.05) AS contradictory FROM summary), k AS (SELECT *, threshold >= 5 AND positive >= 10 AS broad, high_dose_risk >= 5 OR threshold >= 3 AS local FROM c)
SELECT regimes, positive, high_dose_risk, threshold, contradictory, CASE WHEN regimes = 0 THEN 'insufficient_support' WHEN broad THEN 'broadly_consistent' WHEN local THEN 'context_specific' ELSE 'weak_or_unstable' END AS relation_type,
CASE WHEN regimes = 0 THEN 'insufficient_data' WHEN broad THEN 'use_relation_as_supporting_evidence_for_safe_band' WHEN local THEN 'investigate_context_specific_thresholds'
WHEN positive >= 5 THEN 'update_manual_review_explanation_with_high_calcium_risk' ELSE 'relation_weak_keep_safe_band_empirical' END AS next_step FROM k""")
def dom02_synthesis(spark, sf_dir):
    return rules.synthesize(rules.regime_summary(rules.regime_rows(in_units(samples(spark, sf_dir)), ["f1", "f2"], "dose", "label")))


# --- models -------------------------------------------------------------------------------------------------------------------


@query()
def ml04_incremental_value(spark, sf_dir):
    from quernel.operators import ml

    s = W.chronological_split(samples(spark, sf_dir).select("line", "time", "id", "f1", "f2", "y_ok"), ["line"], ["time", "id"])  # it is written
    return ml.incremental_value(s.where("split = 'train'"), s.where("split = 'test'"), ["f1"], ["f2"], "y_ok")


@query()
def ml05_select_features(spark, sf_dir):
    from quernel.operators import ml

    return ml.select_features(samples(spark, sf_dir), ["f1", "f2", "dose"], ["label", "y_ok"], 2)


@query("""WITH c AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)
SELECT 'c_acctbal' AS feature, 0.0::DOUBLE AS missing_rate, round(stddev_samp(c_acctbal), 4) AS std, round(avg((abs(c_acctbal - q[2]) / (q[3] - q[1]) > 5)::INT), 6) AS outlier_rate, true AS usable FROM customer, c""")
def ml06_audit_features(spark, sf_dir):
    from quernel.operators import ml

    return ml.audit_features(table(spark, sf_dir, "customer"), ["c_acctbal"]).withColumn("std", F.round("std", 4))


@query()
def ml07_components(spark, sf_dir):
    from quernel.operators import ml

    out, n = ml.reduce(samples(spark, sf_dir), ["f1", "f2", "dose"])
    return out.select("id", F.size("pcs").alias("n"))


@query(f"""WITH {SAMPLES}, a AS (SELECT regime, 'f1' AS feature, f1 AS x FROM samples UNION ALL SELECT regime, 'f2', f2 FROM samples), g AS (SELECT feature, avg(x) AS m, stddev_samp(x) AS s, quantile_cont(x, [1/3::DOUBLE, 2/3::DOUBLE]) AS q FROM a GROUP BY 1), p AS (SELECT regime, feature, count(x) AS n, avg(x) AS mean FROM a GROUP BY 1, 2)
SELECT regime, feature, n, round(mean, 6) AS mean, round((mean - m) / s, 6) AS z, CASE WHEN mean <= q[1] THEN 'low' WHEN mean <= q[2] THEN 'mid' ELSE 'high' END AS level FROM p JOIN g USING (feature)""")
def ml10_cluster_profile(spark, sf_dir):
    from quernel.operators import ml

    return rounded(ml.profile_clusters(samples(spark, sf_dir), ["f1", "f2"], "regime"))


# --- text and inventories -----------------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS position FROM documents),
b AS (SELECT doc_id, position, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS body FROM l), f AS (SELECT body, min((doc_id, position)) AS first FROM b WHERE body <> '' GROUP BY body)
SELECT doc_id, position::INT AS position, first[1] AS first_key, first[2]::INT AS first_position FROM b JOIN f USING (body) WHERE (doc_id, position) <> first""")
def dec05_repeated_sections(spark, sf_dir):
    """Lines of all texts that an earlier line repeats."""
    parts = X.sections(table(spark, sf_dir, "documents"), "doc_id", "text", r"\n", titled=False).where("body <> ''")
    return X.repeated_bodies(parts, "doc_id").select("doc_id", "position", "first_key", "first_position")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents) SELECT doc_id, line_number::INT AS line_number FROM l WHERE contains(line, 'License')""")
def dec07_wording(spark, sf_dir):
    return X.scan_wording(table(spark, sf_dir, "documents"), "doc_id", "text", "License").select("doc_id", "line_number")


@query("SELECT 'n_nationkey' AS \"column\", 'int' AS kind, count(n_nationkey) AS n, count(*) - count(n_nationkey) AS n_null FROM nation UNION ALL SELECT 'n_name', 'string', count(n_name), count(*) - count(n_name) FROM nation UNION ALL SELECT 'n_regionkey', 'int', count(n_regionkey), count(*) - count(n_regionkey) FROM nation")
def dec04_inventory(spark, sf_dir):
    return X.inventory(table(spark, sf_dir, "nation"))


@query("SELECT event_id, CASE WHEN value > 100 AND event_type = 'error' THEN 'stop' WHEN value > 50 THEN 'watch' ELSE 'go' END AS decision FROM events")
def dec01_cascade(spark, sf_dir):
    cases = [((F.col("value") > 100) & (F.col("event_type") == "error"), "stop"), (F.col("value") > 50, "watch")]
    return table(spark, sf_dir, "events").select("event_id", rules.first_match(cases, "go").alias("decision"))


@query(f"""WITH {base.RECOMMENDED}, masked AS (SELECT id, CASE WHEN f1 > 50 THEN dose END AS dose FROM samples)
SELECT m.id, CASE WHEN lo IS NULL THEN 'not_recommended' WHEN m.dose IS NULL THEN 'missing' WHEN m.dose < lo THEN 'below_band' WHEN m.dose > hi THEN 'above_band' ELSE 'inside_band' END AS position,
       CASE WHEN lo IS NULL OR m.dose IS NULL THEN 'hold_or_manual_check' WHEN m.dose < lo THEN 'increase_to_band' WHEN m.dose > hi THEN 'decrease_to_band' ELSE 'hold_in_band' END AS action,
       CASE WHEN m.dose IS NULL THEN 100 ELSE 0 END AS status FROM masked m LEFT JOIN sel USING (id)""")
def udf01_score(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("dose", F.when(F.col("f1") > 50, F.col("dose")))
    return rules.score(s, base.rule_tables(spark), B.tertile_boundaries(s, ["f1", "f2"]), ["f1", "f2"], "dose").select("id", "position", "action", "status")


@query(f"WITH {base.RECOMMENDED} SELECT id, n_selected::INT AS n_selected, ids AS selected_rule_ids, round(lo, 6) AS rec_min, round(hi, 6) AS rec_max, action, 'recommended' AS status, confidence FROM reco")
def udf01_advise(spark, sf_dir):
    s = samples(spark, sf_dir)
    return rounded(rules.advise(s, base.rule_tables(spark), B.tertile_boundaries(s, ["f1", "f2"]), ["f1", "f2"], "dose").select("id", "n_selected", "selected_rule_ids", "rec_min", "rec_max", "action", "status", "confidence"))


@query("""WITH p AS (SELECT user_id % 10 AS unit, event_type AS tag, epoch_us(ts) AS us, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL),
served AS (SELECT *, unnest(range((us + 599999999) // 600000000, (us + 5400000000) // 600000000 + 1)) AS g FROM p),
stats AS (SELECT unit, tag, g, count(*) FILTER (us >= g * 600000000 - 3600000000) AS n, avg(value) FILTER (us >= g * 600000000 - 3600000000) AS mean, arg_max(value, (us, value)) AS last, max(us) AS last_us FROM served GROUP BY ALL)
SELECT unit, tag, make_timestamp(g * 600000000) AS at, n, round(mean, 6) AS mean, round(last, 6) AS last, make_timestamp(last_us) AS last_at FROM stats""")
def udf01_trailing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("unit"), F.col("event_type").alias("tag"), "ts", "value")
    out = rounded(stateful.trailing(e, ["unit", "tag"], "ts", "value"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "last_at")})


@query("""WITH p AS (SELECT user_id % 10 AS unit, event_type AS tag, epoch_us(ts) AS us, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL),
served AS (SELECT *, unnest(range((us + 599999999) // 600000000, (us + 5400000000) // 600000000 + 1)) AS g FROM p),
stats AS (SELECT unit, tag, g, count(*) FILTER (us >= g * 600000000 - 3600000000) AS n, avg(value) FILTER (us >= g * 600000000 - 3600000000) AS mean, arg_max(value, (us, value)) AS last FROM served GROUP BY ALL)
SELECT unit, make_timestamp(g * 600000000) AS at, round(max(mean) FILTER (tag = 'click' AND n >= 2), 6) AS click_mean, round(max(last) FILTER (tag = 'click'), 6) AS click_last,
       round(max(mean) FILTER (tag = 'view' AND n >= 2), 6) AS view_mean, round(max(last) FILTER (tag = 'view'), 6) AS view_last FROM stats GROUP BY unit, g""")
def udf01_side_by_side(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("unit"), F.col("event_type").alias("tag"), "ts", "value")
    out = stateful.side_by_side(stateful.trailing(e, ["unit", "tag"], "ts", "value"), ["unit"], "tag", ["click", "view"], least=2)
    return rounded(out).withColumn("at", F.col("at").cast("timestamp_ntz"))


# --- joins by place -----------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey, o_totalprice FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey FROM orders)
SELECT a.place, a.o_orderkey, round(o_totalprice, 6) AS o_totalprice, b.o_orderkey AS o_orderkey_right FROM a JOIN b USING (place)""")
def jn18_zip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = W.numbered(o.select("o_orderkey", "o_totalprice"), [], ["o_orderkey"]).withColumnRenamed("__i", "place")
    b = W.numbered(o.select("o_orderkey", (-F.col("o_totalprice")).alias("p")), [], ["p", "o_orderkey"]).withColumnRenamed("__i", "place").drop("p")
    return rounded(positions.zip_rows(a, b, "place", "place"))


@query("SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, s_name, round(s_acctbal, 6) AS c_acctbal_right FROM customer LEFT JOIN (SELECT s_suppkey, s_name, s_acctbal FROM supplier) s ON c_custkey = s_suppkey")
def jn11_left_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name", F.col("s_acctbal").alias("c_acctbal"))
    return rounded(positions.left_join(c, s, ["c_custkey"]))


@query("""WITH v AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'view'), c AS (SELECT DISTINCT ON (ts) ts, value FROM events WHERE event_type = 'click' ORDER BY ts, event_id)
SELECT v.event_id, round(c.value, 6) AS click FROM v LEFT JOIN c USING (ts)""")
def jn05_exact_value(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(positions.exact_value(e.where("event_type = 'view'").select("event_id", "ts"), e.where("event_type = 'click'"), "ts", "value", ["event_id"], "click").select("event_id", "click"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'flow' WHEN 'click' THEN 'temp' END AS field FROM events")
def jn17_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", positions.looked_up(F.col("event_type"), {"view": "flow", "click": "temp"}).alias("field"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders), b AS (SELECT o_orderkey + 1000000000 AS o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders)
SELECT a.o_orderkey, a.o_custkey, b.o_orderkey AS o_orderkey_right, o_orderstatus, 'position' AS joined_by FROM a JOIN b USING (place)""")
def jn12_joined_or_zipped(spark, sf_dir):
    """Keys that don't meet, so rows are zipped."""
    o = table(spark, sf_dir, "orders")
    return positions.joined_or_zipped(o.select("o_orderkey", "o_custkey"), o.select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), "o_orderstatus"), "o_orderkey", ["o_orderkey"], ["o_orderkey"])
