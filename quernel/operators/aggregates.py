"""Aggregations over doses, labels, features and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.bins import edges, right_closed
from quernel.functions.distributions import chi2_p, correlation_p, f_p
from quernel.functions.scalars import finite
from quernel.operators.series import join_small, quantiles, quantiles_of, value_ranks
from quernel.sources.shared import materialize

FLAGS = ("y_ok", "y_low", "y_high", "y_out_spec")


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("__r")).select(*ids, "__r.*")


def rates(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Rows, label mean and the rate of each flag."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(label).alias("label_mean"), *[F.avg(f).alias(f"{f}_rate") for f in FLAGS])


def rates_with_outside(df: DataFrame, position: str, label: str) -> DataFrame:
    """Rates by position, and of all rows outside the band together."""
    p = F.col(position)
    spread = F.explode(F.when(p.isin("below_band", "above_band"), F.array(p, F.lit("outside_band"))).otherwise(F.array(p)))
    return rates(df.withColumn("group", spread), ["group"], label)


def dose_response(df: DataFrame, bin_col: str, dose: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row a bin: dose and label statistics, flag counts and rates, and whether the bin lies at an edge of its group."""
    out = df.where(F.col(bin_col).isNotNull()).groupBy(*by, bin_col).agg(
        F.count("*").alias("n"), F.min(dose).alias("dose_min"), F.max(dose).alias("dose_max"), F.avg(dose).alias("dose_mean"),
        F.avg(label).alias("label_mean"), F.stddev_samp(label).alias("label_std"),
        *[F.sum(f).alias(f"{f}_count") for f in FLAGS], *[F.avg(f).alias(f"{f}_rate") for f in FLAGS],
    )
    half = quantiles_of(df.where(F.col(bin_col).isNotNull()), list(dict.fromkeys([dose, label])), (0.5,), [*by, bin_col])
    half = half.select(*by, bin_col, F.col(dose)[0].alias("dose_median"), F.col(label)[0].alias("label_median"))
    out = join_small(out, half, [*by, bin_col], "left")
    w = Window.partitionBy(*by)
    return out.withColumn("is_edge", (F.col(bin_col) == F.max(bin_col).over(w)) | (F.col(bin_col) == F.min(bin_col).over(w)))


def best_bin(bins: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """The bin with the highest ok rate, then the most rows, then the least number, among those with ``least`` rows."""
    return bins.where(F.col("n") >= least).groupBy(*by).agg(F.max_by(F.struct("bin", "n", "y_ok_rate"), F.struct("y_ok_rate", "n", -F.col("bin"))).alias("b")).where("b is not null").select(*by, "b.*")


def multi_level(df: DataFrame, dims: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """Metrics for all rows, each dimension and all dimensions together, as rows (level, key, metric, value)."""
    sets = [(), *[(d,) for d in dims], tuple(dims)]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(F.grouping_id(*dims).alias("gid"), *[c.cast("double").alias(m) for m, c in metrics.items()])
    names = F.array_join(F.filter(F.array(*[F.when(F.col("gid").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, F.lit(d)) for i, d in enumerate(dims)]), lambda x: x.isNotNull()), "+")
    keys = F.concat_ws("|", *[F.when(F.col("gid").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, F.coalesce(F.col(d).cast("string"), F.lit("null"))) for i, d in enumerate(dims)])
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return out.select(F.when(names == "", "all").otherwise(names).alias("level"), keys.alias("key"), long.alias("r")).select("level", "key", "r.*")


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], method: str = "pearson", least: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """``(x, y, n, r, p)`` of each pair of columns: rows with both values, the correlation and its two-sided p-value; null below ``least`` rows or two distinct values on a side. Spearman ranks after
    the null rows are gone, ties at their mean."""
    cols = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), finite(F.col(x).cast("double")).alias("a"), finite(F.col(y).cast("double")).alias("b")) for x, y in pairs]
    long = df.select(*by, F.explode(F.array(*cols)).alias("r")).select(*by, "r.*").where("a is not null and b is not null")
    keys = [*by, "x", "y"]
    n, r = F.count("*"), F.corr("a", "b")
    if method == "spearman":
        # equal pairs are counted first and go on as one row; the mean of the ranks is known, so sums of centred ranks give the correlation
        long = materialize(long.groupBy(*keys, "a", "b").agg(F.count("*").alias("__w")), "pair-counts")
        sides = long.select(*keys, "__w", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("a", "b")])).alias("r")).select(*keys, "__w", "r.*")
        ranks = value_ranks(sides, "v", [*keys, "side"], "__w")  # both columns in one go
        middle = long.groupBy(*keys).agg(((F.sum("__w") + 1) / 2).alias("__middle"))
        for side in ("a", "b"):
            own = ranks.where(F.col("side") == side).select(*keys, F.col("v").alias(side), F.col("rank").alias("__rank"))
            long = long.join(materialize(own, "side-ranks"), [*keys, side]).drop(side).withColumnRenamed("__rank", side)  # written, so that a side of few values is known to be small
        long = join_small(long, middle, keys).withColumns({c: F.col(c) - F.col("__middle") for c in ("a", "b")})
        w, a, b = F.col("__w"), F.col("a"), F.col("b")
        n, r = F.sum(w), F.sum(w * a * b) / (F.sqrt(F.nullif(F.sum(w * a * a), F.lit(0.0))) * F.sqrt(F.nullif(F.sum(w * b * b), F.lit(0.0))))
    agg = long.groupBy(*keys).agg(n.alias("n"), r.alias("r"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    fine = (F.col("n") >= least) & (F.col("a0") < F.col("a1")) & (F.col("b0") < F.col("b1"))
    return agg.select(*keys, "n", F.when(fine, F.col("r")).alias("r")).withColumn("p", correlation_p(F.col("r"), F.col("n")))


QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def quantile_profile(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    out = join_small(out, quantiles(df, value, list(QUANTILES.values()), by), by, "left")
    return out.select(*by, "n", "min", *[F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)], "max", "mean")


def frequencies(df: DataFrame, column: str, by: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Values by frequency: count, share, place, and the share of the ``top`` most frequent together. One row a distinct value is ranked, not the rows."""
    n = df.groupBy(*by, column).count()
    w = Window.partitionBy(*by)
    ordered = w.orderBy(F.desc("count"), column)
    out = n.withColumn("share", F.col("count") / F.sum("count").over(w)).withColumn("place", F.row_number().over(ordered))
    return out.withColumn("top_share", F.sum(F.when(F.col("place") <= top, F.col("share")).otherwise(0.0)).over(w))


def snr(df: DataFrame, signal: str, noise: str, by: Sequence[str] = ()) -> DataFrame:
    """Ten times the log of the signal's variance over the noise's."""
    vs, vn = F.var_samp(signal), F.var_samp(noise)
    return df.groupBy(*by).agg(F.when((vs > 0) & (vn > 0), 10 * F.log10(vs / vn)).alias("snr_db"))


def mad(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median, and median absolute deviation from it."""
    med = quantiles(df, value, (0.5,), by).withColumn("median", F.col("q")[0]).drop("q")
    gaps = join_small(df, med, by).withColumn("__gap", F.abs(F.col(value) - F.col("median")))
    return join_small(med, quantiles(gaps, "__gap", (0.5,), by), by).withColumn("mad", F.col("q")[0]).drop("q")


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, missing, missing_rate)`` from one pass."""
    flat = df.agg(F.count("*").alias("__n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0)).alias("missing")) for c in columns]))
    return flat.select("__n", long.alias("r")).select("r.*", F.when(F.col("__n") > 0, F.col("r.missing") / F.col("__n")).alias("missing_rate"))


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10, floor: float = 1e-6, digits: int = 9) -> DataFrame:
    """Population stability of each feature: shares of the reference's quantile bins on both sides, with a floor; values beyond the edges don't count, the last
    bin is closed."""
    r, c = (unpivot(d, [], features).where("value is not null and not isnan(value)") for d in (reference, current))
    cuts = edges(r, "value", [i / bins for i in range(bins + 1)], ["feature"], digits)

    def shares(d: DataFrame, name: str) -> DataFrame:
        e = F.col("edges")
        n = F.size(F.filter(e, lambda x: x <= F.col("value")))
        at = F.when((F.col("value") >= F.element_at(e, 1)) & (F.col("value") <= F.element_at(e, -1)), F.least(n, F.size(e) - 1))
        counted = d.join(cuts, "feature").withColumn("bin", at).groupBy("feature", "bin").count()
        total = F.sum("count").over(Window.partitionBy("feature"))
        return counted.where("bin is not null").withColumn(name, F.col("count") / total).select("feature", "bin", name)

    grid = cuts.select("feature", F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("bin"))
    joined = grid.join(shares(r, "h"), ["feature", "bin"], "left").join(shares(c, "f"), ["feature", "bin"], "left")
    h, f = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(floor)) for x in ("h", "f"))
    return joined.groupBy("feature").agg(F.sum((f - h) * F.ln(f / h)).alias("psi"))


def drift(reference: DataFrame, current: DataFrame, features: Sequence[str], most_outside: float = 0.20) -> DataFrame:
    """Quantiles of both sides, the share of current values outside the reference's 1% to 99% range, and whether that is within support."""
    r, c = (unpivot(d, [], features).where("value is not null and not isnan(value)") for d in (reference, current))
    base = quantiles(r, "value", (0.01, 0.5, 0.99), ["feature"])
    now = quantiles(c, "value", (0.5,), ["feature"]).select("feature", F.col("q")[0].alias("current_median"))
    seen = c.join(base, "feature").groupBy("feature").agg(F.count("*").alias("n"), F.avg(((F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[2])).cast("int")).alias("outside_rate"))
    return base.join(seen, "feature", "left").join(now, "feature", "left").select("feature", F.col("q")[0].alias("q01"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q99"), "n", "current_median", "outside_rate", (F.col("outside_rate") <= most_outside).alias("within_support"))


def long_to_wide(df: DataFrame, key: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).pivot(name, list(names)).agg(F.avg(value))


def hinge_search(df: DataFrame, x: str, y: str, candidates: int = 71, by: Sequence[str] = (), high: str | None = None, least: int = 50, least_side: int = 30) -> DataFrame:
    """Least squares of y on 1, x and max(0, x - c) for each candidate threshold c among the quantiles .15 to .85 of x, in groups of ``least`` rows or more. Gives the
    candidate of least error among those with ``least_side`` rows on either side (``supported``; among all where none has), beside the straight line: ``baseline_sse`` and
    ``delta_aic``, the line's n ln(sse / n) + 2 parameters less the bent one's. ``high``, a 0/1 column, adds its rates before and after the threshold and their difference.

    Each row is put into the bin between two candidates, and one aggregation of the bins' moments serves all candidates: their sums are those of the bins above."""
    flag = F.col(high).cast("double") if high else F.lit(None).cast("double")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), flag.alias("__high"))
    base = materialize(join_small(quantiles(rows, "x", [0.15 + 0.7 * i / (candidates - 1) for i in range(candidates)], by).withColumn("cs", F.array_distinct("q")).drop("q"), rows.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), by), "hinge-candidates")  # a row a group, read twice
    each = join_small(rows, base, by).withColumn("__k", F.lit(0))
    for step in (1 << j for j in reversed(range(candidates.bit_length()))):  # candidates below x, which ascend, by halves: a function on arrays would be interpreted for each of them
        each = each.withColumn("__k", F.col("__k") + F.when(F.get("cs", F.col("__k") + (step - 1)) < F.col("x"), step).otherwise(0))
    each = each.select(*by, "__k", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"), "__high")
    sums = {"n": F.count("*"), "u": F.sum("u"), "v": F.sum("v"), "uu": F.sum(F.col("u") * F.col("u")), "uv": F.sum(F.col("u") * F.col("v")), "vv": F.sum(F.col("v") * F.col("v")), "flags": F.sum("__high"), "flagged": F.count("__high")}
    bins = each.groupBy(*by, "__k").agg(*[c.alias(f"__{k}") for k, c in sums.items()])
    met = join_small(bins, base, by).select("*", F.posexplode("cs").alias("__i", "c")).withColumn("__d", F.col("c") - F.col("mx"))  # a row a bin and candidate
    m = {k: F.col(f"__{k}") for k in sums}
    d = F.col("__d")
    past = F.col("__k") > F.col("__i")
    after = lambda c: F.sum(F.when(past, c).otherwise(0))
    rate = lambda side: F.try_divide(F.sum(F.when(side, m["flags"])), F.sum(F.when(side, m["flagged"])))
    s = met.groupBy(*by, "c", "mx", "my").agg(
        F.sum("__n").alias("n"), after(m["n"]).alias("n_after"), after(m["u"] - m["n"] * d).cast("double").alias("sh"), F.sum("__uu").alias("suu"), after(m["uu"] - d * m["u"]).cast("double").alias("suh"),
        after(m["uu"] - 2 * d * m["u"] + m["n"] * d * d).cast("double").alias("shh"), F.sum("__uv").alias("suv"), after(m["uv"] - d * m["v"]).cast("double").alias("shv"), F.sum("__vv").alias("svv"),
        rate(~past).alias("high_before"), rate(past).alias("high_after"),
    ).where(F.col("n") >= least)
    hh = F.col("shh") - F.col("sh") * F.col("sh") / F.col("n")  # centred h; u and v are centred already
    det = F.col("suu") * hh - F.col("suh") * F.col("suh")
    b = (F.col("suv") * hh - F.col("shv") * F.col("suh")) / det
    d = (F.col("shv") * F.col("suu") - F.col("suv") * F.col("suh")) / det
    fit = s.where(det > 1e-9 * F.col("suu") * hh).withColumns({"slope_before": b, "bend": d, "n_before": F.col("n") - F.col("n_after")})
    sse = F.col("svv") - F.col("slope_before") * F.col("suv") - F.col("bend") * F.col("shv")
    fit = fit.withColumns({"sse": sse, "baseline_sse": F.col("svv") - F.col("suv") * F.col("suv") / F.col("suu"), "supported": F.least("n_before", "n_after") >= least_side})
    out = ["c", "slope_before", "bend", "sse", "baseline_sse", "n", "n_before", "n_after", "supported", "high_before", "high_after"]
    best = fit.groupBy(*by).agg(F.min_by(F.struct(*out), F.struct(~F.col("supported"), "sse", "c")).alias("b")).where("b is not null").select(*by, "b.*")
    part = lambda c: F.ln(F.greatest(F.col(c) / F.col("n"), F.lit(1e-12)))
    rates = ["high_before", "high_after", (F.col("high_after") - F.col("high_before")).alias("high_delta")] if high else []
    return best.select(*by, F.col("c").alias("threshold"), "slope_before", (F.col("slope_before") + F.col("bend")).alias("slope_after"), "sse", "baseline_sse",
        (F.col("n") * (part("baseline_sse") - part("sse")) - 2).alias("delta_aic"), "n_before", "n_after", "supported", *rates)


def bootstrap_thresholds(df: DataFrame, x: str, y: str, rounds: int = 50, seed: int = 0, candidates: int = 21) -> DataFrame:
    """The hinge threshold of ``rounds`` resamples. A row's weight in a resample is a Poisson(1) count drawn from a hash of row and round, so
    resamples need no passes of their own and reruns agree; rows are repeated by their counts. ``df`` needs a column that tells its rows apart, such as an id, as equal
    rows are drawn alike."""
    rows = df.select(F.xxhash64(*df.columns).alias("__k"), x, y).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = (F.pmod(F.xxhash64("__k", "round", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    steps, chance, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += chance
        steps.append(total)
        chance /= k + 1
    count = sum(((u > t).cast("int") for t in steps), F.lit(0))
    drawn = rows.withColumn("__n", count).where("__n > 0").withColumn("__rep", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return hinge_search(drawn, x, y, candidates, ["round"]).select("round", "threshold")


def time_summary(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Span, rows, distinct times and quantiles of the interval between neighbours."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = df.withColumn("gap", (us - F.lag(us).over(Window.partitionBy(*by).orderBy(ts))) / 1e6)
    return gaps.groupBy(*by).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(ts).alias("n_times"), F.percentile("gap", F.lit(0.5)).alias("gap_median"), F.percentile("gap", F.lit(0.95)).alias("gap_q95"))


def match_rates(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """``(feature, n, match_rate)``: equal within the tolerance, null equals null; rows on one side only don't match."""
    e, a = (d.select(key, *[F.col(c).alias(f"{p}_{c}") for c in columns]).withColumn(p, F.lit(True)) for d, p in ((expected, "e"), (actual, "a")))
    both = e.join(a, key, "full")
    kinds = dict(expected.dtypes)
    same = {}
    for c in columns:
        x, y = F.col(f"e_{c}"), F.col(f"a_{c}")
        close = (F.abs(x - y) <= tolerance) if kinds[c] in ("double", "float") else F.lit(False)
        same[c] = F.coalesce(F.col("e") & F.col("a") & (x.eqNullSafe(y) | F.coalesce(close, F.lit(False))), F.lit(False))
    flat = both.agg(F.count("*").alias("__n"), *[F.avg(s.cast("int")).alias(c) for c, s in same.items()])
    return flat.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("match_rate")) for c in columns])).alias("r")).select("r.feature", F.col("__n").alias("n"), "r.match_rate")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# Weights and ranks of rule grades.
GRADES = {"A": 3.0, "B": 2.0, "C": 1.0}
GRADE_RANKS = {"A": 0, "B": 1, "C": 2}


def by_grade(values: Mapping[str, float], other: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("grade")], F.lit(other))


def rule_priority() -> list[Column]:
    """What puts one matched rule before another: grade, stability, samples, lift of the ok rate, least rise of the high rate, then its id."""
    fine = F.coalesce(F.col("time_stable"), F.lit(True))
    return [by_grade(GRADE_RANKS, 9).alias("g"), (~fine).cast("int").alias("t"), (-F.coalesce("sample_count", F.lit(0))).cast("double").alias("n"), (-F.coalesce("ok_lift", F.lit(0.0))).alias("lift"), F.coalesce("high_delta", F.lit(0.0)).alias("worse"), F.col("rule_id")]


def combine_rules(matches: DataFrame) -> DataFrame:
    """Bands of the rules matched by each ``id``: median, weighted mean, intersection (else the top rule's band) and top rule; evidence medians. ``matches`` has id, rule_id,
    grade, time_stable, dose_min, dose_max, sample_count, ok_rate, ok_lift, high_delta, low_delta. A rule weighs grade x log of its samples x lift over what it worsens; rules without a
    band don't count."""
    worse = 1 + 10 * F.greatest(F.coalesce("high_delta", F.lit(0.0)), F.lit(0.0)) + 20 * F.greatest(F.coalesce("low_delta", F.lit(0.0)), F.lit(0.0))
    weight = by_grade(GRADES, 0.5) * F.log1p(F.greatest(F.coalesce("sample_count", F.lit(0)), F.lit(0)).cast("double")) * F.greatest(F.coalesce("ok_lift", F.lit(0.0)), F.lit(0.001)) / worse
    m = matches.where("dose_min is not null and dose_max is not null").withColumn("weight", F.greatest(weight, F.lit(1e-9)))
    out = m.groupBy("id").agg(
        F.count("*").alias("n_rules"), F.percentile("dose_min", F.lit(0.5)).alias("median_min"), F.percentile("dose_max", F.lit(0.5)).alias("median_max"),
        (F.sum(F.col("weight") * F.col("dose_min")) / F.sum("weight")).alias("weighted_min"), (F.sum(F.col("weight") * F.col("dose_max")) / F.sum("weight")).alias("weighted_max"),
        F.max("dose_min").alias("common_min"), F.min("dose_max").alias("common_max"), F.min_by(F.struct("rule_id", "dose_min", "dose_max"), F.struct(*rule_priority())).alias("top"),
        F.percentile("sample_count", F.lit(0.5)).cast("int").alias("evidence_samples"), F.percentile("ok_rate", F.lit(0.5)).alias("evidence_ok_rate"), F.array_join(F.array_sort(F.collect_set("rule_id")), ";").alias("rule_ids"),
    )  # fmt: skip  # a row has at most one rule a feature and bin, so its groups are small
    meets = F.col("common_min") <= F.col("common_max")
    return out.select(
        "id", "n_rules", "rule_ids", "median_min", "median_max", ((F.col("median_min") + F.col("median_max")) / 2).alias("median_target"), "weighted_min", "weighted_max",
        F.when(meets, F.col("common_min")).otherwise(F.col("top.dose_min")).alias("intersection_min"), F.when(meets, F.col("common_max")).otherwise(F.col("top.dose_max")).alias("intersection_max"),
        F.col("top.rule_id").alias("top_rule"), F.col("top.dose_min").alias("top_min"), F.col("top.dose_max").alias("top_max"), "evidence_samples", "evidence_ok_rate",
    )


def group_delta(df: DataFrame, group: str, left: str, right: str, metric: str) -> DataFrame:
    """The metric of one group minus another's, from a table with a row for each group."""
    pick = lambda g: F.max(F.when(F.col(group) == g, F.col(metric)))
    return df.agg((pick(left) - pick(right)).alias("delta"))


def bin_rate_spread(df: DataFrame, by: Sequence[str], bin_col: str, flag: str) -> DataFrame:
    per = df.where(F.col(bin_col).isNotNull()).groupBy(*by, bin_col).agg(F.avg(flag).alias("rate"))
    return per.groupBy(*by).agg((F.max("rate") - F.min("rate")).alias("spread"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """F statistic of the group means, from sums of each group, and its p-value."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    all_ = g.agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.count("*").alias("k"))
    parts = g.crossJoin(F.broadcast(all_)).groupBy("nn", "k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mm"), 2)).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    out = parts.select(F.col("k").alias("groups"), F.col("nn").alias("n"), ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("nn") - F.col("k")))).alias("f"))
    return out.withColumn("p", f_p(F.col("f"), F.col("groups") - 1, F.col("n") - F.col("groups")))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis statistic, corrected for ties, and its p-value."""
    v = value_ranks(df, value)
    r = df.join(v.select(value, "rank"), value).groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("s"))
    ties = v.agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("t"), F.sum("count").alias("nn"))
    h = r.crossJoin(F.broadcast(ties)).groupBy("nn", "t").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count("*").alias("k"))
    nn = F.col("nn").cast("double")
    out = h.select(F.col("k").alias("groups"), ((12 / (nn * (nn + 1)) * F.col("q") - 3 * (nn + 1)) / (1 - F.col("t") / (nn * nn * nn - nn))).alias("h"))
    return out.withColumn("p", chi2_p(F.col("h"), F.col("groups") - 1))


def binned(df: DataFrame, column: str, cuts: Column, out: str = "bin") -> DataFrame:
    return df.withColumn(out, right_closed(F.col(column), cuts))
