"""Rules: mined from binned doses by regime, applied to rows, and validated on later ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.bins import qcut, tertile_boundaries
from quernel.functions.scalars import action_hint, band_position, finite, label_flags
from quernel.operators.aggregates import best_bin, correlations, dose_response, hinge_search, rule_priority, unpivot
from quernel.operators.joins import rule_matches
from quernel.operators.series import chronological_split, join_small, quantiles_of
from quernel.sources.shared import materialize


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first case that holds."""
    out = F.lit(otherwise)
    for cond, name in reversed(cases):
        out = F.when(cond, name).otherwise(out)
    return out


def regime_rows(df: DataFrame, features: Sequence[str], dose: str, label: str) -> DataFrame:
    """A row for each input row and regime feature: ``(id, feature, bin, dose, label, flags)``, bins by the features' tertiles."""
    bounds = tertile_boundaries(df, features)
    long = unpivot(df.select("id", F.col(dose).cast("double").alias("dose"), F.col(label).cast("double").alias("label"), *[c for c in features]), ["id", "dose", "label"], features, value="x").where("x is not null")
    level = F.when(F.col("x") <= F.col("q33"), "low").when(F.col("x") <= F.col("q66"), "mid").otherwise("high")
    out = long.join(F.broadcast(bounds), "feature").withColumn("regime", level)  # one row a feature
    return out.select("id", "feature", "regime", "dose", "label").withColumns(label_flags(F.col("label")))


def regime_response(df: DataFrame, features: Sequence[str], dose: str, label: str, bins: int = 5) -> DataFrame:
    """Dose response inside each regime, doses binned by the regime's own quantiles."""
    rows = regime_rows(df, features, dose, label).where("dose is not null")
    return dose_response(qcut(rows, "dose", bins, ["feature", "regime"]), "bin", "dose", "label", ["feature", "regime"])


def pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], dose: str, label: str) -> DataFrame:
    """As ``regime_rows``, with a row for each input row and pair of features: the regime is both features' tertile bins. Rows without one of the two features don't count."""
    names = sorted({f for p in pairs for f in p})
    entry = lambda f: F.max(F.when(F.col("feature") == f, F.struct("q33", "q66"))).alias(f"__b_{f}")
    bounds = tertile_boundaries(df, names).agg(*[entry(f) for f in names])  # one row
    rows = df.crossJoin(F.broadcast(bounds))

    def level(f: str) -> Column:
        x, b = F.col(f).cast("double"), F.col(f"__b_{f}")
        return F.when(x <= b["q33"], "low").when(x <= b["q66"], "mid").when(x.isNotNull(), "high")

    each = [F.struct(F.lit(f"{a}__x__{b}").alias("feature"), F.concat(level(a), F.lit("__x__"), level(b)).alias("regime")) for a, b in pairs]
    out = rows.select("id", F.explode(F.array(*each)).alias("r"), F.col(dose).cast("double").alias("dose"), F.col(label).cast("double").alias("label")).where("r.regime is not null")
    return out.select("id", "r.feature", "r.regime", "dose", "label").withColumns(label_flags(F.col("label")))


def regime_summary(rows: DataFrame, least: int = 30, candidates: int = 71) -> DataFrame:
    """A row for each regime of ``regime_rows`` or ``pair_rows`` with ``least`` rows that have dose and label: medians, quartile ranges, rates, rank correlations of the dose with the
    label and with its high flag, the hinge threshold of regimes of 120 rows or more, and what these support. Correlations and thresholds that can't be had are null."""
    keys = ["feature", "regime"]
    rows = materialize(rows.where("dose is not null and label is not null"), "regime-rows")  # read some ten times
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("label").alias("label_mean"), *[F.avg(f"y_{k}").alias(f"{k}_rate") for k in ("ok", "high", "low", "out_spec")]).where(F.col("n") >= least)
    q = quantiles_of(rows, ["dose", "label"], (0.25, 0.5, 0.75), keys)
    out = join_small(out, q.select(*keys, *[x for c in ("dose", "label") for x in (F.col(c)[1].alias(f"{c}_median"), (F.col(c)[2] - F.col(c)[0]).alias(f"{c}_iqr"))]), keys)
    r = correlations(rows, [("dose", "label"), ("dose", "y_high")], "spearman", by=keys)
    pick = lambda y, name: F.max(F.when(F.col("y") == y, F.col("r"))).alias(name)
    out = join_small(out, r.groupBy(*keys).agg(pick("label", "spearman_label"), pick("y_high", "spearman_high")), keys, "left")
    bend = hinge_search(rows, "dose", "label", candidates, keys, high="y_high", least=120)
    out = join_small(out, bend.select(*keys, "threshold", "slope_before", "slope_after", "delta_aic", "high_before", "high_after", "high_delta"), keys, "left")
    risk = F.coalesce(F.col("high_delta") >= 0.05, F.lit(False))
    return out.withColumns({
        "positive_relation": F.coalesce(F.col("spearman_label") > 0.05, F.lit(False)), "high_dose_risk": risk,
        "threshold_supported": risk & F.coalesce(F.col("delta_aic") > 2, F.lit(False)), "stable_support": F.col("n") >= 120,
    })


def synthesize(summary: DataFrame) -> DataFrame:
    """One row: how many regimes of ``regime_summary`` support a positive relation, a risk of high doses and a threshold, how many contradict (120 rows, correlation under -0.05),
    the type of relation and the next step that follow. Without regimes the support is insufficient."""
    number = lambda c: F.count(F.when(c, 1))
    n = summary.agg(
        F.count("*").alias("regimes"), number(F.col("positive_relation")).alias("positive"), number(F.col("high_dose_risk")).alias("high_dose_risk"), number(F.col("threshold_supported")).alias("threshold"),
        number((F.col("n") >= 120) & (F.coalesce("spearman_label", F.lit(0.0)) < -0.05)).alias("contradictory"),
    )
    none = F.col("regimes") == 0
    broad = (F.col("threshold") >= 5) & (F.col("positive") >= 10)
    local = (F.col("high_dose_risk") >= 5) | (F.col("threshold") >= 3)
    # fixed values: types of relation, next steps
    relation = first_match([(none, "insufficient_support"), (broad, "broadly_consistent"), (local, "context_specific")], "weak_or_unstable")
    step = first_match([
        (none, "insufficient_data"), (broad, "use_relation_as_supporting_evidence_for_safe_band"), (local, "investigate_context_specific_thresholds"),
        (F.col("positive") >= 5, "update_manual_review_explanation_with_high_calcium_risk"),
    ], "relation_weak_keep_safe_band_empirical")
    return n.withColumns({"relation_type": relation, "next_step": step})


ACCEPTED, MONITORED, REJECTED = "accept_for_manual_case_review", "monitor_only", "reject"


# What a risk note says that rules a regime out.
RISK_WORDS = ("high_t90_risk", "low_t90_risk")


def mine_rules(df: DataFrame, features: Sequence[str], dose: str, label: str, order: Sequence[str], bins: int = 5, least: int = 20, suspicious: Sequence[str] = (), notes: DataFrame | None = None) -> DataFrame:
    """The best dose bin of each regime as a rule, graded by its samples and how its rates differ from those of all rows, and held against the last fifth of the rows.

    Grades need 100 rows, a lift of 0.05 and no rise of the high rate (A), 80 rows and 0.03 (B), or 50 rows and any lift (C); A and B are accepted, C is monitored. ``time_stable``: the
    rule's last rows (10 at least) have an ok rate no lower than all last rows and high and low rates at most 0.02 above. An accepted rule that is worse there, or
    has too few rows there, is only monitored. ``avoid_high_dose`` marks regimes whose highest bin has a raised high rate.

    Features whose interaction with the dose is ``suspicious`` (see ``interaction_audit``) earn no A. A regime with a risk note, ``(feature, regime, note)`` rows that hold one of RISK_WORDS, is rejected.
    ``evidence`` says why a rule has its grade before the last rows are looked at.
    """
    flagged = df.withColumns(label_flags(F.col(label)))
    response = regime_response(df, features, dose, label, bins)
    best = best_bin(response, ["feature", "regime"], least).select("feature", "regime", "bin")
    rate = lambda c, name: F.avg(c).alias(name)
    every = flagged.agg(rate("y_ok", "all_ok"), rate("y_high", "all_high"), rate("y_low", "all_low"))
    highest = response.groupBy("feature", "regime").agg(F.max_by(F.struct(F.col("n").alias("n"), F.col("y_high_rate").alias("high")), "bin").alias("last"))
    out = best.join(response, ["feature", "regime", "bin"]).join(highest, ["feature", "regime"]).crossJoin(F.broadcast(every))  # one row
    lift, high, low, n = F.col("y_ok_rate") - F.col("all_ok"), F.col("y_high_rate") - F.col("all_high"), F.col("y_low_rate") - F.col("all_low"), F.col("n")
    noted = F.lit(False)
    if notes is not None:
        risks = notes.where(" or ".join(f"contains(note, '{w}')" for w in RISK_WORDS)).select("feature", "regime").distinct().withColumn("noted", F.lit(True))
        out, noted = out.join(risks, ["feature", "regime"], "left"), F.coalesce(F.col("noted"), F.lit(False))
    plain = ~F.col("feature").isin(*suspicious) if suspicious else F.lit(True)
    # fixed values: the limits of the grades and the words of the evidence
    cases = [
        (n < 50, "Reject", "insufficient support"), (high > 0.05, "Reject", "high-T90 risk worsens"), (low > 0.03, "Reject", "low-T90 risk worsens"), (noted, "Reject", "risk note indicates elevated risk"),
        ((n >= 100) & (lift >= 0.05) & (high <= 0) & (low <= 0.01) & plain, "A", "strong historical regime band"),
        ((n >= 80) & (lift >= 0.03) & (high <= 0.02) & (low <= 0.02), "B", "moderate historical regime band"),
        (lift > 0, "C", "positive but weaker historical regime band"),
    ]
    grade = first_match([(when, name) for when, name, _ in cases], "Reject")
    evidence = first_match([(when, why) for when, _, why in cases], "unstable or contradictory evidence")
    risky = (F.col("last.high") >= F.col("all_high") + 0.05) & (F.col("last.high") >= F.col("y_high_rate") + 0.05)
    rules = out.select(F.concat_ws(":", "feature", "regime").alias("rule_id"), "feature", F.col("regime").alias("bin"), "dose_min", "dose_max", grade.alias("grade"), n.cast("int").alias("sample_count"),
        F.col("y_ok_rate").alias("ok_rate"), F.col("y_high_rate").alias("high_rate"), F.col("y_low_rate").alias("low_rate"), lift.alias("ok_lift"), high.alias("high_delta"), low.alias("low_delta"), (risky & (F.col("last.n") >= 20)).alias("avoid_high_dose"), evidence.alias("evidence"))

    late = chronological_split(flagged, [], order).where("split = 'test'")
    overall = late.agg(rate("y_ok", "late_all_ok"), rate("y_high", "late_all_high"), rate("y_low", "late_all_low"))
    inside = rule_matches(late, rules, tertile_boundaries(df, features), features).select("id", "rule_id", "dose_min", "dose_max")
    inside = inside.join(late.select("id", F.col(dose).cast("double").alias("dose"), "y_ok", "y_high", "y_low"), "id").where(F.col("dose").between(F.col("dose_min"), F.col("dose_max")))
    seen = inside.groupBy("rule_id").agg(F.count("*").alias("late_n"), rate("y_ok", "late_ok"), rate("y_high", "late_high"), rate("y_low", "late_low"))
    held = rules.join(seen, "rule_id", "left").crossJoin(F.broadcast(overall))  # one row
    few = F.coalesce(F.col("late_n"), F.lit(0)) < 10
    ok, worse_high, worse_low = F.col("late_ok") - F.col("late_all_ok"), F.col("late_high") - F.col("late_all_high"), F.col("late_low") - F.col("late_all_low")
    unstable = F.coalesce(~few & (ok < 0) & ((worse_high > 0) | (worse_low > 0)), F.lit(False))
    stable = F.coalesce(~few & (ok >= 0) & (worse_high <= 0.02) & (worse_low <= 0.02), F.lit(False))
    accepted = F.col("grade").isin("A", "B")
    status = first_match([(F.col("grade") == "Reject", REJECTED), (accepted & ~few & ~unstable, ACCEPTED)], MONITORED)
    held = held.withColumns({"few_late": few, "unstable": unstable, "time_stable": stable, "status": status, "grade": F.when(accepted & unstable, "C").otherwise(F.col("grade"))})
    return held.select("rule_id", "feature", "bin", "dose_min", "dose_max", "grade", "status", "time_stable", "unstable", F.col("few_late").alias("few_late_rows"), "sample_count", "ok_rate", "high_rate", "low_rate", "ok_lift", "high_delta", "low_delta", "avoid_high_dose", "evidence")


def risk_context(df: DataFrame, features: Sequence[str], context: str, label: str, least_share: float = 0.30, least: int = 10, spread: float = 0.05) -> DataFrame:
    """What another measurement, which few rows have, tells inside each regime: ``(feature, regime, available_rate, context_mean, context_median, tertiles, least_rows, high_spread, out_spread, available,
    useful, low_support)``. Rows of a regime are cut into tertiles of ``context`` there; spreads are between the highest and the lowest rate of the tertiles. It is of use if ``least_share`` of the rows
    have it, each tertile has ``least`` rows and a spread reaches ``spread``. Regimes without the measurement have null spreads."""
    rows = regime_rows(df.withColumn("__context", finite(F.col(context).cast("double"))), features, "__context", label).where("label is not null").withColumnRenamed("dose", "context")
    keys = ["feature", "regime"]
    base = rows.groupBy(*keys).agg(F.avg(F.col("context").isNotNull().cast("int")).alias("available_rate"), F.avg("context").alias("context_mean"))
    base = join_small(base, quantiles_of(rows, ["context"], (0.5,), keys).select(*keys, F.col("context")[0].alias("context_median")), keys, "left")
    parts = qcut(rows.where("context is not null"), "context", 3, keys).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("y_high").alias("high"), F.avg("y_out_spec").alias("out"))
    spreads = parts.groupBy(*keys).agg(F.count("*").cast("int").alias("tertiles"), F.min("n").alias("least_rows"), (F.max("high") - F.min("high")).alias("high_spread"), (F.max("out") - F.min("out")).alias("out_spread"))
    out = join_small(base, spreads, keys, "left").fillna(0, ["tertiles", "least_rows"])
    available = F.col("available_rate") >= least_share
    useful = F.coalesce(available & (F.col("least_rows") >= least) & ((F.col("high_spread") >= spread) | (F.col("out_spread") >= spread)), F.lit(False))
    return out.withColumns({"available": available, "useful": useful, "low_support": ~useful})


# Outcomes of an interaction's audit.
STABLE, SUSPICIOUS, FEW_POSITIVES, NOT_PASSED = "stable_candidate", "suspicious_large_delta", "insufficient_positive_support", "rejected"


def interaction_audit(interactions: DataFrame, regimes: DataFrame, large: float = 0.25, positives: int = 10, least: int = 120, ok_rate: float = 0.90) -> DataFrame:
    """Adds ``positive_count``, ``supported`` and ``status`` to interactions ``(feature, target, delta_auc, delta_ap, passed, positive_rate, n)``. One that passed its screen is a stable candidate unless the
    test rows hold too few positives, or its gain is suspiciously large and no regime of its feature with ``least`` rows has an ok rate of ``ok_rate``. ``regimes`` has feature, n and ok_rate."""
    known = regimes.where((F.col("n") >= least) & (F.col("ok_rate") >= ok_rate)).select("feature").distinct().withColumn("supported", F.lit(True))
    out = interactions.join(known, "feature", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))
    count = F.col("positive_rate") * F.col("n")
    few = F.coalesce(count < positives, F.lit(False))
    high = F.coalesce(F.col("delta_auc") > large, F.lit(False)) | F.coalesce(F.col("delta_ap") > large, F.lit(False))
    passed = F.coalesce(F.col("passed"), F.lit(False))
    return out.withColumns({"positive_count": count, "status": first_match([(passed & ~few & (~high | F.col("supported")), STABLE), (high, SUSPICIOUS), (few, FEW_POSITIVES)], NOT_PASSED)})


def _median(xs: Column) -> Column:
    """Median of a small array's values that aren't null."""
    xs = F.array_sort(F.filter(xs, lambda x: x.isNotNull()))
    n = F.size(xs)
    return F.when(n > 0, (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2)


CARRIED = ("grade", "dose_min", "dose_max", "ok_rate", "high_rate", "low_rate", "sample_count", "ok_lift", "high_delta", "low_delta")


def _advised(rows: DataFrame) -> DataFrame:
    """``rows`` (with dose, and ``all``, the matched rules in the order of ``rule_priority``, null if there are none) with the band of their best rules. No joins, no grouping."""
    out = rows.withColumn("best", F.col("all")[0])
    out = out.withColumn("chosen", F.filter("all", lambda r: (r["g"] == F.col("best.g")) & (r["t"] == F.col("best.t"))))
    mid = lambda c: _median(F.transform("chosen", lambda r: r[c].cast("double")))
    b = lambda c: F.coalesce(F.col(f"best.{c}").cast("double"), F.lit(0.0))
    confidence = first_match([
        ((F.col("best.grade") == "A") & (b("sample_count") >= 100) & (b("ok_lift") >= 0.05) & (b("high_delta") <= 0) & (b("low_delta") <= 0.01), "high"),
        (F.col("best.grade").isin("A", "B") & (b("sample_count") >= 80) & (b("ok_lift") >= 0.03), "medium"),
    ], "low")
    known = F.col("all").isNotNull()
    when = lambda c: F.when(known, c)
    out = out.withColumns({
        "n_rules": when(F.size("all")), "n_selected": when(F.size("chosen")), "selected_rule_ids": when(F.array_join(F.transform("chosen", lambda r: r["rule_id"]), ";")), "rec_min": mid("dose_min"), "rec_max": mid("dose_max"),
        "evidence_ok_rate": mid("ok_rate"), "evidence_high_rate": mid("high_rate"), "evidence_low_rate": mid("low_rate"), "evidence_samples": mid("sample_count").cast("int"), "confidence": F.when(known, confidence).otherwise("none"),
    })
    out = out.withColumn("rec_target", (F.col("rec_min") + F.col("rec_max")) / 2)
    position = F.when(F.col("n_rules").isNull(), "not_recommended").otherwise(band_position(F.col("dose"), F.col("rec_min"), F.col("rec_max")))
    status = first_match([(F.col("n_rules").isNull(), "no_recommendation"), (F.col("dose").isNull(), "no_recommendation_missing_current_dose")], "recommended")
    return out.withColumn("position", position).withColumns({"action": action_hint(F.col("position")), "status": status}).drop("all", "best", "chosen")


def recommend(rows: DataFrame, rules: DataFrame, boundaries: DataFrame, features: Sequence[str], dose: str) -> DataFrame:
    """Every row with the band of its best rules. Of the accepted rules that match, those of the best grade and stability are selected; the band and the evidence are their
    medians, the confidence is that of the first by ``rule_priority``. Rows that no rule matches, or without a dose, are to be held or checked."""
    matched = rule_matches(rows, rules.where(F.col("status") == ACCEPTED), boundaries, features)
    # a row has at most one rule a feature and bin, so its list is short
    lists = matched.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*rule_priority(), *CARRIED))).alias("all"))
    return _advised(rows.select("id", F.col(dose).cast("double").alias("dose")).join(lists, "id", "left"))


def advise(rows: DataFrame, rules: DataFrame, boundaries: DataFrame, features: Sequence[str], dose: str) -> DataFrame:
    """``recommend`` for rows of any columns, which are kept, without a key, a join of rows or a shuffle, so for streams too: the accepted rules, a few for each feature, are one row
    that is broadcast, and each row picks its own from it. ``dose`` is added as a number; columns of ``rows`` that have the names of results are replaced."""
    kept = rules.where(F.col("status") == ACCEPTED).join(F.broadcast(boundaries.select("feature", "q33", "q66")), "feature").where(F.col("feature").isin(*features))
    table = kept.agg(F.array_sort(F.collect_list(F.struct(*rule_priority(), *CARRIED, "feature", "bin", "q33", "q66"))).alias("all"))
    values = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(f"`{f}`").cast("double") for f in features]))

    def matches(r: Column) -> Column:
        x = F.element_at(F.col("__values"), r["feature"])
        return F.coalesce(F.when(x <= r["q33"], "low").when(x <= r["q66"], "mid").when(x.isNotNull(), "high") == r["bin"], F.lit(False))

    out = rows.withColumn("__values", values).withColumn("dose", F.col(f"`{dose}`").cast("double")).drop("all").crossJoin(F.broadcast(table))  # one row
    out = out.withColumn("all", F.filter("all", matches)).withColumn("all", F.when(F.size("all") > 0, F.col("all")))
    return _advised(out.drop("__values"))


def score(rows: DataFrame, rules: DataFrame, boundaries: DataFrame, features: Sequence[str], dose: str, status: str = "status") -> DataFrame:
    """``recommend`` with a fail-safe envelope: rows without a dose or without any feature get status 100, others 0."""
    lacking = F.col(dose).isNull() | F.coalesce(*features).isNull()
    return recommend(rows, rules, boundaries, features, dose).drop(status).join(rows.select("id", F.when(lacking, 100).otherwise(0).alias(status)), "id")


def oracle_bands(test: DataFrame, rules: DataFrame, boundaries: DataFrame, features: Sequence[str], dose: str, label: str, bins: int = 5, least: int = 10) -> DataFrame:
    """For each rule, the best dose bin of the test rows in its regime, computed once a rule: ``(rule_id, oracle_min, oracle_max, oracle_ok, acceptable)``. Best is the highest ok rate, then
    the lowest high and low rates, then the most rows; ``acceptable`` lists the bands that are hardly worse."""
    hits = rule_matches(test, rules, boundaries, features).select("id", "rule_id")
    rows = hits.join(test.select("id", F.col(dose).cast("double").alias("dose"), F.col(label).alias("label")), "id").where("dose is not null").withColumns(label_flags(F.col("label")))
    response = dose_response(qcut(rows, "dose", bins, ["rule_id"]), "bin", "dose", "label", ["rule_id"]).where(F.col("n") >= least)
    order = [(-F.col("y_ok_rate")).alias("ok"), F.col("y_high_rate").alias("high"), F.col("y_low_rate").alias("low"), (-F.col("n")).alias("n"), F.col("bin")]
    per = response.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct(*order, "dose_min", "dose_max"))).alias("all")).withColumn("best", F.col("all")[0])  # ``bins`` structs
    close = F.filter("all", lambda x: (x["ok"] <= F.col("best.ok") + 0.03) & (x["high"] <= F.col("best.high") + 0.02) & (x["low"] <= F.col("best.low") + 0.01))
    return per.select("rule_id", F.col("best.dose_min").alias("oracle_min"), F.col("best.dose_max").alias("oracle_max"), (-F.col("best.ok")).alias("oracle_ok"), F.transform(close, lambda x: F.struct(x["dose_min"].alias("lo"), x["dose_max"].alias("hi"))).alias("acceptable"))


def oracle_hits(recommended: DataFrame, oracle: DataFrame) -> DataFrame:
    """Recommendations held against their first rule's oracle: half of the oracle's or of an acceptable band covered (``band_hit``), any of it (``relaxed_hit``), the same action, and
    the target within 3, 5 and 10 % of the oracle's. Rows without a recommendation or oracle keep nulls."""
    first = F.when(F.col("status") == "recommended", F.element_at(F.split("selected_rule_ids", ";"), 1))
    out = recommended.withColumn("rule_id", first).join(oracle, "rule_id", "left")
    lo, hi = F.col("rec_min"), F.col("rec_max")
    overlap = lambda a, b: F.greatest(F.lit(0.0), F.least(hi, b) - F.greatest(lo, a))
    ratios = F.transform(F.array_append("acceptable", F.struct(F.col("oracle_min").alias("lo"), F.col("oracle_max").alias("hi"))), lambda x: F.when(x["hi"] > x["lo"], overlap(x["lo"], x["hi"]) / (x["hi"] - x["lo"])))
    out = out.withColumn("__ratio", F.array_max(ratios)).withColumn("oracle_target", (F.col("oracle_min") + F.col("oracle_max")) / 2)
    off = F.abs(F.col("rec_target") - F.col("oracle_target")) / F.abs(F.nullif(F.col("oracle_target"), F.lit(0.0)))
    known = F.col("oracle_min").isNotNull()
    hit = lambda c: F.when(known, F.coalesce(c, F.lit(False)))
    return out.withColumns({
        "band_hit": hit(F.col("__ratio") >= 0.5), "relaxed_hit": hit(F.col("__ratio") > 0), "direction_hit": hit(F.col("action") == action_hint(band_position(F.col("dose"), F.col("oracle_min"), F.col("oracle_max")))),
        **{f"target_hit_{k}": hit(off <= k / 100) for k in (3, 5, 10)},
    }).drop("__ratio")


HITS = ("band_hit", "relaxed_hit", "direction_hit", "target_hit_3", "target_hit_5", "target_hit_10")


def accuracies(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, coverage and the share of each hit among the rows that have one."""
    return hits.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("status") == "recommended").cast("int")).alias("coverage"), *[F.avg(F.col(h).cast("int")).alias(h.replace("_hit", "_accuracy")) for h in HITS])


def next_step(metrics: DataFrame, cases: Sequence[tuple[Column, str]], otherwise: str) -> DataFrame:
    """A stage's decision from its one row of metrics: the first case that holds."""
    return metrics.withColumn("next_step", first_match(cases, otherwise))
