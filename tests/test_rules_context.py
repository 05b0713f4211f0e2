"""Risk context of regimes, interaction audits, and what they do to the grades of rules."""

import random
import statistics

import numpy as np
from quernel.plans import rules as R


def some(n=900):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        x, dose = rng.random(), rng.random()
        c = None if rng.random() < 0.4 else rng.random()
        rows.append((i, i, x, dose, 8.45 + (0.4 if c is not None and c > 0.66 and x < 0.3 and rng.random() < 0.7 else rng.uniform(-0.2, 0.2)), c))
    return rows


SCHEMA = "id long, t long, x double, dose double, label double, c double"


def test_risk_context_equals_brute_force(spark):
    rows = some()
    got = {r["regime"]: r for r in R.risk_context(spark.createDataFrame(rows, SCHEMA), ["x"], "c", "label").collect()}
    q33, q66 = np.quantile([r[2] for r in rows], [1 / 3, 2 / 3])
    for name, own in (("low", [r for r in rows if r[2] <= q33]), ("mid", [r for r in rows if q33 < r[2] <= q66]), ("high", [r for r in rows if r[2] > q66])):
        held = [r for r in own if r[5] is not None]
        a, b = np.quantile([r[5] for r in held], [1 / 3, 2 / 3])
        parts = [[r for r in held if r[5] <= a], [r for r in held if a < r[5] <= b], [r for r in held if r[5] > b]]
        high = [statistics.mean(r[4] > 8.7 for r in p) for p in parts]
        r = got[name]
        assert (r["tertiles"], r["least_rows"]) == (3, min(map(len, parts)))
        assert abs(r["available_rate"] - len(held) / len(own)) < 1e-9 and abs(r["context_median"] - statistics.median(x[5] for x in held)) < 1e-9
        assert abs(r["high_spread"] - (max(high) - min(high))) < 1e-9 and r["useful"] == (max(high) - min(high) >= 0.05) and r["low_support"] != r["useful"]
    assert got["low"]["useful"]


def test_regimes_without_the_measurement(spark):
    df = spark.createDataFrame([(*r[:5], None if r[2] < 0.5 else float("nan")) for r in some(60)], SCHEMA)
    for r in R.risk_context(df, ["x"], "c", "label").collect():
        assert (r["available_rate"], r["tertiles"], r["high_spread"], r["available"], r["useful"], r["low_support"]) == (0.0, 0, None, False, False, True)


def test_interaction_audit(spark):
    rows = [("a", "high", 0.1, 0.1, True, 0.5, 100), ("b", "high", 0.4, 0.1, True, 0.5, 100), ("c", "high", 0.4, 0.1, True, 0.5, 100), ("d", "high", 0.1, 0.1, True, 0.05, 100), ("e", "high", None, 0.1, False, None, 100), ("f", "high", 0.1, 0.3, False, 0.01, 100)]
    df = spark.createDataFrame(rows, "feature string, target string, delta_auc double, delta_ap double, passed boolean, positive_rate double, n long")
    regimes = spark.createDataFrame([("b", 200, 0.95), ("c", 50, 0.99), ("c", 200, 0.5)], "feature string, n long, ok_rate double")
    got = {r["feature"]: (r["status"], r["supported"]) for r in R.interaction_audit(df, regimes).collect()}
    assert got == {"a": (R.STABLE, False), "b": (R.STABLE, True), "c": (R.SUSPICIOUS, False), "d": (R.FEW_POSITIVES, False), "e": (R.NOT_PASSED, False), "f": (R.SUSPICIOUS, False)}


def test_notes_reject_and_suspicion_costs_the_a(spark):
    rng = random.Random(5)
    rows = [(i, i, x := rng.random(), d := rng.random(), 8.45 if d < 0.4 and x < 0.4 or rng.random() < 0.6 else 9.0, None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    mine = lambda **o: {r["bin"]: (r["grade"], r["status"], r["evidence"]) for r in R.mine_rules(df, ["x"], "dose", "label", ["t"], **o).collect()}
    plain = mine()
    assert plain["low"] == ("A", R.ACCEPTED, "strong historical regime band")
    assert mine(suspicious=["x"])["low"] == ("B", R.ACCEPTED, "moderate historical regime band")
    notes = spark.createDataFrame([("x", "low", "middle; high_t90_risk"), ("x", "mid", "nothing")], "feature string, regime string, note string")
    noted = mine(notes=notes)
    assert noted["low"] == ("Reject", R.REJECTED, "risk note indicates elevated risk") and noted["mid"] == plain["mid"]
