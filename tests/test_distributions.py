"""Tail probabilities against closed forms and against sums over the density."""

import math
import random

import pytest
from pyspark.sql import functions as F
from quernel.functions import distributions as D
from quernel.operators import aggregates


def simpson(f, a, b, n=20_000):
    h = (b - a) / n
    return h / 3 * (f(a) + f(b) + 4 * sum(f(a + i * h) for i in range(1, n, 2)) + 2 * sum(f(a + i * h) for i in range(2, n, 2)))


def values(spark, rows, f):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} double" for n in names))
    return [r["p"] for r in df.select("i", f(*[F.col(n) for n in names]).alias("p")).orderBy("i").collect()]


def test_log_gamma(spark):
    xs = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.6]
    got = values(spark, [(x,) for x in xs], D.log_gamma)
    assert all(math.isclose(a, math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12) for a, x in zip(got, xs, strict=True))


def test_closed_forms(spark):
    ts = [0.0, 0.1, 1.0, 3.0, 50.0]
    assert values(spark, [(t, 1) for t in ts], D.student_p) == pytest.approx([1 - 2 / math.pi * math.atan(t) for t in ts], abs=1e-12)
    assert values(spark, [(t, 2) for t in ts], D.student_p) == pytest.approx([1 - t / math.sqrt(2 + t * t) for t in ts], abs=1e-12)
    fs = [(f, d2) for f in (0.0, 0.3, 1.0, 4.0, 30.0) for d2 in (1, 5, 40, 5000)]
    assert values(spark, fs, lambda f, d2: D.f_p(f, F.lit(2.0), d2)) == pytest.approx([(1 + 2 * f / d2) ** (-d2 / 2) for f, d2 in fs], abs=1e-12, rel=1e-9)
    assert values(spark, fs, lambda f, d2: D.f_p(f, F.lit(4.0), d2)) == pytest.approx([(x := d2 / (d2 + 4 * f)) ** (d2 / 2) * (1 + d2 / 2 * (1 - x)) for f, d2 in fs], abs=1e-12, rel=1e-9)
    xs = [0.0, 0.2, 1.0, 3.84, 20.0, 90.0]
    assert values(spark, [(x,) for x in xs], lambda x: D.chi2_p(x, F.lit(1.0))) == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in xs], abs=1e-13, rel=1e-9)
    assert values(spark, [(x,) for x in xs], lambda x: D.chi2_p(x, F.lit(4.0))) == pytest.approx([math.exp(-x / 2) * (1 + x / 2) for x in xs], abs=1e-13, rel=1e-9)


def test_sums_over_the_density(spark):
    cases = [(x, a, b) for a, b in ((2.5, 3.5), (10.0, 1.5), (40.0, 60.0)) for x in (0.05, 0.3, 0.42, 0.9)]
    density = lambda a, b: lambda u: math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * u ** (a - 1) * (1 - u) ** (b - 1)
    assert values(spark, cases, D.beta_tail) == pytest.approx([simpson(density(a, b), 0, x) for x, a, b in cases], abs=1e-9)
    gammas = [(a, x) for a in (4.5, 30.5) for x in (0.5, 3.0, 29.0, 60.0)]
    lower = lambda a, x: simpson(lambda u: math.exp((a - 1) * math.log(u) - u - math.lgamma(a)) if u else 0.0, 0, x)
    assert values(spark, gammas, D.gamma_tail) == pytest.approx([1 - lower(a, x) for a, x in gammas], abs=1e-9)


def test_many_degrees_of_freedom(spark):
    """A million degrees are as good as normal."""
    got = values(spark, [(t, 1e6) for t in (0.5, 1.96, 4.0)], D.student_p)
    assert got == pytest.approx([math.erfc(t / math.sqrt(2)) for t in (0.5, 1.96, 4.0)], rel=2e-4)
    assert values(spark, [(1e6, 1e6)], lambda x, d: D.chi2_p(x, d))[0] == pytest.approx(0.4998, abs=1e-4)


def test_arguments_out_of_range(spark):
    df = spark.createDataFrame([(None, 3.0), (2.0, None), (-1.0, 3.0), (2.0, -1.0), (0.5, 2.0)], "x double, a double")
    got = [tuple(r) for r in df.select(D.beta_tail(F.col("x"), F.col("a"), F.lit(1.0)).alias("b"), D.gamma_tail(F.col("a"), F.col("x")).alias("g")).collect()]
    assert got[:2] == [(None, None)] * 2 and got[2] == (None, None) and got[3] == (None, None) and got[4][0] == pytest.approx(0.25)


def test_tests_of_groups_and_pairs_carry_p_values(spark):
    rng = random.Random(2)
    rows = [(g, rng.gauss(0, 1) + g * 0.2) for g in range(3) for _ in range(30)]
    df = spark.createDataFrame(rows, "g int, v double")
    a, k = aggregates.anova(df, "g", "v").first(), aggregates.kruskal(df, "g", "v").first()
    assert a["p"] == pytest.approx((1 + 2 * a["f"] / 87) ** (-87 / 2), rel=1e-9) and k["p"] == pytest.approx(math.exp(-k["h"] / 2), rel=1e-9)
    line = spark.createDataFrame([(float(x), y) for x, y in zip(range(4), (0.0, 1.0, 3.0, 2.0), strict=True)], "x double, y double")
    r = aggregates.correlations(line, [("x", "y"), ("x", "x")]).orderBy("y").collect()
    t = r[1]["r"] * math.sqrt(2 / (1 - r[1]["r"] ** 2))
    assert r[1]["p"] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12) and r[0]["p"] == pytest.approx(0.0, abs=1e-12)
