"""Local regression against plain loops, and the centred median over blocks."""

import random
import statistics

import numpy as np
import pytest
from quernel.operators import series, smooth


def brute(points, k, passes):
    points = sorted(points)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    n, k = len(xs), min(k, len(xs))
    robust = [1.0] * n
    for nth in range(passes + 1):
        fits = []
        for i in range(n):
            lo = 0
            while lo + k < n and xs[lo] + xs[lo + k] < 2 * xs[i]:
                lo += 1
            reach = max(xs[i] - xs[lo], xs[lo + k - 1] - xs[i])
            w = [(1 - min(abs(xs[j] - xs[i]) / reach, 1) ** 3) ** 3 * robust[j] if reach else robust[j] for j in range(lo, lo + k)]
            if sum(w) <= 0:
                fits.append(ys[i])
                continue
            mx, my = (sum(a * v[j] for a, j in zip(w, range(lo, lo + k), strict=True)) / sum(w) for v in (xs, ys))
            sxx = sum(a * (xs[j] - mx) ** 2 for a, j in zip(w, range(lo, lo + k), strict=True))
            sxy = sum(a * (xs[j] - mx) * (ys[j] - my) for a, j in zip(w, range(lo, lo + k), strict=True))
            fits.append(my + (sxy / sxx if sxx > 1e-12 * sum(w) * max(reach, 1e-300) ** 2 else 0.0) * (xs[i] - mx))
        if nth == passes:
            return fits
        off = [abs(a - b) for a, b in zip(ys, fits, strict=True)]
        usual = 6 * statistics.median(off)
        if usual > 1e-7 * sum(off) / n:
            robust = [(1 - (o / usual) ** 2) ** 2 if o < usual else 0.0 for o in off]


@pytest.mark.parametrize(("block", "k", "passes"), [(100_000, 15, 2), (20, 15, 2), (20, 7, 0), (100_000, 500, 1)])
def test_local_regression_equals_plain_loops(spark, monkeypatch, block, k, passes):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    rng = random.Random(3)
    points = [(g, round(rng.random() * 10, 2 if g else 6), 0.0) for g in (0, 1) for _ in range(90)]
    points = [(g, x, np.sin(x) + rng.gauss(0, 0.2) + (5 if rng.random() < 0.05 else 0)) for g, x, _ in points]
    points = list(dict.fromkeys((g, x) for g, x, _ in points)), {(g, x): y for g, x, y in points}
    rows = [(g, x, float(points[1][g, x])) for g, x in points[0]]
    df = spark.createDataFrame([*rows, (0, None, 1.0), (1, 2.0, float("nan"))], "g int, x double, y double")
    out = smooth.lowess(df, "x", "y", k, ["g"], passes)
    assert out.columns == ["g", "x", "y", "smooth"]
    got = out.collect()
    assert len(got) == len(rows) + 2 and sum(r["smooth"] is None for r in got) == 2
    for g in (0, 1):
        own = sorted((r["x"], r["smooth"]) for r in got if r["g"] == g and r["smooth"] is not None)
        assert [s for _, s in own] == pytest.approx(brute([(x, y) for gg, x, y in rows if gg == g], k, passes), abs=1e-9)


def test_a_line_stays_a_line_and_outliers_lose(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 0.1 * (-1) ** i + (50 if i == 30 else 0)) for i in range(80)], "x double, y double")
    got = {r["x"]: r["smooth"] for r in smooth.lowess(df, "x", "y", 20).collect()}
    assert all(abs(got[x] - 2 * x) < 0.2 for x in got)
    line = spark.createDataFrame([(float(i), 3.0 - i) for i in range(40)], "x double, y double")
    assert all(abs(r["smooth"] - r["y"]) < 1e-9 for r in smooth.lowess(line, "x", "y", 9).collect())
    assert smooth.lowess(df.where("false"), "x", "y", 5).count() == 0


@pytest.mark.parametrize("block", [100_000, 7])
def test_centred_median_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    rng = random.Random(1)
    values = [None if rng.random() < 0.3 else rng.random() for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(4)
    for window, least in ((5, 2), (4, 1)):
        half = window // 2
        want = {}
        for i in range(60):
            own = [v for v in values[max(0, i - half) : i + window - half] if v is not None]
            want[i] = statistics.median(own) if len(own) >= least else None
        assert {r["i"]: r["smooth"] for r in smooth.centred_median(df, [], ["i"], "v", window, least).collect()} == want
