"""Quantiles of what was visible before each row, against lists."""

import random

import numpy as np
import pytest
from quernel.operators import prefix, series
from quernel.plans import policy


def brute(rows, fractions, delay, least):
    out = {}
    for i, k, t, _ in rows:
        seen = sorted(v for _, kk, tt, v in rows if kk == k and t is not None and tt is not None and tt <= t - delay and v is not None and v == v)
        out[i] = (len(seen), [float(x) for x in np.quantile(seen, fractions)] if len(seen) >= max(least, 1) else None)
    return out


def some_rows(n, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", None, "b"]), rng.choice([rng.randint(0, 300), rng.randint(0, 300), 50]), rng.choice([rng.random(), rng.random(), 0.5, 0.25, None, float("nan")])) for i in range(n)]
    return [*rows, (n, "a", None, 0.1), (n + 1, "c", 5, None), (n + 2, "d", 5, 1.0)]


def same(got, want):
    assert got.keys() == want.keys()
    for i, (n, q) in want.items():
        assert got[i][0] == n and (q is None) == (got[i][1] is None), (i, got[i], want[i])
        assert q is None or np.allclose(got[i][1], q, atol=1e-12), (i, got[i], q)


@pytest.mark.parametrize(("block", "lookups", "delay", "least"), [(100_000, 1_000_000, 10, 1), (100_000, 1_000_000, 0, 5), (40, 1_000_000, 10, 1), (40, 30, 0, 5)])
def test_prefix_quantiles_equal_brute_force(spark, monkeypatch, block, lookups, delay, least):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefix, "LOOKUPS", lookups)
    rows, fractions = some_rows(400), (0.0, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "i long, key string, t long, v double")
    out = prefix.prefix_quantiles(df, ["key"], "t", "v", fractions, delay, least)
    assert out.columns == ["i", "key", "t", "v", "n_visible", "q"]
    same({r["i"]: (r["n_visible"], r["q"]) for r in out.collect()}, brute(rows, fractions, delay, least))


@pytest.mark.parametrize("block", [100_000, 60])
def test_without_keys_and_without_rows(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    rows = [(i, None, t, v) for i, _, t, v in some_rows(150, 4)]
    df = spark.createDataFrame(rows, "i long, key string, t long, v double")
    same({r["i"]: (r["n_visible"], r["q"]) for r in prefix.prefix_quantiles(df, [], "t", "v", (0.5,), 3).collect()}, brute(rows, (0.5,), 3, 1))
    assert prefix.prefix_quantiles(df.where("false"), ["key"], "t", "v", (0.5,)).count() == 0


def test_one_value_in_all_rows(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 30)
    df = spark.range(200).selectExpr("id as i", "id as t", "2.0 as v")
    got = prefix.prefix_quantiles(df, [], "t", "v", (0.1, 0.5), 1).orderBy("i").collect()
    assert [(r["n_visible"], r["q"]) for r in got] == [(i, [2.0, 2.0] if i else None) for i in range(200)]


def test_order_statistics_of_places():
    rng = np.random.default_rng(1)
    values, at = rng.random(500), np.sort(rng.choice(2000, 500, replace=False))
    asked = np.sort(rng.integers(at[0] + 1, 2000, 300))
    ks = np.array([rng.integers(0, (at < a).sum()) for a in asked])
    assert prefix.order_statistics(at, values, asked, ks).tolist() == [sorted(values[at < a])[k] for a, k in zip(asked, ks, strict=True)]


def test_scaling_by_what_was_visible(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 10, 3.0), (3, 20, 5.0), (4, 30, 9.0), (5, 40, None)], "i long, t long, x double")
    got = {r["i"]: (r["x_visible"], r["x_scaled"]) for r in policy.walk_forward_scaled(df, [], "t", ["x"], 5, 2).collect()}
    assert got == {1: (0, None), 2: (1, None), 3: (2, 3.0), 4: (3, 3.0), 5: (4, None)}


def test_ranges_of_ranks_before_each_question():
    rng = np.random.default_rng(5)
    for ranges, n in ((1, 0), (1, 9), (5, 40), (33, 300)):
        counts, codes = rng.integers(0, 4, ranges) + 1, rng.integers(0, ranges, n)
        until = rng.integers(0, n + 1, 200)
        ks = np.array([rng.integers(0, counts.sum() + u) for u in until])
        found = prefix.prefix_ranges(counts, codes, until, ks)
        for u, k, code, place in zip(until, ks, *found, strict=True):
            every = np.sort(np.concatenate((np.repeat(np.arange(ranges), counts), codes[:u])))
            assert code == every[k] and place == k - (every < code).sum()


def test_no_row_is_moved_once_a_quantile(spark, monkeypatch):
    """Answers came as a row for each order statistic, and one range's task took all questions that ended in it."""
    monkeypatch.setattr(series, "BLOCK_ROWS", 200)
    written = []
    keep = prefix.materialize
    monkeypatch.setattr(prefix, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    df = spark.range(2000).selectExpr("id as i", "id as t", "double(id * 7919 % 1000) as v")
    got = {r["i"]: (r["n_visible"], r["q"]) for r in prefix.prefix_quantiles(df, [], "t", "v", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), 5).collect()}
    same(got, brute([(r["i"], None, r["t"], r["v"]) for r in df.collect()], (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), 5, 1))
    assert max(w.count() for w in written) <= 2000
