"""Features at label times and at run time, from lag-shifted windows of sensor points."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.scalars import safe_ratio, seconds
from quernel.operators.joins import asof, nearest, windows_at
from quernel.operators.series import frame_stats, keep_last


def anchored_stats(anchors: DataFrame, points: DataFrame, ts: str, value: str, lag_min: float, window_min: float, prefix: str) -> DataFrame:
    """For each anchor row (``id``, ``anchor``): statistics of the points in (anchor - lag - window, anchor - lag]: mean, deviation, extremes, range, slope per minute
    and share of missing minutes."""
    shifted = anchors.withColumn("__at", F.col("anchor") - F.make_dt_interval(mins=F.lit(int(lag_min))))
    out = windows_at(shifted, points, [], "__at", ts, window_min * 60, value, {k: k for k in ("n", "rows", "mean", "std", "min", "max", "slope")})
    n, rows = F.col("n"), F.col("rows")
    named = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "max": F.col("max"), "range": F.col("max") - F.col("min"), "slope": F.when(n >= 2, F.col("slope")), "missing_rate": 1 - n / F.greatest(F.lit(window_min), rows)}
    return out.select(*anchors.columns, *[c.alias(f"{prefix}_{k}") for k, c in named.items()])


def runtime_means(points: DataFrame, keys: list[str], ts: str, value: str, window_min: float = 60, least: int = 30) -> DataFrame:
    """Mean of the closed window [t - window, t] at each point, null below ``least`` values."""
    out = frame_stats(points, points, keys, ts, ts, window_min * 60, value, {"__n": "n", "__m": "mean"})
    return out.withColumn("window_mean", F.when(F.col("__n") >= least, F.col("__m"))).drop("__n", "__m")


def runtime_ratio(wide: DataFrame, ts: str, top: str, bottom: str, window_min: float = 60, least: int = 30) -> DataFrame:
    return runtime_means(wide.withColumn("__r", safe_ratio(F.col(top), F.col(bottom))), [], ts, "__r", window_min, least).withColumnRenamed("window_mean", "ratio_mean").drop("__r")


def on_grid(points: DataFrame, ts: str, value: str, step_s: int, tolerance_s: float | None = None) -> DataFrame:
    """The nearest value on a regular grid over the points' span, within the tolerance or, without one, however far; of two at the same distance the later. The grid is a sequence
    between the two ends, one row of bounds."""
    ends = points.agg(F.floor(seconds(F.min(ts)) / step_s).alias("a"), F.floor(seconds(F.max(ts)) / step_s).alias("b"))
    grid = ends.select(F.explode(F.sequence(F.col("a"), F.col("b"))).alias("i")).select(F.timestamp_seconds(F.col("i") * step_s).cast("timestamp_ntz").alias("grid_ts"))
    right = keep_last(points.select(ts, value), [ts], [F.col(value)])
    if tolerance_s is None:
        return nearest(grid, right, "grid_ts", ts, [value], later_on_tie=True)
    return asof(grid, right, [], "grid_ts", ts, [value], tolerance_s, later_on_tie=True)


def shifted_design(labels: DataFrame, points: Mapping[str, DataFrame], lags_min: Mapping[str, int], ts: str, value: str, tolerance_s: float = 30) -> DataFrame:
    """Each label row with the nearest value of every point at its own lag, one as-of join a point."""
    out = labels
    for name, df in points.items():
        shifted = keep_last(df, [ts], [F.col(value)]).select((F.col(ts) + F.make_dt_interval(mins=F.lit(int(lags_min[name])))).alias("__ts"), F.col(value).alias(name))
        out = asof(out, shifted, [], "anchor", "__ts", [name], tolerance_s).drop("match_ts", "match_delta_s")
    return out
