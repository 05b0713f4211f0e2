"""Smoothing curves: local linear regression with tricube weights over the nearest rows, made robust by further passes, and the centred median."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.series import join_small, present, quantiles, row_blocks
from quernel.sources.shared import materialize

#: Cells of the windows' matrices that are held at once.
CELLS = 1 << 20


def local_fits(x: np.ndarray, y: np.ndarray, robust: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The fit at each place ``own`` of sorted ``x``: a weighted line through the k rows nearest to it, weighed by the cube of one less the cube of their relative distance, and by ``robust``."""
    n = len(x)
    k = min(k, n)
    first = np.minimum(np.searchsorted(x[: n - k] + x[k:], 2 * x[own], side="left"), n - k)
    out = np.empty(len(own))
    for lo in range(0, len(own), max(1, CELLS // k)):
        part = slice(lo, lo + max(1, CELLS // k))
        at = first[part, None] + np.arange(k)
        xs, here = x[at], x[own[part], None]
        reach = np.maximum(here - xs[:, :1], xs[:, -1:] - here)
        w = np.where(reach > 0, (1 - np.minimum(np.abs(xs - here) / np.where(reach > 0, reach, 1), 1) ** 3) ** 3, 1.0) * robust[at]
        total = w.sum(1)
        mean_x, mean_y = ((w * v).sum(1) / np.where(total > 0, total, 1) for v in (xs, y[at]))
        sxx = (w * (xs - mean_x[:, None]) ** 2).sum(1)
        sxy = (w * (xs - mean_x[:, None]) * (y[at] - mean_y[:, None])).sum(1)
        steep = sxx > 1e-12 * np.maximum(total, 1e-300) * np.maximum(reach[:, 0], 1e-300) ** 2
        fit = mean_y + np.where(steep, sxy / np.where(steep, sxx, 1), 0.0) * (here[:, 0] - mean_x)
        out[part] = np.where(total > 0, fit, y[own[part]])
    return out


def lowess(df: DataFrame, x: str, y: str, k: int, keys: Sequence[str] = (), passes: int = 3, out: str = "smooth") -> DataFrame:
    """Adds the smoothed ``y`` along ``x``: each row's line through its key's ``k`` nearest rows; ``passes`` further times rows far from their fit count less (by the square of one less the square of the
    residual over six median residuals; weights stay where these are as good as 0). Rows are numbered by x and cut into blocks with k rows from each side, so a key may hold any number of rows. Rows without x or y get null."""
    keys = list(keys)
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "smooth-rows")
    good = present(present(rows.select("__row", *keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), "__x"), "__y")
    good = good.withColumn("__w", F.lit(1.0))
    kinds = dict(good.dtypes)
    schema = ", ".join(["__row long", *[f"{c} {kinds[c]}" for c in keys], "__x double", "__y double", "__w double", "__fit double"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__i").reset_index(drop=True)
        own = np.flatnonzero(part["__own"].to_numpy())
        got = local_fits(part["__x"].to_numpy(), part["__y"].to_numpy(), part["__w"].to_numpy(), own, k)
        return part.iloc[own][["__row", *keys, "__x", "__y", "__w"]].assign(__fit=got)

    for nth in range(passes + 1):
        blocks = row_blocks(good, keys, ["__x", "__row"], before=k, after=k)
        fitted = materialize(blocks.groupBy(*keys, "__block").applyInPandas(fit, schema), "smooth-fits")
        if nth == passes:
            break
        off = fitted.withColumn("__off", F.abs(F.col("__y") - F.col("__fit")))
        usual = quantiles(off, "__off", (0.5,), keys, "__usual")
        off = join_small(join_small(off, usual, keys), off.groupBy(*keys).agg(F.avg("__off").alias("__mean")), keys)
        limit = 6 * F.col("__usual")[0]
        far = F.col("__off") / F.nullif(limit, F.lit(0.0))
        weight = F.when(limit <= 1e-7 * F.col("__mean"), F.col("__w")).when(far < 1, F.pow(1 - far * far, F.lit(2))).otherwise(0.0)
        good = off.withColumn("__w", weight).drop("__off", "__usual", "__mean", "__fit")
    return rows.join(fitted.select("__row", F.col("__fit").alias(out)), "__row", "left").drop("__row")


def centred_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int, least: int, out: str = "smooth") -> DataFrame:
    """Adds the median of ``window`` rows around each row in the order given, ``least`` values needed; for an even window the row before the middle one is the centre."""
    half = window // 2
    rest = window - 1 - half
    w = Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-half, rest)
    rows = row_blocks(df, keys, order, before=half, after=rest)
    return rows.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w))).where("__own").drop("__i", "__block", "__own")
