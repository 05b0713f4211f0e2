"""Cleaning of sensor tables: last row of each time, spikes to null, short gaps filled, limits, shutdown flags, labels attached."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.scalars import bound_reason, within
from quernel.operators.series import interpolate, keep_last, spikes


def clean_series(points: DataFrame, keys: Sequence[str], ts: str, value: str, order: Column, window: int = 11, sigma: float = 8.0, limit: int = 5) -> DataFrame:
    """Long points with ``was_missing`` and ``spike`` flags: the last row of each key and time, isolated spikes nulled, gaps interpolated over ``limit`` rows."""
    rows = keep_last(points, [*keys, ts], [order])
    rows = spikes(rows, keys, [ts], value, window, sigma).withColumnRenamed("is_spike", "spike").withColumn("was_missing", F.col(value).isNull())
    rows = rows.withColumn(value, F.when(~F.col("spike"), F.col(value)))
    return interpolate(rows, keys, [ts], value, limit)


def attach_labels(table: DataFrame, labels: DataFrame, time: str = "time") -> DataFrame:
    """Sparse labels on their exact minutes; Spark broadcasts them if they are small."""
    return table.join(labels, time, "left")


def apply_bounds(wide: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return wide.withColumns({c: within(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items()})


def clean_with_audit(wide: DataFrame, bounds: Mapping[str, tuple[float, float]], flow: str | None = None, least_invalid: int = 3) -> tuple[DataFrame, DataFrame]:
    """The wide table with invalid values nulled and ``shutdown`` (several invalid points, or an invalid flow), and the violations as rows
    (time, point, value, reason)."""
    reasons = {c: bound_reason(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items()}
    invalid = reduce(lambda a, b: a + b, (r.isNotNull().cast("int") for r in reasons.values()))
    shutdown = (invalid >= least_invalid) | (reasons[flow].isNotNull() if flow else F.lit(False))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("point"), F.col(c).alias("value"), r.alias("reason")) for c, r in reasons.items()]))
    violations = wide.select("time", cells.alias("v")).select("time", "v.*").where("reason is not null")
    return apply_bounds(wide.withColumn("shutdown", shutdown), bounds), violations


def filter_rows(df: DataFrame, columns: Sequence[str], start: str | None = None, time: str = "time", drop_missing: bool = False) -> DataFrame:
    if start:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    return df.dropna("any", subset=list(columns)) if drop_missing else df
