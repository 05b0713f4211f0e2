"""Quantile and edge binning as expressions over arrays of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.series import join_small, quantiles

def edges(df: DataFrame, column: str, fractions: Sequence[float], by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Exact quantiles, linear between ranks, with equal edges once: one row for each group, ``edges``. Rounded to ``digits``, an edge that
    interpolation leaves a hair beside a value is that value."""
    q = F.array_distinct("q" if digits is None else F.transform("q", lambda x: F.round(x, digits)))
    return quantiles(df, column, fractions, by).select(*by, q.alias("edges"))


def right_closed(x: Column, edges_: Column, include_lowest: bool = True) -> Column:
    """Number of the bin (a, b] that holds x, the least edge included unless told otherwise; null beyond the edges."""
    n = F.size(F.filter(edges_, lambda e: e < x))
    least = F.element_at(edges_, 1)
    return F.when(x.isNull() | ((x < least) if include_lowest else (x <= least)) | (x > F.element_at(edges_, -1)), None).otherwise(F.greatest(n - 1, F.lit(0)))


def left_closed(x: Column, edges_: Column) -> Column:
    """Number of the bin [a, b) that holds x, with open ends: how many inner edges lie at or below x."""
    return F.when(x.isNotNull(), F.size(F.filter(edges_, lambda e: e <= x)))


def qcut(df: DataFrame, column: str, bins: int, by: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """Adds the quantile bin of ``column``, from 0; the groups' edges are joined back, one row a group."""
    cuts = edges(df, column, [i / bins for i in range(bins + 1)], by)
    return join_small(df, cuts, by, "left").withColumn(out, right_closed(F.col(column), F.col("edges"))).drop("edges")


def tertile(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNull(), None).when(x <= low, "low").when(x <= high, "mid").otherwise("high")


def tertile_boundaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, q33, q66)``, a row for each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    return quantiles(long, "x", (1 / 3, 2 / 3), ["feature"]).select("feature", F.col("q")[0].alias("q33"), F.col("q")[1].alias("q66"))
