"""Validation on later data: labels met with predictions, reports by position and month, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.joins import asof
from quernel.operators.series import keep_last
from quernel.plans.rules import first_match


def align(predictions: DataFrame, labels: DataFrame, residence_min: int = 174, tolerance_min: float = 90, one_to_one: bool = False) -> DataFrame:
    """Predictions (``pred_ts``) with the nearest label (``label_ts``, ``label``) a residence later; ``one_to_one`` keeps each label's nearest prediction."""
    due = predictions.withColumn("quality_ts", F.col("pred_ts") + F.make_dt_interval(mins=F.lit(residence_min)))
    met = asof(due, labels, [], "quality_ts", "label_ts", ["label"], tolerance_min * 60).where("match_ts is not null")
    if one_to_one:
        met = keep_last(met, ["match_ts"], [-F.abs(F.col("match_delta_s")), F.col("pred_ts")])
    return met


def strategy_report(aligned: DataFrame, label: str, position: str) -> DataFrame:
    """Rows, ok and high rates inside and outside the band, and whether inside is better by the rate of high labels."""
    inside = F.col(position) == "inside_band"
    outside = F.col(position).isin("below_band", "above_band")
    high = (F.col(label) > 8.7).cast("int")
    ok = F.col(label).between(8.2, 8.7).cast("int")
    out = aligned.agg(F.count("*").alias("n"), F.sum(inside.cast("int")).alias("n_inside"), F.sum(outside.cast("int")).alias("n_outside"), F.avg(F.when(inside, ok)).alias("inside_ok"), F.avg(F.when(outside, ok)).alias("outside_ok"), F.avg(F.when(inside, high)).alias("inside_high"), F.avg(F.when(outside, high)).alias("outside_high"))
    return out.withColumn("inside_better", F.coalesce(F.col("inside_high") < F.col("outside_high"), F.lit(False)))


def monthly(parts: Mapping[str, tuple[DataFrame, str, Mapping[str, Column]]]) -> DataFrame:
    """Aggregates by month of several tables side by side: name -> (table, time column, aggregates)."""
    out = None
    for name, (df, ts, aggs) in parts.items():
        m = df.groupBy(F.date_format(ts, "yyyy_MM").alias("month")).agg(*[c.alias(f"{name}_{k}") for k, c in aggs.items()])
        out = m if out is None else out.join(m, "month", "full")
    return out


def gate(df: DataFrame, needs: Mapping[str, int], out: str = "evidence") -> DataFrame:
    """``enough`` where every counted column reaches its need, else the first that doesn't."""
    return df.withColumn(out, first_match([(F.coalesce(F.col(c), F.lit(0)) < n, f"few_{c}") for c, n in needs.items()], "enough"))


def evidence(reports: DataFrame, json_col: str, paths: Sequence[str]) -> DataFrame:
    """Fields of nested report JSON as rows (report, path, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object(json_col, p).alias("value")) for p in paths]))
    return reports.select("report", cells.alias("c")).select("report", "c.*")
