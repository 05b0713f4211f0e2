"""Streaming: sliding means of sensor values with late data, and labels met with earlier predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_means(points: DataFrame, ts: str = "ts", tag: str = "event_type", value: str = "value", size: str = "60 minutes", step: str = "10 minutes", late: str = "90 minutes", least: int = 1) -> DataFrame:
    """Mean and count of each tag's values in sliding windows, for batches and streams alike; streams drop rows later than ``late``."""
    rows = points.withColumn(ts, F.col(ts).cast("timestamp"))
    if points.isStreaming:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, size, step).alias("w"), tag).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), tag, "n", F.when(F.col("n") >= least, F.col("mean")).alias("mean"))


def backfill_labels(predictions: DataFrame, labels: DataFrame, key: str, residence: str = "174 minutes", tolerance: str = "90 minutes") -> DataFrame:
    """Predictions met with labels of the same key whose time is a residence later, within the tolerance: an interval join, so that streams
    can forget rows. ``predictions`` has ``pred_ts``, ``labels`` has ``label_ts``."""
    p = predictions.withColumn("pred_ts", F.col("pred_ts").cast("timestamp"))
    lab = labels.withColumn("label_ts", F.col("label_ts").cast("timestamp")).withColumnRenamed(key, "__k")
    if predictions.isStreaming:
        p, lab = p.withWatermark("pred_ts", tolerance), lab.withWatermark("label_ts", tolerance)
    due = F.col("pred_ts") + F.expr(f"interval {residence}")
    t = F.expr(f"interval {tolerance}")
    return p.join(lab, (F.col(key) == F.col("__k")) & (F.col("label_ts") >= due - t) & (F.col("label_ts") <= due + t)).drop("__k")
