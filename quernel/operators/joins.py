"""Joins in time, by range and with checked keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.scalars import seconds
from quernel.operators.series import frame_stats


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], tolerance_s: float, direction: str = "nearest", later_on_tie: bool = False) -> DataFrame:
    """Each left row with the values of the right row nearest in time (or the last before it: ``backward``), within the tolerance; null values if there is none.

    Time is cut into buckets of twice the tolerance. A left row goes to its bucket, a right row to its own and those its tolerance reaches, so that both meet
    in one shuffle on (keys, bucket) and no task holds a whole series. Ties in distance go to the earlier row unless ``later_on_tie``; right rows at one
    time must be unique (see ``series.keep_last``). Adds ``match_ts`` and ``match_delta_s``.
    """
    width = max(2 * tolerance_s, 1.0)
    lcols = left.columns
    l = left.select(F.struct(*lcols).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], seconds(F.col(left_ts)).alias("t"), F.lit(None).cast(right.select(F.struct(right_ts, *values).alias("v")).schema["v"].dataType).alias("v"))
    l = l.withColumn("bucket", F.floor(F.col("t") / width))
    r = right.where(F.col(right_ts).isNotNull()).select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], seconds(F.col(right_ts)).alias("t"), F.struct(right_ts, *values).alias("v"))
    reach = [F.floor((F.col("t") + d) / width) for d in (-tolerance_s, tolerance_s)]
    r = r.withColumn("bucket", F.explode(F.sequence(reach[0].cast("bigint"), reach[1].cast("bigint"))))
    both = l.unionByName(r)
    # right rows come first among equal times; what follows is what came before in the reverse order, as a frame up to the end is read anew for each row
    by = Window.partitionBy(*[f"k{i}" for i in range(len(keys))], "bucket")
    w, back_to_front = by.orderBy("t", F.col("row").isNotNull()), by.orderBy(F.desc("t"), F.col("row").isNull())
    seen = F.when(F.col("v").isNotNull(), F.struct("v", "t"))
    both = both.withColumn("prev", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if direction == "nearest":
        both = both.withColumn("next", F.last(seen, ignorenulls=True).over(back_to_front.rowsBetween(Window.unboundedPreceding, 0)))
    out = both.where(F.col("row").isNotNull())
    back = F.when(F.col("t") - F.col("prev.t") <= tolerance_s, F.col("prev"))
    if direction == "nearest":
        ahead = F.when(F.col("next.t") - F.col("t") <= tolerance_s, F.col("next"))
        d1, d2 = F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t")
        first = (d2 <= d1) if later_on_tie else (d2 < d1)
        best = F.when(ahead.isNotNull() & (back.isNull() | first), ahead).otherwise(back)
    else:
        best = back
    out = out.withColumn("best", best)
    return out.select("row.*", *[F.col(f"best.v.{c}").alias(c) for c in values], F.col(f"best.v.{right_ts}").alias("match_ts"), (F.col("best.t") - F.col("t")).alias("match_delta_s"))


def nearest(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, values: Sequence[str], later_on_tie: bool = False, width_s: float = 86_400.0) -> DataFrame:
    """Each left row with the values of the right row nearest in time, however far. Time is cut into buckets; each bucket's first and last right rows are carried to the left rows of the buckets beside it,
    over empty ones too. Ties go to the earlier row unless ``later_on_tie``; right rows of one time should be unique. Left rows without a time keep nulls."""
    cols = left.columns
    v = F.struct(seconds(F.col(right_ts)).alias("t"), F.struct(right_ts, *values).alias("v"))
    r = right.where(F.col(right_ts).isNotNull()).select(v.alias("seen")).select(F.floor(F.col("seen.t") / width_s).alias("bucket"), F.col("seen.t").alias("t"), "seen")
    l = left.select(F.struct(*cols).alias("row"), seconds(F.col(left_ts)).alias("t")).withColumn("bucket", F.floor(F.col("t") / width_s))
    ends = r.groupBy("bucket").agg(F.max_by("seen", "t").alias("last"), F.min_by("seen", "t").alias("first"))
    every = l.select("bucket").where("bucket is not null").distinct().join(ends, "bucket", "full")
    w, back_to_front = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    every = every.select("bucket", F.last("last", ignorenulls=True).over(w).alias("earlier"), F.last("first", ignorenulls=True).over(back_to_front).alias("later"))
    both = l.select("row", "t", "bucket", F.lit(None).cast(r.schema["seen"].dataType).alias("seen")).unionByName(r.select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), "t", "bucket", "seen"))
    by = Window.partitionBy("bucket")
    orders = {"prev": by.orderBy("t", F.col("row").isNotNull()), "next": by.orderBy(F.desc("t"), F.col("row").isNull())}  # as in ``asof``
    both = both.withColumns({k: F.last("seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, w in orders.items()})
    out = both.where(F.col("row").isNotNull()).join(every, "bucket", "left")
    prev, after = F.coalesce("prev", "earlier"), F.coalesce("next", "later")
    d1, d2 = F.col("t") - prev["t"], after["t"] - F.col("t")
    ahead = d1.isNull() | ((d2 <= d1) if later_on_tie else (d2 < d1))
    best = F.when(F.col("t").isNotNull(), F.when(after.isNotNull() & ahead, after).otherwise(prev))
    out = out.withColumn("best", best)
    return out.select("row.*", *[F.col(f"best.v.{c}").alias(c) for c in values], F.col(f"best.v.{right_ts}").alias("match_ts"), (F.col("best.t") - F.col("t")).alias("match_delta_s"))


def lag_lookup(left: DataFrame, right: DataFrame, ts: str, value: str, offsets_min: Sequence[int], name: str) -> DataFrame:
    """The right value at left time minus each offset, as one column an offset. Right rows are shifted by every offset and put side by side by
    the time they serve, so that one equi-join does all offsets. Times of ``right`` must be unique."""
    shifted = right.select(F.col(ts).alias("__t"), F.col(value).alias("__v"), F.explode(F.array(*map(F.lit, offsets_min))).alias("__o"))
    served = shifted.groupBy((F.col("__t") + F.make_dt_interval(mins=F.col("__o"))).alias(ts))
    wide = served.agg(*[F.max(F.when(F.col("__o") == o, F.col("__v"))).alias(f"{name}_{'m' if o < 0 else 'p'}{abs(o)}") for o in offsets_min])
    return left.join(wide, ts, "left")


def checked_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that stops if the right side repeats a key."""
    again = right.groupBy(*on).count().where("count > 1")
    if not again.isEmpty():
        raise ValueError(f"right side repeats keys of {list(on)}: {again.first()}")
    return left.join(right, list(on), "left")


def full_outer(frames: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """n-way full outer join on ``key``: the frames' rows are stacked and pivoted, one shuffle instead of n - 1."""
    long = None
    for name, f in frames.items():
        part = f.select(key, F.lit(name).alias("__name"), F.col(value).alias("__value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(key).pivot("__name", list(frames)).agg(F.avg("__value"))


def windows_at(anchors: DataFrame, points: DataFrame, keys: Sequence[str], anchor_ts: str, ts: str, before_s: float, value: str, stats: Mapping[str, str]) -> DataFrame:
    """Statistics (see ``series.frame_stats``) of the points in (anchor - before, anchor] for each anchor row; anchors without points keep nulls and zero counts, as do those without a time."""
    return frame_stats(anchors, points.where(F.col(ts).isNotNull()), keys, anchor_ts, ts, before_s, value, dict(stats), left_open=True)


def rule_matches(rows: DataFrame, rules: DataFrame, boundaries: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(id, rule_id, ...)``: rules whose feature lies in their bin. Rows are unpivoted to (feature, value), binned by the feature's boundaries and
    met with the rules by an equi-join on (feature, bin)."""
    long = rows.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("r")).select("id", "r.*").where("x is not null")
    binned = long.join(boundaries, "feature").withColumn("bin", F.when(F.col("x") <= F.col("q33"), "low").when(F.col("x") <= F.col("q66"), "mid").otherwise("high"))
    return binned.select("id", "feature", "bin").join(rules, ["feature", "bin"])
