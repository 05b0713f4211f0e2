"""Windows over time series. Range frames cut a long series into time buckets with a halo, frames of rows into blocks of numbered rows with one; gaps and runs carry over the
blocks' edges. So a key may hold any number of rows. Rows of the largest key are counted first: where they fit one task, plain windows give the same rows with fewer shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.scalars import seconds
from quernel.sources.shared import materialize


def with_buckets(df: DataFrame, ts: str, width_s: float, before_s: float, after_s: float = 0.0) -> DataFrame:
    """Each row in its time bucket (``own``) and, as a copy, in the buckets whose frames reach it: ``bucket``, ``own``. A frame of
    ``before_s`` back and ``after_s`` ahead is whole inside a bucket for its own rows."""
    t = seconds(F.col(ts))
    first, last = F.floor((t - after_s) / width_s), F.floor((t + before_s) / width_s)
    out = df.withColumn("bucket", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    return out.withColumn("own", F.col("bucket") == F.floor(t / width_s))


def range_frame(df: DataFrame, keys: Sequence[str], ts: str, before_s: float, aggregates: dict[str, Column], after_s: float = 0.0, left_open: bool = False, bucket_s: float | None = None) -> DataFrame:
    """Adds aggregates over the rows of the same key within [t - before, t + after], or (t - before, t + after] if ``left_open``. Any aggregate will do, so each frame is read anew; ``frame_stats`` has the usual ones
    in linear time."""
    width = bucket_s or max(86_400.0, 8 * (before_s + after_s))
    low = -round(before_s * 1_000_000) + (1 if left_open else 0)
    w = Window.partitionBy(*keys, "bucket").orderBy("__us").rangeBetween(low, round(after_s * 1_000_000))
    rows = with_buckets(df, ts, width, before_s, after_s).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.withColumns({name: agg.over(w) for name, agg in aggregates.items()}).where("own").drop("bucket", "own", "__us")


def frame_stats(rows: DataFrame, points: DataFrame, keys: Sequence[str], rows_ts: str, ts: str, before_s: float, value: str, stats: dict[str, str], left_open: bool = False) -> DataFrame:
    """Adds statistics of the points of the same key within [t - before, t], or (t - before, t] if ``left_open``, to each row: name -> ``rows``, ``n``, ``mean``, ``std``, ``min``, ``max`` or ``slope`` (of the
    value a minute). Rows without a time meet the points without one. Work is linear however many points a frame holds, which ``range_frame`` isn't.

    Time is cut into blocks as long as the frame, so a frame is the end of one block and the beginning of the next. A point goes to its block and, a frame later, to the next one: there the points up to a row
    are its frame's second part and those of the block before from the row on its first. Both are running aggregates, one a direction, and are merged by their counts, means and centred sums.
    """
    width = round(before_s * 1_000_000)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ks = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    asked = rows.select(F.struct(*rows.columns).alias("row"), *ks, us(rows_ts).alias("s"), F.lit(0).alias("part"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("double").alias("x"))
    asked = asked.withColumn("block", F.floor(F.col("s") / width))
    given = points.select(*ks, us(ts).alias("us"), F.col(value).cast("double").alias("v")).withColumn("at", F.floor(F.col("us") / width))
    given = given.withColumn("part", F.explode(F.when(F.col("us").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    prior = F.col("part") == 2
    block = F.col("at") + prior.cast("int")
    minutes = F.when(F.col("v").isNotNull(), F.coalesce(F.col("us") - block * width, F.lit(0)) / 60e6)
    given = given.select(F.lit(None).cast(asked.schema["row"].dataType).alias("row"), *[f"k{i}" for i in range(len(keys))], (F.col("us") + F.when(prior, width - int(left_open)).otherwise(0)).alias("s"), "part", "v", minutes.alias("x"), block.alias("block"))
    by = Window.partitionBy(*[f"k{i}" for i in range(len(keys))], "block")
    used = set(stats.values())

    def running(part: int) -> dict[str, Column]:
        w = by.orderBy(F.col("s").asc() if part == 1 else F.col("s").desc()).rangeBetween(Window.unboundedPreceding, 0)
        own = F.col("part") == part
        v, x = F.when(own, F.col("v")), F.when(own, F.col("x"))
        out = {"n": F.count(v), "rows": F.count(F.when(own, 1))}
        out |= {"mean": F.avg(v)} if used & {"mean", "std", "slope"} else {}
        out |= {"vv": F.var_pop(v)} if "std" in used else {}
        out |= {k: f(v) for k, f in (("min", F.min), ("max", F.max)) if k in used}
        out |= {"x": F.avg(x), "xx": F.regr_sxx(v, x), "xy": F.regr_sxy(v, x)} if "slope" in used else {}
        return {f"{k}{part}": c.over(w) for k, c in out.items()}

    met = asked.unionByName(given).withColumns(running(1)).withColumns(running(2)).where("part = 0")
    c = lambda k, part: F.coalesce(F.col(f"{k}{part}"), F.lit(0.0))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    gap = lambda a: c(a, 1) - c(a, 2)
    apart = lambda a, b: F.when((n1 > 0) & (n2 > 0), gap(a) * gap(b) * (n1 / n) * n2).otherwise(0.0)
    both = {
        "rows": lambda: F.col("rows1") + F.col("rows2"), "n": lambda: n,
        "mean": lambda: F.when(n > 0, (c("mean", 1) * n1 + c("mean", 2) * n2) / n),
        "std": lambda: F.when(n > 1, F.sqrt((c("vv", 1) * n1 + c("vv", 2) * n2 + apart("mean", "mean")) / (n - 1))),
        "min": lambda: F.least("min1", "min2"), "max": lambda: F.greatest("max1", "max2"),
        "slope": lambda: F.try_divide(c("xy", 1) + c("xy", 2) + apart("x", "mean"), c("xx", 1) + c("xx", 2) + apart("x", "x")),
    }
    return met.select("row.*", *[both[kind]().alias(name) for name, kind in stats.items()])


#: Rows of a key that one task works on at a time.
BLOCK_ROWS = 100_000
#: Rows of a key whose distinct values one aggregation may hold for an exact quantile, some 50 bytes each.
HELD_ROWS = 1_000_000


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key."""
    return (df.groupBy(*keys).count().agg(F.max("count")) if keys else df.agg(F.count("*"))).first()[0] or 0


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null nor NaN."""
    c = F.col(value)
    return df.where(c.isNotNull() & ~F.isnan(c)) if dict(df.dtypes)[value] in ("double", "float") else df.where(c.isNotNull())


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], nulls_last: bool = False) -> DataFrame:
    """Adds ``__i``: the row's number in its key, from 1, in the order of the columns, null times (the first column) first or last. Small keys are numbered by a window. Beyond that rows are dealt
    out and sorted by ranges of key and order, one shuffle, and written; the rows of each key before each range are added up apart."""
    by = [F.col(order[0]).asc_nulls_last() if nulls_last else F.col(order[0]).asc_nulls_first(), *map(F.col, order[1:])]
    if largest_key(df, keys) <= BLOCK_ROWS:
        return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    ordered = df.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    ranges = materialize(ordered.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered-rows")
    w = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    starts = starts.withColumn("__before", F.coalesce(F.sum("__rows").over(w), F.lit(0))).drop("__rows")
    out = join_small(ranges, starts, [*keys, "__range"])
    return out.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("__i"))


def row_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0) -> DataFrame:
    """Each row in its block (``__own``) and, as a copy, in the blocks whose frames reach it: ``__i``, ``__block``, ``__own``. A frame of ``before`` rows back and ``after`` ahead is
    whole inside a block for its own rows."""
    width = max(BLOCK_ROWS, 4 * (before + after))
    block = lambda i: F.floor(i / width).cast("bigint")
    i = F.col("__i") - 1
    rows = numbered(df, keys, order)
    if before or after:
        rows = rows.withColumn("__block", F.explode(F.sequence(F.greatest(block(i - after), F.lit(0).cast("bigint")), block(i + before))))
    else:
        rows = rows.withColumn("__block", block(i))
    return rows.withColumn("__own", F.col("__block") == block(i))


def rolling_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, prefix: str, least: int | None = None) -> DataFrame:
    """Mean, deviation, extremes, range, last value and slope of the last ``n`` rows of each key; null below ``least`` values."""
    whole = Window.partitionBy(*keys, "__block").orderBy("__i")
    w = whole.rowsBetween(-(n - 1), 0)
    need = least or max(2, n // 3)
    v = F.col(value)
    enough = F.count(v).over(w) >= need
    out = {
        "mean": F.avg(v).over(w), "std": F.stddev_samp(v).over(w), "min": F.min(v).over(w), "max": F.max(v).over(w),
        "range": F.max(v).over(w) - F.min(v).over(w), "last": v, "slope": (v - F.lag(v, n - 1).over(whole)) / (n - 1),
    }
    rows = row_blocks(df, keys, order, before=n - 1)
    return rows.withColumns({f"{prefix}_{k}": F.when(enough, c) for k, c in out.items()}).where("__own").drop("__i", "__block", "__own")


def rolling_slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, out: str = "slope") -> DataFrame:
    """Least-squares slope of the value on its row number over the last ``n`` rows."""
    w = Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-(n - 1), 0)
    rows = row_blocks(df, keys, order, before=n - 1)
    return rows.withColumn(out, F.regr_slope(value, "__i").over(w)).where("__own").drop("__i", "__block", "__own")


def spikes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 11, sigma: float = 8.0) -> DataFrame:
    """Adds ``is_spike``: a value further from the centred median than the threshold, while the rows before and after it lie within the threshold of that median.

    The threshold is ``sigma`` robust deviations (1.4826 times the centred median of the distances), but at least three times the 99.9% quantile of the series' steps and 5% of its
    range between the 1% and 99% quantiles. Median and deviation need max(5, window // 2) values; a deviation of 0 flags nothing.
    """
    half, least = window // 2, max(5, window // 2)
    rest = window - 1 - half
    whole = Window.partitionBy(*keys, "__block").orderBy("__i")
    w = whole.rowsBetween(-half, rest)
    v = F.col(value)

    def median(c: str) -> Column:
        return F.when(F.count(c).over(w) >= least, F.percentile(c, F.lit(0.5)).over(w))

    blocks = materialize(row_blocks(df, keys, order, before=max(2 * half, 1), after=max(2 * rest, 1)), "series-blocks")  # the frame of a frame; read twice
    rows = blocks.withColumns({"__before": F.lag(v).over(whole), "__after": F.lead(v).over(whole)})
    steps = rows.where("__own").withColumn("__step", F.abs(v - F.col("__before")))
    floors = join_small(quantiles(df, value, (0.01, 0.99), keys, "__q"), quantiles(steps, "__step", (0.999,), keys, "__s"), keys, "left").withColumn("__s", F.col("__s")[0])
    floors = floors.select(*keys, F.greatest(3 * F.coalesce("__s", F.lit(0.0)), 0.05 * (F.col("__q")[1] - F.col("__q")[0]), F.lit(0.0)).alias("__floor"))
    out = rows.withColumn("__m", median(value)).withColumn("__d", F.abs(v - F.col("__m")))
    out = out.withColumn("__s", 1.4826 * median("__d")).where("__own")
    out = join_small(out, floors, keys, "left")
    limit = F.greatest(sigma * F.col("__s"), F.col("__floor"))
    near = (F.abs(F.col("__before") - F.col("__m")) <= limit) & (F.abs(F.col("__after") - F.col("__m")) <= limit)
    return out.select(*df.columns, F.coalesce((F.col("__s") > 0) & (F.col("__d") > limit) & near, F.lit(False)).alias("is_spike"))


def interpolate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: int = 5) -> DataFrame:
    """Fills at most the first ``limit`` rows of each inner gap on the line between its neighbours, by row number. Each block's first and last values are carried to the
    blocks beside it, over empty ones too."""
    whole, back_to_front = (Window.partitionBy(*keys, "__block").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("__i"), F.desc("__i")))
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v")))
    rows = materialize(row_blocks(df, keys, order), "series-blocks")  # read twice
    earlier, later = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__block"), F.desc("__block")))
    ends = rows.groupBy(*keys, "__block").agg(F.max(seen).alias("__last"), F.min(seen).alias("__first"))
    ends = ends.select(
        *keys, "__block",
        F.last("__last", ignorenulls=True).over(earlier).alias("__earlier"),
        F.last("__first", ignorenulls=True).over(later).alias("__later"),
    )
    out = join_small(rows, ends, [*keys, "__block"])
    out = out.withColumns({
        "__p": F.coalesce(F.last(seen, ignorenulls=True).over(whole), F.col("__earlier")),
        "__n": F.coalesce(F.last(seen, ignorenulls=True).over(back_to_front), F.col("__later")),
    })
    p, n, i = F.col("__p"), F.col("__n"), F.col("__i")
    line = p["v"] + (n["v"] - p["v"]) * (i - p["i"]) / (n["i"] - p["i"])
    fill = F.when(p.isNotNull() & n.isNotNull() & (i - p["i"] <= limit), line)
    return out.withColumn(value, F.coalesce(F.col(value), fill)).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_value(value: str, order: Column) -> Column:
    """Aggregate: the last value that isn't null."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def longest_true_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Length of the longest run of true rows of each key. True rows are counted in each block, and the blocks' counts are summed apart, so a run goes on over the edges."""
    rows = materialize(row_blocks(df.select(*dict.fromkeys([*keys, *order]), F.coalesce(F.col(flag), F.lit(False)).alias("__flag")), keys, order), "series-blocks")  # read twice
    true = F.sum(F.col("__flag").cast("int"))
    by_block = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__block").agg(true.alias("__true")).select(*keys, "__block", F.coalesce(F.sum("__true").over(by_block), F.lit(0)).alias("__earlier"))
    so_far = true.over(Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    runs = join_small(rows.withColumn("__so_far", so_far), totals, [*keys, "__block"]).where("__flag")
    runs = runs.groupBy(*keys, (F.col("__i") - F.col("__so_far") - F.col("__earlier")).alias("__run")).count()
    longest = runs.groupBy(*keys).agg(F.max("count").alias("__n"))
    return join_small(df.select(*keys).distinct() if keys else df.agg(F.count("*")), longest, keys, "left").select(*keys, F.coalesce("__n", F.lit(0)).alias("longest_run"))


def near_flagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, n: int = 3) -> DataFrame:
    """Rows within ``n`` rows of a flagged one."""
    w = Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-n, n)
    rows = row_blocks(df, keys, order, n, n).withColumn("__near", F.max(flag.cast("int")).over(w))
    return rows.where("__own and __near = 1").drop("__near", "__i", "__block", "__own")


def average_rank(value: str, keys: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean, over the rows of ``keys`` that aren't null."""
    w = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value)
    peers = Window.partitionBy(*keys, F.col(value).isNull(), value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(peers) - 1) / 2)


def percent_rank(value: str, keys: Sequence[str] = ()) -> Column:
    return average_rank(value, keys) / F.count(value).over(Window.partitionBy(*keys))


def join_small(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row a group, null groups included; without keys it has one row, which is broadcast. The table is written first, so that its size is known: by the sizes that are guessed of
    aggregates and exploded rows the large table may be the one that is sent through the driver, or is dealt out by a few keys."""
    if not keys:
        return df.crossJoin(F.broadcast(side))
    named = materialize(side, "groups").withColumnsRenamed({k: f"__key_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return df.join(named, on, how).drop(*[f"__key_{k}" for k in keys])


def running_sums(counted: DataFrame, value: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``before_<column>``: the column's sum over the lower values of the key. ``counted`` has one row for each value of a key and is read more than once, so it is written first.

    Where the largest key has few values, one window adds them up; else they are dealt out by ranges of key and value and totals of the ranges are summed apart, so a group takes many tasks. The ranges only
    deal out work: sums are exact."""
    running = lambda *by: Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    if largest_key(counted, keys) <= BLOCK_ROWS:
        return counted.withColumns({f"before_{c}": so_far(c, running(*keys)) for c in columns})
    ranges = materialize(counted.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()), "value-ranges")
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__total_{c}") for c in columns])
    totals = totals.select(*keys, "__part", *[so_far(f"__total_{c}", w).alias(f"__earlier_{c}") for c in columns])
    out = join_small(ranges.withColumns({f"__inner_{c}": so_far(c, running(*keys, "__part")) for c in columns}), totals, [*keys, "__part"])
    return out.select(*counted.columns, *[(F.col(f"__earlier_{c}") + F.col(f"__inner_{c}")).alias(f"before_{c}") for c in columns])


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``(<keys>, value, count, before, rank)`` of each distinct value that is neither null nor NaN: rows below it, and the mean rank of its rows. A row counts as often as its ``weight`` says."""
    counted = present(df, value).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    out = running_sums(materialize(counted, "value-counts"), value, ["count"], keys)
    before = F.col("before_count")
    return out.select(*keys, value, "count", before.alias("before"), (before + (F.col("count") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, value: str, fractions: Sequence[float], keys: Sequence[str] = (), out: str = "q") -> DataFrame:
    """``(<keys>, q)``: exact quantiles of the values that are neither null nor NaN, linear between ranks, as an array. A group without values has no row; without keys there is one row, of null
    for a table without values. Where a group has more rows than one aggregation should hold, ranks come from ``value_ranks``, so no task holds a group's values."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    if largest_key(rows, keys) <= HELD_ROWS:
        return present(rows, "__v").groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(float(f)) for f in fractions])).alias(out))
    ranks = materialize(value_ranks(rows, "__v", keys), "value-ranks")
    ranks = join_small(ranks, ranks.groupBy(*keys).agg(F.sum("count").alias("__n")), keys)
    at = [(F.col("__n") - 1) * float(f) for f in fractions]
    holds = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("count")), F.col("__v")))
    ends = ranks.groupBy(*keys).agg(F.max("__n").alias("__n"), *[holds(F.floor(p)).alias(f"__lo{i}") for i, p in enumerate(at)], *[holds(F.ceil(p)).alias(f"__hi{i}") for i, p in enumerate(at)])
    lo, hi = ([F.col(f"__{s}{i}") for i in range(len(at))] for s in ("lo", "hi"))
    q = F.array(*[F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b) for p, a, b in zip(at, lo, hi, strict=True)])
    return materialize(ends.select(*keys, F.when(F.col("__n") > 0, q).alias(out)), "quantiles")


def quantiles_of(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``(<keys>, <columns>)``: the quantiles of several columns, an array each, from one pass; a group has a row if a column has a value in it, and null for the others."""
    cells = F.array(*[F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__v")) for c in columns])
    long = quantiles(df.select(*keys, F.explode(cells).alias("__r")).select(*keys, "__r.*"), "__v", fractions, [*keys, "__column"])
    own = [F.max(F.when(F.col("__column") == c, F.col("q"))).alias(c) for c in columns]
    return long.groupBy(*keys).agg(*own) if keys else long.agg(*own)


def chronological_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Adds ``split``: the first floor(share * n) rows of each key are train, the rest test. Rows are in the order of the first column, ties in that of the others, and null times
    come last, in test. Rows are numbered by ``numbered``, so a key may hold any number of them."""
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    out = join_small(numbered(df, keys, order, nulls_last=True), n, keys)
    first = F.col(order[0]).isNotNull() & (F.col("__i") <= F.floor(F.col("__n") * share))
    return out.withColumn("split", F.when(first, "train").otherwise("test")).select(*df.columns, "split")
