"""From raw points to recommendations, as a stream or a batch: trailing statistics of each point on a grid of times, one row a unit and time, and the rules' bands.

    points (unit, tag, ts, value) -> trailing -> side_by_side -> rules.advise -> with_writeback

Streams keep, for each unit and tag, the counts and sums of one cell a grid step over the window, and the last good value: some dozen numbers, however many points there are. A grid time is given out
when the watermark has passed it, so points that are late by less than the delay are counted; later ones are dropped. Batches give the same rows.

``transformWithState`` needs ``spark.sql.streaming.stateStore.providerClass`` to name the RocksDB store.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quernel.functions.scalars import dry_mass, feed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Grid:
    """Times of evaluation are multiples of ``step``; a window reaches ``window`` back, both ends in it, and a last value is good for ``keep``. All in minutes, multiples of the step."""

    step: int = 10
    window: int = 60
    keep: int = 90

    def __post_init__(self) -> None:
        if self.step <= 0 or self.window % self.step or self.keep % self.step or self.keep < self.window:
            raise ValueError("window and keep must be multiples of the step, and keep no less than the window")

    @property
    def step_us(self) -> int:
        return self.step * 60_000_000


CELL = "n0 long, s0 double, v0 double, n1 long, s1 double, us1 long, v1 double"


class Trailing(StatefulProcessor):
    """A cell k holds what lies in [k, k + 1) steps: n0, s0, v0 are count, sum and largest of the points at its start, n1, s1 those of the others, us1 and v1 the last of them."""

    def __init__(self, grid: Grid) -> None:
        self.grid = grid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "k long", CELL)
        self.carried = handle.getValueState("carried", "us long, value double")  # the last good value of cells that are gone
        self.due = handle.getValueState("due", "g long")  # the next grid time

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        step, first = self.grid.step_us, None
        for part in rows:
            part = part[part["value"].notna()]
            if not len(part):
                continue
            us = part["us"].astype("int64")
            k, value = us // step, part["value"]
            at_start = us == k * step
            for cell, own in part.assign(us=us, start=at_start).groupby(k, sort=True):
                held = self.cells.getValue((int(cell),)) if self.cells.containsKey((int(cell),)) else (0, 0.0, None, 0, 0.0, None, None)
                n0, s0, v0, n1, s1, us1, v1 = held
                a, b = own.loc[own["start"], "value"], own.loc[~own["start"]]
                if len(a):
                    n0, s0, v0 = n0 + len(a), s0 + float(a.sum()), max(float(a.max()), v0 if n0 else float(a.max()))
                if len(b):
                    at = int(b["us"].max())
                    last = (at, float(b.loc[b["us"] == at, "value"].max()))
                    us1, v1 = max(last, (us1, v1)) if n1 else last
                    n1, s1 = n1 + len(b), s1 + float(b["value"].sum())
                self.cells.updateValue((int(cell),), (n0, s0, v0, n1, s1, us1, v1))
                g = int(cell) if len(a) else int(cell) + 1
                first = g if first is None else min(first, g)
        if first is not None and (not self.due.exists() or first < self.due.get()[0]):
            self._await(first)
        return iter(())

    def _await(self, g: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0] * self.grid.step * 60_000)
        self.due.update((g,))
        self.handle.registerTimer(g * self.grid.step * 60_000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        """All grid times from the one that is due to the watermark."""
        step, window, keep = self.grid.step_us, self.grid.window // self.grid.step, self.grid.keep * 60_000_000
        g, until, out = self.due.get()[0], timerValues.getCurrentWatermarkInMs() * 1000 // step, []
        cells = {k[0]: c for k, c in self.cells.iterator()}
        carried = self.carried.get() if self.carried.exists() else None
        while g is not None and g <= until:
            for k in sorted(k for k in cells if k < g - window):
                carried = _last(k, cells.pop(k), step, carried)
                self.cells.removeKey((k,))
            past = [(k, c) for k, c in sorted(cells.items()) if k < g]
            here = cells.get(g)
            n = sum(c[0] + c[3] for _, c in past) + (here[0] if here else 0)
            total = sum(c[1] + c[4] for _, c in past) + (here[1] if here else 0.0)
            last = carried
            for k, c in past:
                last = _last(k, c, step, last)
            if here and here[0]:
                last = (g * step, here[2])
            if last and g * step - last[0] <= keep:
                out.append((*key, pd.Timestamp(g * step, unit="us"), n, total / n if n else None, last[1], pd.Timestamp(last[0], unit="us")))
            ahead = min((k if k > g and c[0] else k + 1 for k, c in cells.items() if k >= g and (k > g or c[3])), default=None)
            alive = last is not None and (g + 1) * step - last[0] <= keep
            g = g + 1 if alive else ahead
        if carried:
            self.carried.update(carried)
        if g is None:
            self.due.clear()
            self.cells.clear()
            self.carried.clear()
        else:
            self.due.update((g,))
            self.handle.registerTimer(g * self.grid.step * 60_000)
        return iter([pd.DataFrame(out, columns=["key", "at", "n", "mean", "last", "last_at"])]) if out else iter(())

    def close(self) -> None:
        """Nothing is held open."""


def _last(k: int, cell: tuple, step: int, before: tuple | None) -> tuple | None:
    found = (cell[5], cell[6]) if cell[3] else (k * step, cell[2]) if cell[0] else None
    return max((x for x in (found, before) if x), default=None)


def trailing(points: DataFrame, keys: Sequence[str], ts: str, value: str, grid: Grid = Grid(), late: str = "90 minutes") -> DataFrame:  # noqa: B008
    """``(<keys>, at, n, mean, last, last_at)`` for each key and grid time that follows a value by ``keep`` at most: count and mean of the values in [at - window, at], and the last value up to ``at``.

    Null, NaN and infinite values don't count; of values at one time the largest is the last. In a stream a key of the state is one unit and tag, so a unit's points spread over tasks.
    """
    v = F.col(value).cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col(ts).isNotNull()
    rows = points.where(good).select(*keys, F.col(ts).cast("timestamp").alias("ts"), v.alias("value"))
    step = grid.step_us
    if points.isStreaming:
        rows = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
        # keys go as one text, since pandas takes null keys for different ones
        own = rows.select("ts", "us", "value", F.to_json(F.struct(*keys)).alias("key"))
        out = own.groupBy("key").transformWithStateInPandas(Trailing(grid), "key string, at timestamp, n long, mean double, last double, last_at timestamp", "append", "eventtime", eventTimeColumnName="at")
        return out.withColumn("key", F.from_json("key", rows.select(*keys).schema)).select("key.*", "at", "n", "mean", "last", "last_at")
    us = F.unix_micros("ts")
    rows = rows.select(*keys, "value", us.alias("us"), F.floor(us / step).alias("k"))
    start = F.col("us") == F.col("k") * step
    cells = rows.groupBy(*keys, "k").agg(
        F.count(F.when(start, 1)).alias("n0"), F.coalesce(F.sum(F.when(start, F.col("value"))), F.lit(0.0)).alias("s0"), F.max(F.when(start, F.struct("us", "value"))).alias("l0"),
        F.count(F.when(~start, 1)).alias("n1"), F.coalesce(F.sum(F.when(~start, F.col("value"))), F.lit(0.0)).alias("s1"), F.max(F.when(~start, F.struct("us", "value"))).alias("l1"),
    )
    reach, window = grid.keep // grid.step, grid.window // grid.step
    served = cells.withColumn("g", F.explode(F.sequence(F.col("k"), F.col("k") + reach + 1)))
    later = F.col("g") > F.col("k")
    inside = F.col("k") >= F.col("g") - window
    last = F.when(later, F.greatest("l0", "l1")).otherwise(F.col("l0"))
    out = served.groupBy(*keys, "g").agg(
        F.sum(F.when(inside, F.col("n0") + F.when(later, F.col("n1")).otherwise(0)).otherwise(0)).alias("n"),
        F.sum(F.when(inside, F.col("s0") + F.when(later, F.col("s1")).otherwise(0.0))).alias("s"), F.max(last).alias("l"),
    )
    out = out.where(F.col("g") * step - F.col("l.us") <= grid.keep * 60_000_000)
    return out.select(*keys, F.timestamp_micros(F.col("g") * step).alias("at"), F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"), F.col("l.value").alias("last"), F.timestamp_micros("l.us").alias("last_at"))


def side_by_side(stats: DataFrame, unit: Sequence[str], tag: str, tags: Sequence[str], grid: Grid = Grid(), least: int = 30) -> DataFrame:  # noqa: B008
    """``(<unit>, at, <tag>_mean, <tag>_last, ...)``: one row a unit and grid time; means of fewer than ``least`` values are null."""
    slot = F.window("at", f"{grid.step} minutes").alias("slot")
    cells = []
    for t in tags:
        own = F.col(tag) == t
        cells += [F.max(F.when(own & (F.col("n") >= least), F.col("mean"))).alias(f"{t}_mean"), F.max(F.when(own, F.col("last"))).alias(f"{t}_last")]
    return stats.groupBy(*unit, slot).agg(*cells).select(*unit, F.col("slot.start").alias("at"), *[f"{t}_{k}" for t in tags for k in ("mean", "last")])


def with_ratio(rows: DataFrame, top: str, bottom: str, name: str) -> DataFrame:
    """Adds the ratio of two columns, null unless the numerator is 0 or more and the denominator above 0."""
    return rows.withColumn(name, F.when((F.col(top) >= 0) & (F.col(bottom) > 0), F.col(top) / F.col(bottom)))


def with_writeback(rows: DataFrame, flow_mean: str, flow_last: str, concentration_last: str) -> DataFrame:
    """Adds the recommended feed (ratio times mean flow) and, for the write-back, its bounds over the dry mass of the last good flow and concentration; null where that is not above 0."""
    dry = dry_mass(F.col(flow_last), F.col(concentration_last))
    dry = F.when((F.col(flow_last) > 0) & (F.col(concentration_last) > 0), dry)
    feeds: Mapping[str, Column] = {f"feed_{k}": feed(F.col(f"rec_{k}"), F.col(flow_mean)) for k in ("min", "max", "target")}
    return rows.withColumns(feeds).withColumns({"dry_mass": dry, "writeback_lower": F.col("feed_min") / dry, "writeback_upper": F.col("feed_max") / dry})
