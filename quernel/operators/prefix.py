"""Order statistics of all that was visible before each row, exact, in many tasks.

The rows of a key are cut twice: by time into blocks, and by value into ranges (cut points of approximate quantiles and the open ranges between them, so that a value that half of all rows have is a
range of its own). Counts of each range before each block are prefix sums. A block's task then knows, for each of its rows, in which range an order statistic lies and the how-manieth of that range it
is. Where the range is one value, that is the answer. Of the others the earlier values are brought to the block: its rows' statistics lie in few ranges, since a block moves a rank by its own rows at most.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators import series
from quernel.operators.series import join_small, largest_key, numbered, present
from quernel.sources.shared import materialize

#: Order statistics that a task looks up at a time, about.
LOOKUPS = 1_000_000
#: Blocks of one task, about; its memory doesn't grow with the table.
TASK_BLOCKS = 8
MOST_RANGES = 1024


def order_statistics(value_at: np.ndarray, values: np.ndarray, asked_at: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """For each question, in the order of its place: the k-th smallest, from 0, of the values whose place is before its own. Values come by place."""
    held: list[float] = []
    out, taken = np.empty(len(ks)), 0
    until = np.searchsorted(value_at, asked_at, side="left")
    given = values.tolist()
    for j, (to, k) in enumerate(zip(until.tolist(), ks.tolist(), strict=True)):
        if to - taken > 64 and 8 * (to - taken) > len(held):
            held = sorted(held + given[taken:to])  # two runs, merged
        else:
            for v in given[taken:to]:
                insort(held, v)
        taken = max(taken, to)
        out[j] = held[k]
    return out


def prefix_ranges(counts: np.ndarray, codes: np.ndarray, until: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each question, the range that holds the k-th smallest, from 0, of all that ``counts`` counts and the first ``until`` of ``codes``, and the place inside that range: bits of the codes are fixed from the
    highest on, by counts of those that go on with a 0, in the order that the bits before have given them."""
    bits = max(1, len(counts) - 1).bit_length()
    sums = np.zeros((1 << bits) + 1, np.int64)
    sums[1 : len(counts) + 1] = np.cumsum(counts)
    sums[len(counts) + 1 :] = sums[len(counts)]
    code, k = np.zeros(len(ks), np.int64), ks.astype(np.int64)
    first, last = np.zeros(len(ks), np.int64), until.astype(np.int64)
    for bit in reversed(range(bits)):
        one = (codes >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        first0, last0 = zeros[first], zeros[last]
        low = sums[code + (1 << bit)] - sums[code] + last0 - first0
        up = k >= low
        k -= np.where(up, low, 0)
        code += np.where(up, 1 << bit, 0)
        first, last = (np.where(up, zeros[-1] + x - x0, x0) for x, x0 in ((first, first0), (last, last0)))
        codes = np.concatenate((codes[~one], codes[one]))
    return code, k


def _places(n: np.ndarray, fractions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n values each: the places of the quantiles, and the ranks below and above, two a quantile."""
    at = (n[:, None] - 1) * fractions
    return at, np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)


def _between(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[list[float]]:
    """Quantiles on the line between the values of the ranks below and above."""
    with np.errstate(invalid="ignore"):
        return np.where(np.floor(at) == at, lo, (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi).tolist()


def prefix_quantiles(df: DataFrame, keys: Sequence[str], ts_us: str, value: str, fractions: Sequence[float], delay_us: int = 0, least: int = 1, out: str = "q", count: str = "n_visible") -> DataFrame:
    """Adds ``n_visible``, the number of rows of the same key whose time is ``delay_us`` or more before the row's and whose value is neither null nor NaN, and ``q``, the exact quantiles of these values,
    linear between ranks; null below ``least`` values.

    Times are numbers (microseconds). Rows without a time are seen by none and see none. Where the largest key fits one task, a task works on a key.
    """
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "prefix-rows")
    v = F.col(value).cast("double")
    seen = present(rows.select(*keys, F.col(ts_us).cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row"), v.alias("v")), "v")
    asked = rows.select(*keys, (F.col(ts_us) - delay_us).cast("long").alias("at"), F.lit(1).alias("kind"), F.col("__row").alias("row"), F.lit(None).cast("double").alias("v"))
    events = seen.unionByName(asked).where("at is not null")
    found = (_in_one_task_a_key if largest_key(rows, keys) <= series.BLOCK_ROWS else _in_blocks)(events, keys, [float(f) for f in fractions], least)
    per = found.select(F.col("row").alias("__row"), F.col("n").alias("__n"), F.col("q").alias("__q"))
    return rows.join(per, "__row", "left").select(*df.columns, F.coalesce("__n", F.lit(0)).cast("long").alias(count), F.col("__q").alias(out))


ANSWER = "row long, n long, q array<double>"


def _answers(rows: np.ndarray, until: np.ndarray, n: np.ndarray, least: int, slots: int, quantiles: Callable[[np.ndarray, np.ndarray], list[list[float]]]) -> pd.DataFrame:
    """A row for each question, ``until`` ascending: those that see the same values are looked up once."""
    states, back = np.unique(until, return_inverse=True)
    seen = np.zeros(len(states), np.int64)
    seen[back] = n
    known = np.flatnonzero(seen >= max(1, least))
    q = np.full(len(states), None, object)
    step = max(1, LOOKUPS // (2 * slots))
    for at in range(0, len(known), step):
        some = known[at : at + step]
        for i, x in zip(some.tolist(), quantiles(states[some], seen[some]), strict=True):
            q[i] = x
    return pd.DataFrame({"row": rows, "n": n, "q": q[back]})


def _in_one_task_a_key(events: DataFrame, keys: Sequence[str], fractions: Sequence[float], least: int) -> DataFrame:
    def answer(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "kind"], kind="stable")
        is_value = (part["kind"] == 0).to_numpy()
        values = part["v"].to_numpy()[is_value]
        until = np.cumsum(is_value)[~is_value]

        def quantiles(states: np.ndarray, n: np.ndarray) -> list[list[float]]:
            at, lo, hi = _places(n, np.array(fractions))
            ks = np.concatenate([lo, hi], axis=1)
            found = order_statistics(np.arange(len(values)), values, np.repeat(states, ks.shape[1]), ks.ravel()).reshape(ks.shape)
            return _between(at, found[:, : len(fractions)], found[:, len(fractions) :])

        return _answers(part["row"].to_numpy()[~is_value], until, until, least, len(fractions), quantiles)

    return events.groupBy(*keys).applyInPandas(answer, ANSWER)


def _in_blocks(events: DataFrame, keys: Sequence[str], fractions: Sequence[float], least: int) -> DataFrame:
    size = series.BLOCK_ROWS
    events = numbered(events, keys, ["at", "kind"]).withColumn("block", F.floor((F.col("__i") - 1) / size)).withColumnRenamed("__i", "i")
    names = [f"k{j}" for j in range(len(keys))]
    events = events.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    ranges = int(min(MOST_RANGES, max(4, (largest_key(events, names) / 2) ** 0.5)))
    cuts = events.where("kind = 0").groupBy(*names).agg(F.array_distinct(F.percentile_approx("v", [j / ranges for j in range(1, ranges)], 100 * ranges)).alias("cuts"))
    cuts = materialize(cuts, "prefix-cuts")
    coded = join_small(events.where("kind = 0"), cuts, names).withColumn("below", F.lit(0))
    for step in (1 << j for j in reversed(range(ranges.bit_length()))):  # cuts below the value, which ascend, by halves
        coded = coded.withColumn("below", F.col("below") + F.when(F.get("cuts", F.col("below") + (step - 1)) < F.col("v"), step).otherwise(0))
    on = F.coalesce((F.get("cuts", F.col("below")) == F.col("v")).cast("int"), F.lit(0))
    coded = materialize(coded.select(*names, "block", "i", "v", (2 * F.col("below") + on).cast("int").alias("code")), "prefix-values")

    # values of each range before each block, for all blocks and ranges
    grid = join_small(events.select(*names, "block").distinct(), cuts, names).withColumn("code", F.explode(F.sequence(F.lit(0), 2 * F.size("cuts")))).drop("cuts")
    counts = coded.groupBy(*names, "block", "code").count()
    w = Window.partitionBy(*names, "code").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = join_small(grid, counts, [*names, "block", "code"], "left").withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    before = before.groupBy(*names, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "before"))), lambda x: x["before"]).alias("before"))  # 2 * ranges numbers
    before = materialize(join_small(before, cuts, names), "prefix-counts")  # a row a block, read twice
    tasks = -(-before.count() // TASK_BLOCKS)
    asked = events.where("kind = 1").select(*names, "block", "i", F.lit(1).alias("kind"), F.lit(-1).alias("code"), "row", F.lit(None).cast("double").alias("v"))
    both = coded.select(*names, "block", "i", F.lit(0).alias("kind"), "code", F.lit(-1).cast("long").alias("row"), "v").unionByName(asked)
    blocks = lambda df: df.repartition(tasks, *names, "block").groupBy(*names, "block")

    def parted(rows: pd.DataFrame, counted: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
        """The block's values and questions in order of time, counts of the ranges before, and the values before each question."""
        values, questions = (rows[rows["kind"] == kind].sort_values("i") for kind in (0, 1))
        return values, questions, np.array(counted["before"].iloc[0], np.int64), np.searchsorted(values["i"].to_numpy(), questions["i"].to_numpy())

    def ranges_at(hist: np.ndarray, code: np.ndarray, states: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        at, lo, hi = _places(n, np.array(fractions))
        ks = np.concatenate([lo, hi], axis=1)
        states = np.repeat(states, ks.shape[1])
        return at, states, *prefix_ranges(hist, code, states, ks.ravel())

    def needed(group: tuple, rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        codes = np.zeros(0, np.int64)
        if len(rows) and len(counted):
            values, _, hist, until = parted(rows, counted)
            states = np.unique(until)
            states = states[hist.sum() + states >= max(1, least)]
            step = max(1, LOOKUPS // (2 * len(fractions)))
            some = [np.unique(ranges_at(hist, values["code"].to_numpy(), states[j : j + step], hist.sum() + states[j : j + step])[2]) for j in range(0, len(states), step)]
            codes = np.unique(np.concatenate([codes, *some]))
        out = pd.DataFrame({"target": group[len(names)], "code": codes[codes % 2 == 0]})
        for j, name in enumerate(names):
            out.insert(j, name, group[j])
        return out

    types = ", ".join(f"{n} {t}" for n, t in events.dtypes if n in names)
    wanted = blocks(both.drop("row", "v")).cogroup(blocks(before)).applyInPandas(needed, ", ".join(x for x in (types, "target long, code int") if x))
    earlier = join_small(coded, wanted, [*names, "code"]).where("block < target")
    earlier = earlier.select(*names, F.col("target").alias("block"), "i", F.lit(2).alias("kind"), "code", F.lit(-1).cast("long").alias("row"), "v")

    def answer(rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(counted):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("row", "n", "q")})
        values, asked, hist, until = parted(rows, counted)
        code, v = values["code"].to_numpy(), values["v"].to_numpy()
        held = {c: x.to_numpy() for c, x in rows[rows["kind"] == 2].groupby("code")["v"]}
        edges = np.array([*counted["cuts"].iloc[0], np.nan])

        def quantiles(states: np.ndarray, n: np.ndarray) -> list[list[float]]:
            at, states, c, k = ranges_at(hist, code, states, n)
            found = edges[c // 2]
            order = np.argsort(c, kind="stable")  # within a range by time
            for some in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
                if (one := c[some[0]]) % 2 == 0:
                    own, old = np.flatnonzero(code == one), held.get(one, np.zeros(0))
                    found[some] = order_statistics(np.concatenate((np.full(len(old), -1), own)), np.concatenate((old, v[own])), states[some], k[some])
            found = found.reshape(at.shape[0], -1)
            return _between(at, found[:, : len(fractions)], found[:, len(fractions) :])

        return _answers(asked["row"].to_numpy(), until, hist.sum() + until, least, len(fractions), quantiles)

    return blocks(both.unionByName(earlier)).cogroup(blocks(before)).applyInPandas(answer, ANSWER)
