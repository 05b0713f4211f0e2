"""Global order by hash-random keys without a global sort task: fixed key ranges, totals per range, offsets.

A key holds 60 bits of an md5 digest, so equal ranges of keys hold equal shares of the rows, whatever the ids look
like. The order depends on the hashed columns and the seed alone, never on files, partitions or reruns. Rows that
repeat in all of these share a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 60
#: Key ranges in each group: a group with a third of 3e10 rows still has only some millions of rows in each.
RANGE_BITS = 12


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their names as they are, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def random_key(seed: int, *cols: Column) -> Column:
    """60-bit hash of the columns as text; null counts as a value of its own."""
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def key_range(key: Column) -> Column:
    return F.shiftright(key, KEY_BITS - RANGE_BITS)


def range_offsets(df: DataFrame, group: Sequence[str], key: str, value: Column) -> DataFrame:
    """One row for each group and key range: ``offset``, the group's sum of ``value`` in all earlier ranges, and
    ``total``, the group's whole sum. At most 4096 rows a group, so the windows here stay small."""
    w = Window.partitionBy(*group)
    return (
        df.groupBy(*group, key_range(F.col(key)).alias("key_range"))
        .agg(F.sum(value).alias("range_sum"))
        .withColumns({
            "offset": F.coalesce(F.sum("range_sum").over(w.orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("range_sum").over(w),
        })
        .drop("range_sum")
    )


def with_running_sum(df: DataFrame, offsets: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], value: Column) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the rows of the group that come earlier in key order, and the columns
    of ``offsets``. Rows equal in key and ties may change places, which leaves the result's rows as they are."""
    w = Window.partitionBy(*group, "key_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    left = df.withColumn("key_range", key_range(F.col(key))).withColumn("inner_before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    right = offsets.withColumnsRenamed({c: f"__{c}" for c in (*group, "key_range")})
    on = F.col("key_range") == F.col("__key_range")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, on).withColumn("before", F.col("offset") + F.col("inner_before")).drop("inner_before", "offset", "key_range", "__key_range", *[f"__{c}" for c in group])
