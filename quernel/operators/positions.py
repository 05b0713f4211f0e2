"""Joins by place: rows numbered in the order of their files, zipped side by side, and joins on time that fall back to places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.series import join_small, numbered
from quernel.sources.shared import materialize


def file_numbered(df: DataFrame, name: str = "row_number", files: Sequence[str] | None = None) -> DataFrame:
    """Adds each row's number from 0 in the order of the files' paths (or of ``files``, the ends of paths) and of the rows in them. ``df`` reads files and nothing else: no filter, no shuffle. Splits are
    counted and their counts added up, so there is no sort: a split is read from front to back by one task."""
    own = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    rows = materialize(own, "file-rows")
    place = F.col("__file") if files is None else F.coalesce(*[F.when(F.col("__file").endswith(f), F.lit(i)) for i, f in enumerate(files)], F.lit(len(files)))
    splits = rows.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    w = Window.orderBy(place, "__file", "__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    out = join_small(rows, splits, ["__file", "__block"])
    return out.select(*df.columns, (F.col("__before") + F.col("__id") - F.col("__first")).alias(name))


def with_suffix(left: DataFrame, right: DataFrame, on: Sequence[str] = (), suffix: str = "_right") -> DataFrame:
    """``right`` with the columns that ``left`` has too, but ``on``, renamed by the suffix, again and again until the name is free."""
    taken, names = set(left.columns), {}
    for c in right.columns:
        new = c
        while c not in on and (new in taken or (new != c and new in right.columns)):
            new = f"{new}{suffix}"
        taken.add(new)
        names[c] = new
    return right.withColumnsRenamed({c: n for c, n in names.items() if c != n})


def zip_rows(left: DataFrame, right: DataFrame, left_at: str, right_at: str, suffix: str = "_right") -> DataFrame:
    """Rows of the same number (two columns of gapless numbers, such as ``file_numbered`` gives) side by side; columns of the same name get the suffix, and the numbers stay as ``left_at``. Stops if the
    tables differ in length."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be zipped with {m}")
    other = right.withColumnRenamed(right_at, "__at")
    other = with_suffix(left, other, ["__at"], suffix)
    out = left.join(other, left[left_at] == other["__at"]).drop("__at")
    return out


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_right", supplement: bool = False) -> DataFrame:
    """Left join on the columns ``on``; of columns of the same name the right one gets the suffix or, to ``supplement``, is left out, so only columns that ``left`` lacks are added."""
    if supplement:
        right = right.select(*on, *[c for c in right.columns if c not in left.columns])
    return left.join(with_suffix(left, right, on, suffix), list(on), "left")


def joined_or_zipped(left: DataFrame, right: DataFrame, on: str, left_order: Sequence[str], right_order: Sequence[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Join on the time ``on`` if that loses no row of ``left`` and repeats none; else, if both tables have the same length, rows are zipped in their given orders, and ``right``'s time gets the suffix.
    Otherwise the join stays as lossy as it is. Adds ``joined_by``: ``key`` or ``position``."""
    met = left.join(with_suffix(left, right, [on], suffix), on, how)
    n = left.count()
    keyed = left.join(right.select(on), on, "inner").count()
    if keyed == n or right.count() != n:
        return met.withColumn("joined_by", F.lit("key"))
    a, b = (numbered(df, [], order).withColumnRenamed("__i", "__place") for df, order in ((left, left_order), (right, right_order)))
    return zip_rows(a, b, "__place", "__place", suffix).drop("__place").withColumn("joined_by", F.lit("position"))


def exact_value(left: DataFrame, right: DataFrame, ts: str, value: str, order: Sequence[str], out: str) -> DataFrame:
    """Adds the right value at exactly the left time: that of the first right row of the time in the order given; null if there is none or it isn't finite."""
    v = F.col(value).cast("double")
    first = right.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("__ts")).agg(F.min_by(v, F.struct(*order)).alias("__v"))
    fine = F.when(~F.isnan("__v") & (F.abs("__v") < float("inf")), F.col("__v"))
    return left.join(first, left[ts] == first["__ts"], "left").withColumn(out, fine).drop("__ts", "__v")


def looked_up(key: Column, table: Mapping[str, object]) -> Column:
    """The table's value of a key, null for others: a dictionary of fixed size as an expression."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None)
