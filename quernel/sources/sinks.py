"""Sinks: tables, strict JSON, and rows for a write-back that callers switch on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    out = df.write.mode("overwrite")
    {"parquet": out.parquet, "json": out.json, "orc": out.orc, "csv": lambda p: out.option("header", True).csv(p), "tsv": lambda p: out.option("sep", "\t").csv(p)}[kind](path)


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls, with ``replaced``, how many a row had."""
    cols = [c for c, t in df.dtypes if t in ("double", "float")]
    bad: dict[str, Column] = {c: F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in cols}
    n = sum((F.coalesce(b.cast("int"), F.lit(0)) for b in bad.values()), F.lit(0))
    return df.withColumn("replaced", n).withColumns({c: F.when(b, None).otherwise(F.col(c)) for c, b in bad.items()})


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def writeback_rows(df: DataFrame, ts: str, tags: dict[str, str]) -> DataFrame:
    """``(tag, time, value)`` of the values to write back; nulls and NaN are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).cast("double").alias("value")) for c, t in tags.items()]))
    return df.select(F.col(ts).alias("time"), cells.alias("r")).select("r.tag", "time", "r.value").where("value is not null and not isnan(value)")


def foreach_batch(sink: Callable[[DataFrame, int], None] | None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: nothing is written unless a sink is given."""
    return sink or (lambda df, epoch: None)


def non_null_share(df: DataFrame, columns: Sequence[str], phrases: str | None = None) -> DataFrame:
    """Share of rows with all required outputs, and whether any row holds a forbidden phrase."""
    whole = F.avg(F.expr(" and ".join(f"`{c}` is not null" for c in columns)).cast("int")).alias("complete_share")
    said = F.coalesce(F.bool_or(F.to_json(F.struct(*df.columns)).rlike(phrases)) if phrases else F.lit(False), F.lit(False)).alias("forbidden")
    return df.agg(whole, said)
