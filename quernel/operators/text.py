"""Sections of text documents: repeated bodies, near repeats under one title, wording scans, and inventories of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sections(docs: DataFrame, key: str, text: str, heading: str = r"\n(?=#)", titled: bool = True) -> DataFrame:
    """``(key, position, title, body)`` of the sections that headings begin; bodies without white space at ends and in runs. Sections that aren't ``titled`` have an empty title and are
    all body."""
    parts = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), heading)).alias("position", "section"))
    if not titled:
        return parts.select(key, "position", F.lit("").alias("title"), F.trim(F.regexp_replace("section", r"\s+", " ")).alias("body"))
    return parts.select(key, "position", F.trim(F.substring_index("section", "\n", 1)).alias("title"), F.trim(F.regexp_replace(F.substr(F.col("section"), F.length(F.substring_index("section", "\n", 1)) + 1), r"\s+", " ")).alias("body"))


def repeated_bodies(parts: DataFrame, key: str) -> DataFrame:
    """Sections whose body another section has before them, by (key, position)."""
    hashed = parts.withColumn("hash", F.sha2("body", 256))
    first = hashed.groupBy("hash").agg(F.min(F.struct(key, "position")).alias("first"))
    return hashed.join(first, "hash").where(F.struct(key, "position") != F.col("first")).select(key, "position", "title", F.col(f"first.{key}").alias("first_key"), F.col("first.position").alias("first_position"))


def near_repeats(parts: DataFrame, key: str, ratio: float = 0.98, most_apart: int = 20) -> DataFrame:
    """Pairs of sections with one title, lengths within ``most_apart`` and an edit ratio of ``ratio`` or more. Pairs meet only on title and length
    range, each section in its own range and the next."""
    p = parts.withColumn("n", F.length("body")).withColumn("range", F.floor(F.col("n") / (most_apart + 1)))
    a = p.alias("a")
    b = p.withColumn("range", F.explode(F.array("range", F.col("range") - 1, F.col("range") + 1))).alias("b")
    apart = F.abs(F.col("a.n") - F.col("b.n"))
    before = F.struct(F.col(f"a.{key}"), F.col("a.position")) < F.struct(F.col(f"b.{key}"), F.col("b.position"))
    met = a.join(b, (F.col("a.title") == F.col("b.title")) & (F.col("a.range") == F.col("b.range")) & (apart <= most_apart) & before)
    score = 1 - F.levenshtein("a.body", "b.body") / F.greatest(F.col("a.n"), F.col("b.n"), F.lit(1))
    return met.select(F.col(f"a.{key}").alias("key_a"), F.col("a.position").alias("position_a"), F.col(f"b.{key}").alias("key_b"), F.col("b.position").alias("position_b"), score.alias("ratio")).where(F.col("ratio") >= ratio)


def scan_wording(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Lines that match, with their numbers from 1."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(key, (F.col("i") + 1).alias("line_number"), "line")


def inventory(df: DataFrame) -> DataFrame:
    """``(column, kind, n, n_null)`` of every column."""
    flat = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.col(c).alias("n")) for c, t in df.dtypes]))
    return flat.select("__n", cells.alias("c")).select("c.*", (F.col("__n") - F.col("c.n")).alias("n_null"))
