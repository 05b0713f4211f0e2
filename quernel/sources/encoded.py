"""Text files in unknown encodings. Lines are read as bytes in splits of the files; a file's encoding is the first of ``ENCODINGS`` that decodes all of its lines, wherever they were read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.scalars import normalise_tag, num, timestamp
from quernel.sources.shared import materialize
from quernel.sources.tables import ENCODINGS

LEAST_RATE = 0.8


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, block, nth, line)``: bytes of each line; (block, nth) is the order of a file's lines. Line ends, tabs and commas are the same bytes in all the encodings."""
    read = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("line"))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of lines of one file: how many there are, whether each encoding decodes them, and the most tabs and commas of a line."""
    for batch in batches:
        files, lines, rows = batch.column("file").to_pylist(), batch.column("line").to_pylist(), []
        cuts = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)] if files else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, decoded = lines[a:b], []
            for e in ENCODINGS:
                try:
                    b"\n".join(own).decode(e)
                    decoded.append(True)
                except UnicodeDecodeError:
                    decoded.append(False)
            rows.append((files[a], b - a, *decoded, max(x.count(b"\t") for x in own), max(x.count(b",") for x in own)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.string(), pa.int64(), *[pa.bool_()] * len(ENCODINGS), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "n", *[f"e{i}" for i in range(len(ENCODINGS))], "tabs", "commas"])


def file_encodings(lines: DataFrame) -> DataFrame:
    """``(file, n, encoding, tabs, commas)``: null where no encoding decodes the whole file; most tabs and commas of a line."""
    flags = ", ".join(f"e{i} boolean" for i in range(len(ENCODINGS)))
    seen = lines.select("file", "line").mapInArrow(_seen, f"file string, n long, {flags}, tabs long, commas long")
    per = seen.groupBy("file").agg(F.sum("n").alias("n"), *[F.bool_and(f"e{i}").alias(f"e{i}") for i in range(len(ENCODINGS))], F.max("tabs").alias("tabs"), F.max("commas").alias("commas"))
    first = F.coalesce(*[F.when(F.col(f"e{i}"), e) for i, e in enumerate(ENCODINGS)])
    return per.select("file", "n", first.alias("encoding"), "tabs", "commas")


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        encodings, lines, out = batch.column("encoding").to_pylist(), batch.column("line").to_pylist(), []
        cuts = [0, *[i for i in range(1, len(lines)) if encodings[i] != encodings[i - 1]], len(lines)] if lines else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out += [None] * (b - a) if encodings[a] is None else [x.removeprefix("\ufeff") for x in b"\n".join(lines[a:b]).decode(encodings[a]).split("\n")]
        kept = [n for n in batch.schema.names if n not in ("line", "encoding")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(out, pa.string())], names=[*kept, "text"])


def _decoded(lines: DataFrame) -> DataFrame:
    """``line`` in its ``encoding`` as ``text``, after the other columns; the JVM's own decoder knows neither GBK nor GB18030."""
    kept = [f"{n} {t}" for n, t in lines.dtypes if n not in ("line", "encoding")]
    return lines.mapInArrow(_text, ", ".join([*kept, "text string"]))


def read_encoded_points(spark: SparkSession, paths: str | Sequence[str], drop_prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points of files without a header, parted by tabs or commas: ``tag, time, value, ...``, or ``time, value`` of the tag that the file is called after.

    The first table is ``(file, tag, time, value)``, rows without a time left out; the second has a row a file: ``(file, encoding, rows, tag_value, time_min, time_max, parse_error)``, with the error of
    files that no encoding decodes or that have one column. Empty files have no lines and no row.
    """
    lines = _lines(spark, paths)
    files = materialize(file_encodings(lines), "file-encodings")
    comma = (F.col("tabs") == 0) | ((F.col("tabs") < 2) & (F.col("commas") >= 2))
    files = files.withColumn("sep", F.when(comma, ",").otherwise("\t")).withColumn("columns", F.when(comma, F.col("commas")).otherwise(F.col("tabs")) + 1)
    error = F.when(F.col("encoding").isNull(), "no encoding decodes the file").when(F.col("columns") < 2, "fewer than two columns")
    files = files.withColumn("parse_error", error)
    good = lines.join(files.where("parse_error is null").select("file", "encoding", "sep", "columns"), "file")
    good = _decoded(good).withColumn("cells", F.split("text", F.col("sep"), -1))
    three = F.col("columns") >= 3
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    cell = lambda i: F.trim(F.get("cells", F.lit(i)))
    rows = good.select("file", "block", "nth", F.when(three, cell(0)).otherwise(stem).alias("raw_tag"), timestamp(F.when(three, cell(1)).otherwise(cell(0))).alias("time"), num(F.when(three, cell(2)).otherwise(cell(1))).alias("value"))
    points = rows.where("time is not null").select("file", normalise_tag(F.col("raw_tag"), drop_prefix).alias("tag"), "time", "value")
    told = rows.groupBy("file").agg(F.count("time").alias("rows"), F.min_by("raw_tag", F.struct("block", "nth")).alias("tag_value"), F.min("time").alias("time_min"), F.max("time").alias("time_max"))
    return points, files.join(told, "file", "left").select("file", "encoding", F.coalesce("rows", F.lit(0)).alias("rows"), "tag_value", "time_min", "time_max", "parse_error")


def read_first_and_last(spark: SparkSession, paths: str | Sequence[str], least: float = LEAST_RATE) -> tuple[DataFrame, DataFrame]:
    """CSV files with a header whose first column is a time and whose last is a value, whatever lies between.

    The first table is ``(file, minute, value)``, the mean of each minute, of accepted files; the second has a row a file: ``(file, encoding, n, columns, time_name, value_name, time_rate, value_rate,
    accepted)``. A file is accepted if an encoding decodes it, it has two columns and the times and the values of ``least`` of its rows can be read.
    """
    lines = _lines(spark, paths)
    files = materialize(file_encodings(lines), "file-encodings")
    cells = F.split("text", ",", -1)
    plain = lambda c: F.trim(F.regexp_replace(c, '^"|"$', ""))
    held = _decoded(lines.join(files.select("file", "encoding"), "file")).withColumn("cells", cells)
    held = held.select("file", "block", "nth", F.size("cells").alias("columns"), plain(F.get("cells", F.lit(0))).alias("first"), plain(F.element_at("cells", -1)).alias("last"))
    header = held.groupBy("file").agg(F.min(F.struct("block", "nth")).alias("at"), F.min_by(F.struct("columns", "first", "last"), F.struct("block", "nth")).alias("header"))
    data = held.join(header, "file").where(F.struct("block", "nth") != F.col("at")).select("file", timestamp(F.col("first")).alias("time"), num(F.col("last")).alias("value"))
    rates = data.groupBy("file").agg(F.count("*").alias("n"), F.avg(F.col("time").isNotNull().cast("int")).alias("time_rate"), F.avg(F.col("value").isNotNull().cast("int")).alias("value_rate"))
    told = files.select("file", "encoding").join(header, "file").join(rates, "file", "left")
    known = F.col("encoding").isNotNull() & (F.col("header.columns") >= 2)
    fine = known & F.coalesce((F.col("time_rate") >= least) & (F.col("value_rate") >= least), F.lit(False))
    told = told.select("file", "encoding", F.coalesce("n", F.lit(0)).alias("n"), F.col("header.columns").alias("columns"), F.col("header.first").alias("time_name"), F.col("header.last").alias("value_name"), F.coalesce("time_rate", F.lit(0.0)).alias("time_rate"), F.coalesce("value_rate", F.lit(0.0)).alias("value_rate"), fine.alias("accepted"))
    told = materialize(told, "file-rates")
    minutes = data.where("time is not null").join(told.where("accepted").select("file"), "file").groupBy("file", F.date_trunc("minute", "time").cast("timestamp_ntz").alias("minute")).agg(F.avg("value").alias("value"))
    return minutes, told
