"""Scans: tables by suffix, point files, wide files, bounds, labels, rules, and synthetic minutes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.scalars import normalise_tag, num, ordered_bounds, round_minute, row_count, row_mean, timestamp

LONG_SCHEMA = "tag string, time string, value string, quality string"
#: Encodings that point files come in, tried in this order.
ENCODINGS = ("UTF-8", "GBK", "GB18030")
PRIORITY = {"txt_long": 0, "csv_wide": 1, "xlsx_wide": 2, "xlsx_long": 3}
TIME_NAMES = ("time", "timestamp", "datetime", "ts", "tagTime", "date")


def scan_series(spark: SparkSession, path: str, time: str = "time", columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table with its time parsed and NaN as null; rows without a time go. Nothing is sorted here: order belongs to windows."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(time, *[c for c in columns if c != time])
    if dict(df.dtypes)[time] == "string":
        df = df.withColumn(time, timestamp(F.col(time)))
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    return df.where(F.col(time).isNotNull())


def read_table(spark: SparkSession, path: str, schema: str | None = None, rows: int | None = None) -> DataFrame:
    """By suffix: Parquet, JSON (lines, a list or an object), CSV as text, ORC. A missing path gives no rows if a schema is given."""
    kind = path.rsplit(".", 1)[-1].lower()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if schema and not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read
    df = {"json": lambda: reader.option("multiLine", True).json(path), "jsonl": lambda: reader.json(path), "csv": lambda: reader.option("header", True).csv(path), "tsv": lambda: reader.option("header", True).option("sep", "\t").csv(path), "orc": lambda: reader.orc(path)}.get(kind, lambda: reader.parquet(path))()
    return df.limit(rows) if rows is not None else df


def read_points(spark: SparkSession, paths: str | list[str], tags: Sequence[str] | None = None, encoding: str = "UTF-8", drop_prefix: str | None = "B4_") -> DataFrame:
    """Point files without a header, ``tag, time, value, quality``: normalised tags, parsed times, the last value of each tag and time."""
    raw = spark.read.schema(LONG_SCHEMA).option("sep", "\t").option("encoding", encoding).csv(paths)
    rows = raw.select(normalise_tag(F.col("tag"), drop_prefix).alias("tag"), timestamp(F.col("time")).alias("time"), num(F.col("value")).alias("value"), F.monotonically_increasing_id().alias("seq"))
    rows = rows.where("time is not null")
    if tags is not None:
        rows = rows.where(F.col("tag").isin(*tags))
    return rows.groupBy("tag", "time").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("value"))


def read_wide(spark: SparkSession, path: str, names: Mapping[str, str], time: str = "time") -> DataFrame:
    """A wide CSV; ``names`` gives the variable of each column."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(timestamp(F.col(time)).alias("time"), *[num(F.col(f"`{c}`")).alias(v) for c, v in names.items() if c in raw.columns]).where("time is not null")


def parse_rates(df: DataFrame, time: str, value: str, file: str = "file") -> DataFrame:
    """Share of rows of each file whose time and value parse, for choosing the encoding: a file below 0.8 in either is rejected."""
    out = df.groupBy(file).agg(F.count("*").alias("n"), F.avg(timestamp(F.col(time)).isNotNull().cast("int")).alias("time_rate"), F.avg(num(F.col(value)).isNotNull().cast("int")).alias("value_rate"))
    return out.withColumn("accepted", (F.col("time_rate") >= 0.8) & (F.col("value_rate") >= 0.8))


def minute_means(df: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.date_trunc("minute", time).cast("timestamp_ntz").alias("minute")).agg(F.avg(value).alias(value))


def point_specs(df: DataFrame, variable: str, tag: str, status: str, a: str, b: str) -> DataFrame:
    """Dimension of points: bounds in order, both or none."""
    lower, upper = ordered_bounds(num(F.col(a)), num(F.col(b)))
    return df.select(F.col(variable).alias("variable"), normalise_tag(F.col(tag), "B4_").alias("tag"), F.col(status).alias("status"), lower.alias("lower"), upper.alias("upper"))


def pick_sources(found: DataFrame) -> DataFrame:
    """Of ``(tag, kind, path)``, one source for each tag: long text files before wide CSV before workbooks."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")], F.lit(9))
    w = Window.partitionBy("tag").orderBy(rank, "path")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def discover(spark: SparkSession, glob: str, kind: str) -> DataFrame:
    """``(tag, kind, path)`` of files whose stem is a tag."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select(normalise_tag(stem, "B4_").alias("tag"), F.lit(kind).alias("kind"), "path")


def parse_holdout(points: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Long points to a wide table: friendly names, mean of each time; one pivot does the n-way outer join."""
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("tag")]
    return points.withColumn("point", name).where("point is not null").groupBy("time").pivot("point", sorted(set(names.values()))).agg(F.avg("value"))


def lab_labels(sheets: Mapping[str, DataFrame], time: str, value: str) -> DataFrame:
    """Labels of several lines by minute (half to even): the mean of each line, their row mean ``t90`` and ``t90_label_count``."""
    long = None
    for line, df in sheets.items():
        part = df.select(round_minute(F.col(time)).alias("time"), F.lit(f"t90_{line}").alias("line"), num(F.col(value)).alias("value")).where("time is not null and value is not null")
        long = part if long is None else long.unionByName(part)
    lines = [f"t90_{line}" for line in sheets]
    wide = long.groupBy("time").pivot("line", lines).agg(F.avg("value"))
    cols = [F.col(c) for c in lines]
    return wide.withColumns({"t90": row_mean(*cols), "t90_label_count": row_count(*cols)})


RULE = "struct<rule_id:string,feature:string,bin:string,dose_min:double,dose_max:double,grade:string,status:string,time_stable:boolean,sample_count:int,ok_rate:double>"
ARTIFACT = f"rules array<{RULE}>, boundaries map<string,struct<q33:double,q66:double>>"


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules and boundaries of an artifact file as two small tables."""
    doc = spark.read.schema(ARTIFACT).option("multiLine", True).json(path)
    return doc.select(F.explode("rules").alias("r")).select("r.*"), doc.select(F.explode("boundaries").alias("feature", "b")).select("feature", "b.*")


def infer_time_column(df: DataFrame, preferred: str | None = None) -> str:
    lower = {c.lower(): c for c in df.columns}
    for name in (*([preferred] if preferred else []), *TIME_NAMES):
        if name.lower() in lower:
            return lower[name.lower()]
    raise ValueError(f"no time column among {df.columns}")


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first column that equals a candidate without regard to case and white space, else one that contains it."""
    plain = {"".join(c.lower().split()): c for c in columns}
    wanted = ["".join(c.lower().split()) for c in candidates]
    return next((plain[w] for w in wanted if w in plain), None) or next((c for w in wanted for p, c in plain.items() if w in p), None)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {lacking}; there are {df.columns}")
    return df


def synthetic_minutes(spark: SparkSession, n: int = 80, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """A row a minute with plausible values, for smoke tests."""
    i = F.col("id")
    return spark.range(n).select(
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=i.cast("int"))).alias("time"), (1000 + 50 * F.sin(i / 10)).alias("ca"), (130 + 5 * F.cos(i / 7)).alias("esbo_feed"),
        (45000 + 1000 * F.sin(i / 15)).alias("rubber_flow_2"), (18 + F.cos(i / 9)).alias("tank_rubber_conc"), (42 + F.sin(i / 5)).alias("r510a_temp"),
    )


def staged_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """Path, length and SHA-256 of staged files, to hold against a manifest."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"))
