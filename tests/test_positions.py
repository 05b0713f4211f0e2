"""Rows by their places in files, zips, and joins that fall back to places."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from quernel.operators import positions as P


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_keep_the_order_of_their_files(spark, tmp_path, small_splits):
    for name, a, b in (("b.csv", 0, 100), ("a.csv", 100, 170), ("c.csv", 170, 171)):
        (tmp_path / name).write_text("".join(f"{i},x{i}\n" for i in range(a, b)))
    df = spark.read.schema("v long, s string").csv(str(tmp_path))
    got = P.file_numbered(df)
    assert df.rdd.getNumPartitions() > 5 and got.columns == ["v", "s", "row_number"]
    assert [r["v"] for r in got.orderBy("row_number").collect()] == [*range(100, 170), *range(100), 170]
    assert [r["row_number"] for r in got.orderBy("row_number").collect()] == list(range(171))
    ordered = P.file_numbered(df, files=["/b.csv", "/a.csv"]).orderBy("row_number")
    assert [r["v"] for r in ordered.collect()] == list(range(171))


def test_zip_keeps_order_and_stops_on_lengths(spark, tmp_path, small_splits):
    for i in range(2):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "f.csv").write_text("".join(f"{(7 * k + i) % 50}\n" for k in range(50)))
    left, right = (P.file_numbered(spark.read.schema("v long").csv(str(tmp_path / f"{i}")), "at") for i in range(2))
    got = P.zip_rows(left, right, "at", "at")
    assert got.columns == ["v", "at", "v_right"]
    assert [tuple(r) for r in got.orderBy("at").collect()] == [(7 * k % 50, k, (7 * k + 1) % 50) for k in range(50)]
    with pytest.raises(ValueError, match="50 rows can't be zipped with 49"):
        P.zip_rows(left, right.where("at < 49"), "at", "at")


def test_suffixes_find_free_names(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k long, x long, x_right long")
    right = spark.createDataFrame([(1, 5, 6)], "k long, x long, y long")
    got = P.left_join(left, right, ["k"])
    assert got.columns == ["k", "x", "x_right", "x_right_right", "y"] and tuple(got.first()) == (1, 2, 3, 5, 6)
    assert P.left_join(left, right, ["k"], supplement=True).columns == ["k", "x", "x_right", "y"]
    assert tuple(P.left_join(left, right.where("k > 1"), ["k"]).first()) == (1, 2, 3, None, None)


def test_lossy_joins_fall_back_to_places(spark):
    left = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "t long, a long")
    same = spark.createDataFrame([(10, "x"), (20, "y"), (30, "z")], "t long, b string")
    got = P.joined_or_zipped(left, same, "t", ["t"], ["t"]).orderBy("t").collect()
    assert [(r["a"], r["b"], r["joined_by"]) for r in got] == [(1, "x", "key"), (2, "y", "key"), (3, "z", "key")]
    moved = same.withColumn("t", F.col("t") + 1)
    got = P.joined_or_zipped(left, moved, "t", ["t"], ["t"]).orderBy("t").collect()
    assert [(r["t"], r["t_right"], r["a"], r["b"], r["joined_by"]) for r in got] == [(10, 11, 1, "x", "position"), (20, 21, 2, "y", "position"), (30, 31, 3, "z", "position")]
    fewer = P.joined_or_zipped(left, same.where("t < 30"), "t", ["t"], ["t"])
    assert fewer.count() == 2 and fewer.first()["joined_by"] == "key"


def test_exact_values_are_the_first_of_their_time(spark):
    t = lambda m: datetime(2026, 1, 1, 0, m)
    left = spark.createDataFrame([(1, t(0)), (2, t(1)), (3, t(2)), (4, t(3)), (5, None)], "id long, ts timestamp")
    right = spark.createDataFrame([(t(0), 2.0, 5), (t(0), 1.0, 4), (t(1), float("nan"), 1), (t(1), 3.0, 2), (t(2), float("inf"), 1), (None, 9.0, 1)], "ts timestamp, v double, row long")
    got = P.exact_value(left, right, "ts", "v", ["row"], "value").orderBy("id").collect()
    assert [r["value"] for r in got] == [1.0, None, None, None, None] and got[0].asDict().keys() == {"id", "ts", "value"}


def test_dictionary_lookups(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r[0] for r in df.select(P.looked_up(F.col("k"), {"a": 1})).collect()] == [1, None, None]
    assert [r[0] for r in df.select(P.looked_up(F.col("k"), {})).collect()] == [None, None, None]
