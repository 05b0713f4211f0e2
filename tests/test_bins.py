"""Bins between given edges."""

import pytest
from pyspark.sql import functions as F
from quernel import queries
from quernel.functions import bins


@pytest.mark.parametrize(("lowest", "expected"), [(True, [None, 0, 0, 1, None, None]), (False, [None, None, 0, 1, None, None])])
def test_least_edge(spark, lowest, expected):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([-1.0, 0.0, 10.0, 50.0, 50.5, None])], "i int, x double")
    got = df.select("i", bins.right_closed(F.col("x"), F.array(*map(F.lit, (0.0, 10.0, 50.0))), include_lowest=lowest).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in got] == expected


def test_edge_bins_of_zero_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    values = [0.0, -0.0, -2.0, 0.01, 10.0, 50.0, 1000.0, 1000.5, float("nan"), None]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], "event_id long, value double").write.parquet(path)
    theirs = duckdb.connect().execute(queries.SQL["wn10_edge_bins"].replace("FROM events", f"FROM '{path}/*.parquet'")).fetchall()
    ours = [(r["event_id"], r["right_bin"], r["left_bin"]) for r in queries.QUERIES["wn10_edge_bins"](spark, str(tmp_path)).collect()]
    assert set(ours) == set(theirs) and len(ours) == len(theirs)
