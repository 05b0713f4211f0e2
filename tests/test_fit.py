"""Training tables of any size are dealt out to tasks of bounded size."""

from pyspark.sql import functions as F
from quernel.operators import ml


def test_training_rows_are_dealt_out(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 1).select("id", (F.col("id") % 10).cast("double").alias("f"), (F.col("id") % 10 >= 5).cast("double").alias("y"))
    assert ml._dealt(df, ["f", "y"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(ml, "FIT_ROWS", 300)
    dealt = ml._dealt(df, ["f", "y"])
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) <= 300 and dealt.columns == ["f", "y"]
    model = ml.fit_trees(df, ["f"], "y", rounds=2)
    assert ml.predict(model, df).agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0] < 0.5
