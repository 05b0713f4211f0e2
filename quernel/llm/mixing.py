"""Mixing sources to target weights by exact cuts in a random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.ordering import quoted, random_key, range_offsets, with_running_sum
from quernel.llm.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: weights in the order of the sources (code points, null last),
    repeated as needed, in one task, as sources are few beside documents; ``share`` of all sizes is dealt by weight, no target above ``max_epochs`` times its source, the
    excess dealt again. Sorted by cap over weight, the level is the largest of (what is left) / (weight left)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    out = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("all_sizes", F.sum("source_size").over(every)).withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    out = out.withColumn("level", F.max((F.lit(float(share)) * F.col("all_sizes") - F.col("cap_before")) / F.col("weight_left")).over(every))
    return out.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def plan_mix(keyed: DataFrame, weights: Sequence[int], share: float, max_epochs: int, whole_documents: bool) -> DataFrame:
    """``keyed`` (source, size, key, ties id and tie) with source_size, target and taken. See ``mix``."""
    offsets = range_offsets(keyed.select("source", "key", "size"), ["source"], "key", F.col("size"))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs).withColumnRenamed("source", "__s")
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    out = with_running_sum(keyed, offsets, ["source"], "key", ["id", "tie"], F.col("size"))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    if whole_documents:
        last = F.when(2 * (rest - F.col("before")) >= F.greatest(F.col("size"), F.lit(1)), F.col("size")).otherwise(0)
        copies = epochs + F.when(2 * (rest - F.col("before")) >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0)
    else:
        last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
        copies = epochs + F.when((rest > F.col("before")) & (F.col("size") > 0), 1).otherwise(0)
    return out.withColumn("taken", (epochs * F.col("size") + last).cast("bigint")).withColumn("copies", copies.cast("bigint")).drop("total", "before")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """How many words the mix takes from each document: ``(id, size, source_size, target, taken, copies)``.

    Documents of a source are put in the order of a hash of their id and text, so that rows of one id (or of none) spread; words are counted along this order and cut at
    the source's budget, the target to the nearest word. A budget above the source's size takes whole epochs first. The
    document at the cut gives only its words before the cut, so a source's taken words equal its rounded target.

    Null or empty texts have size 0 and give nothing; null sources form a source of their own; repeated ids count as
    separate documents; an empty table gives an empty result; all other columns are ignored.
    """
    keyed = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("tie"), random_key(seed, F.col(id_col), F.md5(F.coalesce(text_col, F.lit("")))).alias("key"),
    )
    out = plan_mix(materialize(keyed, "mix-keys"), weights, share, max_epochs, whole_documents=False)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once for every time that it is taken.

    Documents stay whole: the one at a source's cut is taken if half of its words or more lie before the cut.
    """
    packed = docs.select(
        F.struct(*quoted(docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), random_key(seed, F.col(id_col), F.md5(F.coalesce(text_col, F.lit("")))).alias("key"),
    )
    out = plan_mix(materialize(packed, "mix-rows"), weights, share, max_epochs, whole_documents=True)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs, seed=1).select("doc_id", "size", "source_size", "target", "taken")
