"""Resampling towards a target distribution: hashed word n-grams, bucket gains, and a Gumbel draw."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.batches import slices
from quernel.llm.scratch import materialize

BUCKETS, ORDER = 10_000, 3
#: Letters and digits of ASCII in lower case and all bytes of other characters stay, the rest parts words.
SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: States that the ring gives out at a time, so that a text's length doesn't show in a worker's memory.
EMITTED = 1 << 16


def feature_buckets(text: bytes, order: int = ORDER, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``order`` consecutive words joined by one space, some at a time: crc32 of their bytes modulo ``buckets``.

    The ring holds the running checksums of the runs from the last ``order`` starts; each word extends them by a space and itself, and opens its own.
    """
    out: list[int] = []
    ring: list[int] = []
    for word in text.translate(SEPARATED).split():
        piece = b" " + word
        ring = [crc32(word), *[crc32(piece, state) for state in ring[: order - 1]]]
        out += ring
        if len(out) >= EMITTED:
            yield np.array(out, np.uint32) % np.uint32(buckets)
            out = []
    if out:
        yield np.array(out, np.uint32) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts in each bucket that has any. A task gives one row a bucket, so little is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for some in feature_buckets(text.as_buffer().to_pybytes() if text.is_valid else b"", order, buckets):
                    total += np.bincount(some, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket: floor(1000 ln of its share of the target's features over its share of the documents' features), one feature added to each bucket."""
    spark = docs.sparkSession
    mine = materialize(bucket_counts(docs, text_col, order, buckets), "bucket-counts")
    theirs = materialize(bucket_counts(target, target_text_col, order, buckets), "target-counts")
    totals = mine.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(F.broadcast(theirs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t"))))  # one row each
    out = spark.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(mine.withColumnRenamed("n", "s")), "bucket", "left").join(F.broadcast(theirs.withColumnRenamed("n", "t")), "bucket", "left")  # a row a bucket
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return out.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: Sequence[int], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``(<id_col>, n_words, n_features, weight)`` of each row: the sum of the gains of its features. ``gains`` has one number a bucket, so it is small and goes along with the tasks."""
    table = np.asarray(gains, np.int64)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_features, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for i, text in enumerate(part.column("text")):
                    for some in feature_buckets(text.as_buffer().to_pybytes() if text.is_valid else b"", order, len(table)):
                        n_features[i] += len(some)
                        weight[i] += table[some].sum()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_features), pa.array(weight)], names=["id", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {id_type}, n_features long, weight long")
    # n words give n runs of one word, n - 1 of two, and so on; below ``order`` words the longer ones lack
    n = F.col("n_features")
    words = (n + order * (order - 1) // 2) / order
    for k in range(order):
        words = F.when(n == k * (k + 1) // 2, F.lit(k)).otherwise(words)
    return rows.select(F.col("id").alias(id_col), words.cast("long").alias("n_words"), "n_features", "weight")


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from a hash of seed and id; a null id is hashed as the word null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``place`` from 1 in the given order, in many tasks: rows are dealt out by ranges, ranges are counted, and windows run inside them."""
    ranges = materialize(scored.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "score-ranges")  # ranges are fixed by this write
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__inner", inner).join(F.broadcast(counts), "__range").withColumn("place", F.col("__before") + F.col("__inner")).drop("__range", "__before", "__inner")  # a row a partition


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(<id_col>, n_words, n_features, weight, score, rank)`` of every row: ``rank`` is the place, from 1, of the rows drawn towards the distribution of ``target``, null for the others.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn: those of highest score, weight plus a Gumbel value of the id, ties by smaller id (null ids first), then by
    fewer features. Null and empty texts have no words, no features and weight 0; repeated rows count each and are drawn each; an empty table gives no rows, an empty target one of equal shares;
    other columns are ignored, whatever their names. Texts are scanned twice, for the counts and for the weights; nothing of them is kept between.
    """
    gains = [r["gain"] for r in bucket_gains(docs, target, text_col, target_text_col, order, buckets).orderBy("bucket").collect()]  # one number a bucket
    weighed = weigh(docs, gains, id_col, text_col, order).withColumn("score", F.col("weight") + gumbel(seed, F.col(id_col)))
    weighed = materialize(weighed, "weights")
    long = F.col("n_words") >= least_words
    placed = ranked(weighed.where(long), [F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("n_features")])
    drawn = weighed.where(long).agg(F.floor(F.count("*") * percent / 100).cast("long").alias("__drawn"))
    out = placed.crossJoin(F.broadcast(drawn)).withColumn("rank", F.when(F.col("place") <= F.col("__drawn"), F.col("place")).cast("long")).drop("place", "__drawn")  # one row
    return out.unionByName(weighed.where(~long).withColumn("rank", F.lit(None).cast("long")))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
