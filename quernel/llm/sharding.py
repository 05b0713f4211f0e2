"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.ordering import quoted, random_key, range_offsets, with_running_sum
from quernel.llm.scratch import materialize

ROUNDS = 6
#: Steps of cycle walking from 4096 rows on. Fewer than sqrt(n) numbers of the domain lie beyond n, so each step
#: fails with a chance under 1/64; a walk that 24 steps don't end stops the job instead of giving a wrong place.
WALK = 24


def _mix(seed: int, step: Column, half: Column) -> Column:
    """Round function: 48 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), step.cast("string"), half.cast("string"))), 1, 12), 16, 10).cast("bigint")


def permute(row: Column, n: Column, seed: int = 0) -> Column:
    """Place of global row number ``row`` in a pseudo-random permutation of 0 .. n-1.

    A Feistel network over the grid a x b with a = ceil(sqrt(n)) and b = ceil(n / a) permutes 0 .. a*b-1; numbers
    that land at n or beyond are permuted again until they land below n (cycle walking), which keeps it one to one.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("bigint")
    b = F.greatest(F.floor((n + a - 1) / a), F.lit(1)).cast("bigint")

    def network(x: Column) -> Column:
        start = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("bigint").alias("r"))
        done = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            start,
            lambda s, j: F.struct(s["r"].alias("l"), F.pmod(s["l"] + _mix(seed, j, s["r"]), F.when(j % 2 == 1, a).otherwise(b)).alias("r")),
        )
        return F.transform(F.array(done), lambda s: s["r"] * a + s["l"])[0]

    steps = F.when(n < 4096, F.greatest(a * b - n, F.lit(0)) + 1).otherwise(F.lit(WALK)).cast("int")
    place = F.aggregate(F.sequence(F.lit(1), steps), F.lit(-1).cast("bigint"), lambda at, i: F.when(i == 1, network(row)).when(at >= n, network(at)).otherwise(at))
    return F.transform(F.array(place), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("bigint")))[0]


def shard_places(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Shard and slot of every row: ``(id, size, text_crc32, <carry>, global_row, place, shard, slot)``.

    Rows are numbered in the order of a hash of their id and text (ties: checksum, size), the numbers are permuted, and place p goes to shard
    p mod n_shards, slot p div n_shards. Shards differ by one row at most and slots have no gaps; anyone who knows the
    seed, the row number and the number of rows can compute both, without the data.

    size is the UTF-8 length plus 16. Null text counts as empty; rows with a null or repeated id get places of their own;
    exact repeats may swap places. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"), *carry,
        (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        random_key(seed, F.col(id_col), F.md5(text)).alias("key"),
    )
    base = materialize(base, "shard-keys")
    one = F.lit(1).cast("bigint")
    numbered = with_running_sum(base, range_offsets(base, [], "key", one), [], "key", ["id", "text_crc32", "size"], one)
    placed = numbered.withColumn("place", permute(F.col("before"), F.col("total"), seed))
    return placed.select(
        F.col("id").alias(id_col), *carry, "size", "text_crc32", F.col("before").alias("global_row"), "place",
        (F.col("place") % n_shards).cast("int").alias("shard"), F.floor(F.col("place") / n_shards).cast("bigint").alias("slot"),
    )


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``. Columns of ``docs`` with these names are replaced.

    The rows are numbered as they are, so that no join on the id is needed and repeated ids keep their own rows.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = docs.select(F.struct(*quoted(kept)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = materialize(packed.select("row", "id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), random_key(seed, F.col("id"), F.md5(F.coalesce("text", F.lit("")))).alias("key")), "shard-rows")
    one = F.lit(1).cast("bigint")
    offsets = range_offsets(key.select("key"), [], "key", one)
    placed = with_running_sum(key, offsets, [], "key", ["id", "crc"], one).withColumn("place", permute(F.col("before"), F.col("total"), seed))
    return placed.select("row.*", (F.col("place") % n_shards).cast("int").alias("shard"), F.floor(F.col("place") / n_shards).cast("bigint").alias("slot"))


def op7_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_places(docs, 40, seed=7)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
