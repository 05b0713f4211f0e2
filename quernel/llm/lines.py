"""Repeated lines: a sharded minimal perfect hash over line hashes, whose arrays of fingerprints, counts and first holders the documents' lines are looked up in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.batches import slices
from quernel.llm.scratch import materialize

#: Code points that a line's key needs to be looked for.
LEAST_LENGTH = 10
#: Lines of the corpus behind one shard of the hash, and so about the rows that one look-up task holds: some 70 MB.
SHARD_LINES = 1 << 20
#: Bits a key in each level of the hash; a level places about 61% of the keys that reach it.
BITS_PER_KEY = 2
LEVELS = 64
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- the hash -----------------------------------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys have the numbers 0 to n - 1, others any number or -1.

    Levels of bits: a key whose place in a level no other key shares has its bit set there, the rest go to the next level. A key's number is the number of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        """``sizes``: bits of each level, multiples of 64. ``bits``: all levels' 64-bit words in a row."""
        self.sizes, self.bits = sizes.astype(np.int64), bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-BITS_PER_KEY * len(left) // 64) * 64
            place = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[place]]
        if len(left):
            raise ValueError("keys repeat")
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def number(self, keys: np.ndarray) -> np.ndarray:
        out, open_, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            place = (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + first
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            under = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(under)
            open_, first = open_[~hit], first + size
        return out


# --- lines --------------------------------------------------------------------------------------------------------------------


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(given, id, row, text)``: the id as it is and as a number, null above all, and a hash that tells rows of one id apart; equal rows share it and have equal results."""
    rows = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("given", F.coalesce(F.col("given").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.lit(3), "text").alias("row"), "text")


def line_hashes(rows: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(id, row, line, h, fp)`` of each line whose key is long enough: its number in the text and 128 bits of hashes of its key."""
    each = rows.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).select("id", "row", "line", line_key(F.col("s")).alias("key"))
    return each.where(F.char_length("key") >= least_length).select("id", "row", "line", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(17), "key").alias("fp"))


INDEX = "shard int, n long, sizes binary, bits binary, fps binary, counts binary, holders binary"


def build_index(lines: DataFrame, shards: int, least_docs: int = 2) -> DataFrame:
    """One row a shard: the perfect hash of the line hashes that ``least_docs`` documents hold, and in its order three arrays, fingerprints, numbers of documents, and the least id that holds the line.

    Lines are counted a document first, so that documents of one id count once, then a line; both sums are pre-aggregated before their shuffle, so a line that all documents hold costs a row
    a task. Of keys that share all 64 bits of ``h`` only one has a number in a row; the others get a further row of their shard.
    """
    once = lines.groupBy("h", "fp", "id").agg(F.lit(1).alias("one"))
    keys = once.groupBy("h", "fp").agg(F.count("*").alias("docs"), F.min("id").alias("holder")).where(F.col("docs") >= least_docs)

    def pack(table: pa.Table) -> pa.Table:
        h, fp, docs, holder = (table.column(c).to_numpy() for c in ("h", "fp", "docs", "holder"))
        rows, shard = [], table.column("shard")[0].as_py()
        while len(h):  # a second round only for hashes that keys share
            first = np.unique(h, return_index=True)[1]
            keys = h[first].view(np.uint64)
            mph = PerfectHash.of(keys)
            order = first[np.argsort(mph.number(keys))]
            arrays = (mph.sizes, mph.bits, fp[order], docs[order], holder[order])
            rows.append({"shard": shard, "n": len(order)} | {k: a.tobytes() for k, a in zip(("sizes", "bits", "fps", "counts", "holders"), arrays, strict=True)})
            rest = np.setdiff1d(np.arange(len(h)), first)
            h, fp, docs, holder = h[rest], fp[rest], docs[rest], holder[rest]
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.Table.from_pylist(rows, schema=pa.schema(list(zip((c.split()[0] for c in INDEX.split(", ")), types, strict=True))))

    dealt = keys.select(shard_of(F.col("h"), shards).alias("shard"), "h", "fp", "docs", "holder")
    return dealt.groupBy("shard").applyInArrow(pack, INDEX)


def shard_of(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 7), F.lit(shards)).cast("int")


def repeated_lines(lines: DataFrame, index: DataFrame, shards: int, keep_first: bool = True) -> DataFrame:
    """``(id, row, line, docs)`` of the lines that the index holds, but those of the line's first holder if ``keep_first``; ``docs`` documents hold the line.

    Lines go to the shard of their hash, and are looked up in its arrays there. A shard with more lines than the mean (a line that many documents hold) is copied and its lines are
    dealt over the copies, so no task has more than about twice the mean.
    """
    shard = shard_of(F.col("h"), shards)
    sizes = lines.groupBy(shard.alias("shard")).count()
    mean = sizes.agg(F.avg("count").alias("mean"))
    copies = sizes.crossJoin(F.broadcast(mean)).select("shard", F.ceil(F.col("count") / F.col("mean")).cast("int").alias("copies"))  # one row; then a row a shard
    copies = materialize(copies, "line-shards")
    probes = lines.withColumn("shard", shard).join(F.broadcast(copies.where("copies > 1")), "shard", "left")  # hot shards, half of all at most, some bytes each
    probes = probes.select("shard", F.pmod(F.xxhash64("id", "row", "line"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"), "id", "row", "line", "h", "fp")
    arrays = index.join(copies, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).drop("copies")

    def look_up(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        h, fp, ids = probes.column("h").to_numpy().view(np.uint64), probes.column("fp").to_numpy(), probes.column("id").to_numpy()
        hit, docs = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        for r in arrays.to_pylist():
            sizes, bits, fps, counts, holders = (np.frombuffer(r[k], t) for k, t in (("sizes", np.int64), ("bits", np.uint64), ("fps", np.int64), ("counts", np.int64), ("holders", np.int64)))
            at = PerfectHash(sizes, bits).number(h)
            own = np.flatnonzero(at >= 0)
            own = own[fps[at[own]] == fp[own]]
            docs[own] = counts[at[own]]
            hit[own] = (holders[at[own]] != ids[own]) if keep_first else True
        return probes.select(["id", "row", "line"]).append_column("docs", pa.array(docs)).filter(pa.array(hit))

    met = probes.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy"))
    return met.applyInArrow(look_up, "id long, row long, line int, docs long")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_docs: int = 2) -> DataFrame:
    """``(<id_col>, n_lines, n_dropped, kept)`` of each row: its lines, those that go, and the text of the others, joined by line ends.

    Lines are what stands between line ends; a null or empty text is one empty line. A line whose key (ends stripped of ASCII white space, A-Z in lower case) has ``least_length`` code points and
    is held by ``least_docs`` documents goes, but for those of the least id that holds it, which all stay. Rows of one id are one document; a null id comes after all others, and all rows
    without an id are one document (a real id of 2^63 - 1 is taken for it). Repeated rows each give their row; an empty table gives no rows; other columns are ignored, whatever their names.
    Keys are told apart by 128 bits of hashes. Texts are shuffled once, to meet the numbers of the lines that go.
    """
    spark = docs.sparkSession
    lines = materialize(line_hashes(_rows(docs, id_col, text_col), least_length), "line-hashes")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // SHARD_LINES))
    index = materialize(build_index(lines, shards, least_docs), "line-index")
    gone = repeated_lines(lines, index, shards).groupBy("id", "row").agg(F.collect_set("line").alias("gone"))  # of one text at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_lines, n_dropped, kept = [], [], []
                for text, out in zip(part.column("text"), part.column("gone").to_pylist(), strict=True):
                    own = text.as_buffer().to_pybytes().split(b"\n")
                    dropped = set(out or ())
                    n_lines.append(len(own))
                    n_dropped.append(len(dropped))
                    kept.append(b"\n".join([s for i, s in enumerate(own) if i not in dropped]) if dropped else text.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([part.column("given"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["given", "n_lines", "n_dropped", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)
    met = rows.join(gone, ["id", "row"], "left").select("given", "text", "gone")
    return met.mapInArrow(cut, f"given {id_type}, n_lines long, n_dropped long, kept string").withColumnRenamed("given", id_col)


def op12_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
