"""Periodic runs of words: a harmonic grid of places, longest common extensions by binary search over prefix hashes, exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.batches import slices, utf8

#: A run has this many words at least, and this many times its period.
LEAST_LENGTH, LEAST_TIMES = 6, 4
#: (period, grid place) pairs that are worked on at once; a longer text takes several rounds over ranges of periods.
PAIRS = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class PrefixHashes:
    """Polynomial hashes of every stretch of words modulo 2^64, from prefix sums."""

    def __init__(self, codes: np.ndarray, base: int) -> None:
        powers = np.full(len(codes) + 1, base, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * self.powers[:-1])))

    def same(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from ``at`` are hashed like those ``period`` words on."""
        left = (self.sums[at + length] - self.sums[at]) * self.powers[period]
        return left == self.sums[at + period + length] - self.sums[at + period]

    def extend(self, at: np.ndarray, period: np.ndarray, ahead: bool) -> np.ndarray:
        """Of all pairs at once: how many words from ``at`` ahead (or before ``at`` backwards) equal those ``period`` words on."""
        low = np.zeros(len(at), np.int64)
        high = len(self.sums) - 1 - period - at if ahead else at.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            start = at[open_] if ahead else at[open_] - middle
            hit = self.same(start, period[open_], middle)
            low[open_] = np.where(hit, middle, low[open_])
            high[open_] = np.where(hit, high[open_], middle - 1)
        return low


def _grid(n: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(place, period)`` of the harmonic grid, some periods at a time: the places 0, step, 2 step, ... of each period, step being ``times`` - 1 periods. The words of a run that
    equal those a period on stand in a row of ``step`` words at least, so one of them is a place of the grid."""
    periods = np.arange(1, n // times + 1, dtype=np.int64)
    counts = (n - 1 - periods) // ((times - 1) * periods) + 1
    ends = np.cumsum(counts)
    first = 0
    while first < len(periods):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        some = counts[first:last]
        period = np.repeat(periods[first:last], some)
        nth = np.arange(len(period), dtype=np.int64) - np.repeat(np.cumsum(some) - some, some)
        yield nth * period * (times - 1), period
        first = last


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a stretch, with its smallest period. A stretch of four periods of q that has a smaller period has one that divides q, and then the same ends, so
    this leaves each run once, under its smallest period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _is_run(codes: np.ndarray, start: int, end: int, period: int) -> bool:
    inside = np.array_equal(codes[start : end - period], codes[start + period : end])
    return inside and (start == 0 or codes[start - 1] != codes[start - 1 + period]) and (end == len(codes) or codes[end] != codes[end - period])


def runs(codes: np.ndarray, least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of every run of the coded words, by start, then period. ``times`` is 3 or more.

    Pairs of the grid whose two words differ are left at once; of the others all extensions are found together. The words of each run found are then compared, and its ends: hashes can only
    make a run too long, which this shows, and then another base is taken.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods can miss the grid")
    n = len(codes)
    for base in BASES:
        hashes = None
        found = tuple(np.zeros(0, np.int64) for _ in range(3))
        for at, period in _grid(n, times):
            hit = codes[at] == codes[at + period]
            at, period = at[hit], period[hit]
            if not len(at):
                continue
            hashes = hashes or PrefixHashes(codes, base)
            start = at - hashes.extend(at, period, ahead=False)
            end = at + hashes.extend(at, period, ahead=True) + period
            long = end - start >= np.maximum(least, times * period)
            found = _distinct(*(np.concatenate((old, new[long])) for old, new in zip(found, (start, end, period), strict=True)))
        if all(_is_run(codes, *r) for r in zip(*(x.tolist() for x in found), strict=True)):
            order = np.lexsort((found[2], found[0]))
            return tuple(x[order] for x in found)
    raise RuntimeError("no base tells the words apart")


def _coded(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """``(<id_col>, n_words, runs, collapsed)`` of each row: its periodic runs, an array of (start, length, period) by start, then period, and its words with every run cut to its first period, joined
    by one space.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of ``least`` words and ``times`` of its smallest period at least that no neighbouring word continues. A
    word goes if any run holds it after its first period. Every text is worked on as a whole, in its own task: 8 bytes a word for each of some ten arrays, besides PAIRS pairs at a time. Null and
    empty texts, or texts of white space, have no words and no runs, and an empty ``collapsed``; repeated rows and null ids each give their row; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, sizes, kept, flat = [], [0], [], ([], [], [])
                for text in utf8(part.column("text")):
                    words = text.split()
                    start, end, period = runs(_coded(words), least, times)
                    if len(start):
                        edges = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edges, start + period, 1)
                        np.add.at(edges, end, -1)
                        gone = np.cumsum(edges[:-1]) > 0
                        kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
                    else:
                        kept.append(b" ".join(words))
                    n_words.append(len(words))
                    sizes.append(len(start))
                    for column, values in zip(flat, (start, end - start, period), strict=True):
                        column.append(values)
                columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in flat]
                found = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), found, pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(work, f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def planted(text: Column, doc_id: Column) -> Column:
    """The text with a periodic tail, for one id in ten by its hash, as the query's contract states it; other texts as they are, and those of null ids."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # an array of one element binds the words to a variable, so that they are split once
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def op11_periods(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    # quotients of two numbers below 2^26 that differ do so as doubles too
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("times"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
