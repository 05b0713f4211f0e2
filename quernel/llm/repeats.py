"""Removal of repeated byte strings: shard Burrows-Wheeler transforms merged by interleave refinement.

Every window of ``LENGTH`` bytes has an anchor, its gram with the least hash, so equal windows have equal anchors at the same place. Texts
are cut into runs of windows with a common anchor. Runs that are equal as a whole are told by their hash. Where runs of one anchor differ,
their bytes meet in one task, and the merged transform of these short strings finds which of their windows are repeated. Anchors with too many differing
bytes for one task are cut into their windows, which meet by their own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.jaccard import BASE, BASE_INVERSE, CODES, mix, powers, text_runs
from quernel.llm.scratch import materialize

LENGTH, GRAM = 100, 24
#: Bits of a place in a piece of text; longer texts are worked on in pieces, whose windows overlap.
PLACE = np.uint64((1 << 24) - 1)
PIECE = 1 << 22
#: Bytes of strings that one merge takes, whole anchors at least, and its shards.
BATCH, SHARDS = 1 << 16, 8
#: Bytes of differing runs beyond which an anchor is hot: its windows are dealt out one by one, so that no merge holds more than this and a batch.
HOT = 1 << 18
#: Hot anchors that are broadcast, 8 bytes each; more of them are joined by a shuffle.
MOST_HOT = 1_000_000


def runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in the texts at ``bounds``: anchor's hash, the run's hash, number of the text, place of the anchor in the text, windows'
    starts before the anchor (``left``), number of windows."""
    n = len(data)
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < length:
        return empty
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[data] * powers(BASE, n), dtype=np.uint64)))
    back = powers(BASE_INVERSE, n)
    grams = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    width = length - gram + 1
    keys = np.full(-(-len(grams) // width) * width, ~np.uint64(0))
    keys[: len(grams)] = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    table = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    anchor = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[:count] == text[length - 1 :]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    if not len(lo):
        return empty
    at = anchor[lo]
    whole = mix((sums[hi + length] - sums[lo]) * back[lo] + (at - lo).astype(np.uint64) * CODES[50] + (hi - lo).astype(np.uint64) * CODES[51])
    return grams[at], whole, text[lo], at - bounds[text[lo]], at - lo, hi - lo + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each batch. Of equal runs in one batch, the first stands for all; the others are repeated for certain, which a negative
    shape says, so that a very frequent run doesn't meet in one task."""
    for b in batches:
        ids, versions = (b.column(c).to_numpy() for c in ("doc_id", "version"))
        row, found = 0, []
        for data, bounds in text_runs(b.column("text")):
            for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                part = data[at : at + PIECE + LENGTH - 1]
                anchors, whole, text, place, left, n = runs(part, np.clip(bounds - at, 0, len(part)))
                place += np.maximum(at - bounds[text], 0)  # of the part of a text that earlier pieces held
                found.append((anchors.view(np.int64), whole.view(np.int64), ids[row + text], versions[row + text], place, left * 256 + n))
            row += len(bounds) - 1
        if not found:
            continue
        yield _stand_in(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _stand_in(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, version: np.ndarray, place: np.ndarray, shape: np.ndarray) -> pa.RecordBatch:
    by = np.lexsort((place, version, doc, whole, anchor))
    a, w, d, v, p = anchor[by], whole[by], doc[by], version[by], place[by]
    first = np.ones(len(by), bool)
    first[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    certain = ~first & ((d != d[lead]) | (v != v[lead]) | (p != p[lead]))  # a row of the table that is repeated is at the same place
    return pa.RecordBatch.from_pydict({"anchor": pa.array(a), "whole": pa.array(w), "doc_id": pa.array(d, pa.int64()), "version": pa.array(v, pa.int64()), "place": pa.array(p), "shape": pa.array(np.where(certain, -shape[by], shape[by]), pa.int32())})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the strings as a run of its own, its place its start; of equal windows in one batch, the first stands for all as in ``_runs``."""
    for b in batches:
        strings = b.column("bytes").to_pylist()
        if not strings:
            continue
        sizes = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8)
        n = len(data)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[data] * powers(BASE, n), dtype=np.uint64)))
        count = sizes - LENGTH + 1
        string = np.repeat(np.arange(len(strings)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = (np.cumsum(sizes) - sizes)[string] + at
        whole = mix((sums[first + LENGTH] - sums[first]) * powers(BASE_INVERSE, n)[first]).view(np.int64)
        anchor, doc, version, start = (b.column(c).to_numpy() for c in ("anchor", "doc_id", "version", "start"))
        yield _stand_in(anchor[string], whole, doc[string], version[string], start[string] + at, np.ones(len(string), np.int32))


RUNS = "anchor long, whole long, doc_id long, version long, place long, shape int"
FOUND = "anchor long, doc_id long, version long, place long, shape int, repeated boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a partition sorted by anchor, run and place: later equal runs are ``repeated``; the first of each run goes on if its
    anchor has other runs too. From batch to batch, only the latest first row is carried, and whether it has gone on already."""
    carried, gone = None, False
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("anchor", "whole", "doc_id", "version", "place", "shape")], 1)
        certain = cols[cols[:, 5] < 0]
        certain[:, 5] *= -1
        cols = cols[cols[:, 5] > 0]
        if carried is not None:
            cols = np.concatenate([carried, cols])
        if not len(cols):
            yield _found(certain, cols[:0])
            continue
        same_anchor = cols[1:, 0] == cols[:-1, 0]
        first = np.r_[True, ~same_anchor | (cols[1:, 1] != cols[:-1, 1])]
        lead = cols[np.maximum.accumulate(np.where(first, np.arange(len(cols)), 0))]
        again = ~first & (cols[:, 2:5] != lead[:, 2:5]).any(1)  # a row of the table that is repeated is at the same place
        repeated, firsts = cols[again], cols[first]
        same = firsts[1:, 0] == firsts[:-1, 0]
        on = np.r_[False, same] | np.r_[same, False]
        emit = on.copy()
        emit[0] &= not gone
        gone = bool(on[-1]) or (gone and len(firsts) == 1)
        carried = firsts[-1:]
        yield _found(np.concatenate([certain, repeated]), firsts[emit])


def _found(repeated: np.ndarray, on: np.ndarray) -> pa.RecordBatch:
    rows = np.concatenate([repeated, on])
    names = ("anchor", "doc_id", "version", "place", "shape", "repeated")
    return pa.RecordBatch.from_arrays([*(pa.array(rows[:, c]) for c in (0, 2, 3, 4)), pa.array(rows[:, 5], pa.int32()), pa.array(np.arange(len(rows)) < len(repeated))], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked runs of each text, in batches of about 8 MB."""
    names, types = ("anchor", "doc_id", "version", "start", "bytes"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    out: list[list] = [[] for _ in names]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    for b in batches:
        for doc, version, text, asked in zip(b.column("doc_id").to_pylist(), b.column("version").to_pylist(), b.column("text"), b.column("asked"), strict=True):
            data = text.as_buffer().to_pybytes()
            for anchor, place, shape in zip(*(x.to_pylist() for x in asked.values.flatten()), strict=True):
                start = place - shape // 256
                for c, v in zip(out, (anchor, doc, version, start, data[start : start + shape % 256 - 1 + LENGTH]), strict=True):
                    c.append(v)
            if len(out[0]) > 50_000:
                yield batch()
                out = [[] for _ in names]
    yield batch()


def symbols(flat: np.ndarray, at: np.ndarray, length: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rotation of the cyclic strings: the number, in sorted order, of the ``step`` bytes before it, and the rotation that begins with them."""
    back = at - step
    while (low := back < 0).any():
        back[low] += length[low]
    code = np.zeros(len(flat), np.uint64)
    for k in range(step):
        place = back + k
        place = np.where(place >= length, place % length, place)
        code = (code << np.uint64(8)) | flat[first + place]
    _, number = np.unique(code, return_inverse=True)
    small = number.astype(np.uint16) if number.max(initial=0) < 1 << 16 else number.astype(np.int32)
    return small, first + back


def refine(order: np.ndarray, block: np.ndarray, bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step: rows in merged order with their blocks of common prefixes and their symbols before them; gives the stable order by symbol, and the
    blocks after the symbol is put before each prefix."""
    by = np.argsort(bwt, kind="stable")
    s, b = bwt[by], block[by]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (b[1:] != b[:-1]))) if len(s) else np.zeros(0, bool)
    return order[by], np.cumsum(new) - 1


def merge(strings: list[bytes], shards: int = SHARDS, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each rotation's first ``length`` bytes in the merged transform of all strings: ``(block, string, place)``.

    Each shard's transform is the bytes before its rotations in sorted order. The merge holds only which shard each row comes from: rows of a shard keep their
    order, so the next symbol of a shard belongs to its next row. Every step sorts the interleave stably by these symbols (eight bytes at a time, four in
    the first step), after which rows are in order by that many bytes more; rows with equal prefixes form blocks, whose ends
    show common prefixes shorter than the depth. At depth ``length`` the blocks are the repeated intervals.
    """
    sizes = np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64)
    string = np.repeat(np.arange(len(strings)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(flat)) - first
    size = np.repeat(sizes, sizes)
    head = length % 8
    steps = [*([head] if head else []), *[8] * (length // 8)]
    kinds = {k: symbols(flat, at.copy(), size, first, k) for k in set(steps)}
    shard = (string % shards).astype(np.uint16)
    # transforms of the shards: the same refinement inside each shard, from the order of the text
    members = [np.flatnonzero(shard == s) for s in range(shards)]
    sorted_rows = []
    for rows in members:
        for k in steps:
            # a stable order of all rows by the symbols at the rotations one step ahead gives the next depth
            number, before = kinds[k]
            by = np.argsort(number[rows], kind="stable")
            rows = before[rows[by]]
        sorted_rows.append(rows)
    rows = np.concatenate(sorted_rows)  # shard after shard, each in its own sorted order
    bwt = {k: kinds[k][0][rows] for k in kinds}
    source = np.repeat(np.arange(shards, dtype=np.uint16), [len(m) for m in members])
    interleave, block = source.copy(), np.zeros(len(rows), np.int64)
    for k in steps:
        taken = np.argsort(interleave, kind="stable")
        merged = np.empty_like(bwt[k])
        merged[taken] = bwt[k]
        interleave, block = refine(interleave, block, merged)
    out = np.empty(len(rows), np.int64)
    out[rows] = block[np.argsort(interleave, kind="stable")]
    return out, string, at


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole anchors, about BATCH bytes at a time, in a partition sorted by anchor: windows that also start earlier, as covered bytes."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "version", "start", "end")])

    def covered(held: list[tuple]) -> pa.RecordBatch:
        block, string, at = merge([h[4] for h in held])
        docs, versions, starts = (np.array([h[c] for h in held], np.int64) for c in (1, 2, 3))
        window = at <= np.array([len(h[4]) for h in held])[string] - LENGTH
        block, string, at = block[window], string[window], at[window]
        doc, version, start = docs[string], versions[string], starts[string] + at
        by = np.lexsort((start, version, doc, block))
        b, d, v, s = block[by], doc[by], version[by], start[by]
        again = np.zeros(len(b), bool)
        same = b[1:] == b[:-1]
        # not the first of its block, nor at the same place as the first (a text whose row is repeated)
        lead = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(b)), 0))[1:]
        again[1:] = same & ((d[1:] != d[lead]) | (v[1:] != v[lead]) | (s[1:] != s[lead]))
        d, v, s = d[again], v[again], s[again]
        by = np.lexsort((s, v, d))
        d, v, s = d[by], v[by], s[by]
        if not len(d):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in schema.types], schema=schema)
        lo = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (s[1:] > s[:-1] + 1)])
        hi = np.r_[lo[1:] - 1, len(d) - 1]
        return pa.RecordBatch.from_arrays([pa.array(d[lo]), pa.array(v[lo]), pa.array(s[lo]), pa.array(s[hi] + LENGTH)], schema=schema)

    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "version", "start", "bytes")), strict=True):
            if size >= BATCH and row[0] != held[-1][0]:
                yield covered(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield covered(held)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's removed runs and what remains."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("covered").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            for c, v in zip(out, (doc, len(data), sum(e - s for s, e in merged), len(merged), kept.hexdigest(), [{"start": s, "end": e} for s, e in merged]), strict=True):
                out[c].append(v)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (*[pa.int64()] * 4, pa.string(), span), strict=True)], names=list(out))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` of every row: maximal runs of bytes, as half-open ``spans`` of the UTF-8 text, that lie in some
    string of LENGTH bytes which also starts earlier, in a smaller id or earlier in the same text. Texts are judged as they were given.

    Null text counts as empty. Rows with a null id are returned whole and are nobody's earlier text. Rows that repeat an id and its text don't count as
    earlier for each other; of rows that repeat an id with other texts, the one whose text has the smaller hash comes first. An empty
    table gives an empty result.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    twice = given.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id")
    twice = materialize(twice.withColumn("again", F.lit(True)), "ids-of-several-texts")
    # where no id has several texts, which is the rule, the number of the version costs nothing
    source = given.withColumn("version", F.lit(0).cast("long")) if twice.isEmpty() else given.join(twice, "doc_id", "left").select("doc_id", "text", F.when(F.col("again"), digest).otherwise(0).alias("version"))
    text = ["doc_id", "version"]
    order = ["anchor", "whole", *text, "place"]
    usable = source.where("doc_id is not null and octet_length(text) >= 100").select(*text, "text")
    rows = usable.mapInArrow(_runs, RUNS)
    sorted_rows = rows.repartition(F.when(F.col("shape") < 0, F.xxhash64("doc_id", "place")).otherwise(F.col("anchor"))).sortWithinPartitions(*order)
    found = materialize(sorted_rows.mapInArrow(_meet, FOUND), "runs")
    asked = found.where("not repeated").groupBy(*text).agg(F.collect_list(F.struct("anchor", "place", "shape")).alias("asked"))
    strings = usable.join(asked, text).mapInArrow(_cut, "anchor long, doc_id long, version long, start long, bytes binary")
    n = F.col("shape") % 256
    hot = materialize(found.where("not repeated").groupBy("anchor").agg(F.sum(n - 1 + LENGTH).alias("size")).where(F.col("size") > HOT).select("anchor"), "hot-anchors")
    few = F.broadcast(hot) if hot.count() < MOST_HOT else hot  # at most one for each HOT bytes of differing runs
    cut = ["anchor", *text, "start", "bytes"]
    windows = strings.join(few, "anchor", "left_semi").select(*cut).mapInArrow(_windows, RUNS)
    dealt = windows.repartition(F.when(F.col("shape") < 0, F.xxhash64("doc_id", "place")).otherwise(F.xxhash64("anchor", "whole"))).sortWithinPartitions(*order)
    parts = dealt.mapInArrow(_meet, FOUND).where("repeated").select(*text, F.col("place").alias("start"), (F.col("place") + LENGTH).alias("end"))
    merged = strings.join(few, "anchor", "left_anti").select(*cut).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merged, "doc_id long, version long, start long, end long")
    left = F.floor(F.col("shape") / 256)
    whole = found.where("repeated").select(*text, (F.col("place") - left).alias("start"), (F.col("place") - left + n - 1 + LENGTH).alias("end"))
    covered = whole.unionByName(merged).unionByName(parts).groupBy(*text).agg(F.collect_list(F.struct("start", "end")).alias("covered"))
    out = source.join(covered, text, "left").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
    return out.withColumnRenamed("doc_id", id_col)


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
