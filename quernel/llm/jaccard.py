"""Similarity join on word shingles: MinHash values compared step by step with Bayesian pruning, exact check of the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.components import connected_components, forest
from quernel.llm.scratch import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: MinHash values of 16 bits; 32 bands of 4 find a pair of similarity 0.8 but for a chance of (1 - 0.8**4)**32 = 5e-8.
VALUES, BAND = 128, 4
#: Values compared in each step, and the posterior chance of reaching the similarity below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-9
#: Values that are compared within a bucket of a band, enough to tell pairs that can't reach the similarity.
HEAD = 64
#: Most classes, and bytes of their shingles, in a block: two blocks are compared in one task.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Classes of a bucket that are compared with all others first; pairs that share a neighbour among these are joined already.
LEADERS = 4
#: Groups up to this size are compared many at a time.
SMALL = 64
#: Most classes in a block of a band's bucket, of which only HEAD values are held.
BUCKET = 2048
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64 bits over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
MULTIPLIERS = (mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
OFFSETS = mix(np.arange(1001, VALUES + 1001, dtype=np.uint64)).astype(np.uint32)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in UTF-8 bytes ``data``, texts at ``bounds``; and the number of words before each bound.
    Words are runs of bytes other than ASCII white space and end with their text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    ink = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    begins = np.flatnonzero(ink & (first[:-1] | np.concatenate(([True], ~ink[:-1]))))
    ends = np.flatnonzero(ink & (first[1:] | np.concatenate((~ink[1:], [True])))) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[data] * powers(BASE, len(data)), dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[begins]) * powers(BASE_INVERSE, len(data))[begins] + (ends - begins).astype(np.uint64))
    return hashes, np.searchsorted(begins, bounds)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of five words in a row, for each text; a shorter text has one shingle of all its words, one
    without words has none."""
    for data, bounds in text_runs(texts):
        words, at = word_hashes(data, bounds)
        grams = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            grams += words[k : k + len(grams)] * CODES[k]
        grams = mix(grams)
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s >= SHINGLE:
                yield np.unique(grams[s : e - SHINGLE + 1])
            else:
                yield mix(np.array([(words[s:e] * CODES[16 : 16 + e - s]).sum(dtype=np.uint64)])) if e > s else np.zeros(0, np.uint64)


def text_runs(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of runs of whole texts, about ``most`` bytes each, with the bounds of the texts; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES numbers of 16 bits for each set that isn't empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    low = (np.concatenate(sets) >> np.uint64(7)).astype(np.uint32)
    out = np.empty((VALUES, len(sets)), np.uint16)
    for j in range(VALUES):
        out[j] = np.minimum.reduceat((low ^ OFFSETS[j]) * MULTIPLIERS[j], starts) >> np.uint32(8)
    return np.ascontiguousarray(out.T)


def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n values, pairs with fewer than m equal ones are dropped. With a uniform prior the similarity given m of n
    has a beta distribution, and it reaches s with the chance that n + 1 draws of chance s succeed m times at most."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return out


def likely(sigs_a: np.ndarray, sigs_b: np.ndarray, same: bool, steps: list[tuple[int, int]], known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs that no step drops (each once if both sides are the ``same``). Pairs whose rows have one ``known`` label from 0 on are left out."""
    n, m = steps[0]
    equal = np.zeros((len(sigs_a), len(sigs_b)), np.uint8)
    for v in range(n):
        equal += sigs_a[:, v, None] == sigs_b[None, :, v]
    keep = equal >= m
    if same:
        keep &= np.tri(len(sigs_a), k=-1, dtype=bool)
    if known is not None:
        keep &= (known[0][:, None] != known[1][None, :]) | (known[0] < 0)[:, None]
    a, b = np.nonzero(keep)
    so_far = equal[a, b].astype(np.int16)
    for (before, _), (n, m) in zip(steps, steps[1:], strict=False):
        if not len(a):
            break
        so_far += (sigs_a[a, before:n] == sigs_b[b, before:n]).sum(1, dtype=np.int16)
        keep = so_far >= m
        a, b, so_far = a[keep], b[keep], so_far[keep]
    return a, b


def linked(sigs_a: np.ndarray, sets_a: list, sigs_b: np.ndarray, sets_b: list, same: bool, steps: list[tuple[int, int]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs with a similarity of ``similarity`` or more (each once if both sides are the ``same``)."""
    a, b = likely(sigs_a, sigs_b, same, steps)
    if not len(a):
        return a, b
    common = shared(sets_a, sets_b, a, b)
    sizes_a, sizes_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    ok = common >= similarity * (sizes_a[a] + sizes_b[b] - common) - 1e-9
    return a[ok], b[ok]


def shared(sets_a: list, sets_b: list, a: np.ndarray, b: np.ndarray, width: int = 1 << 14) -> np.ndarray:
    """Exact number of common shingles of each pair: for few pairs by intersection, for many by products of 0/1 matrices."""
    if len(a) < 200:
        return np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    ra, ia = np.unique(a, return_inverse=True)
    rb, ib = np.unique(b, return_inverse=True)
    flat_a, flat_b = np.concatenate([sets_a[i] for i in ra]), np.concatenate([sets_b[j] for j in rb])
    row_a, row_b = np.repeat(np.arange(len(ra)), [len(sets_a[i]) for i in ra]), np.repeat(np.arange(len(rb)), [len(sets_b[j]) for j in rb])
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(ra), len(rb)), np.float32)
    for at in range(0, len(both), width):
        part = both[at : at + width]
        ma, mb = np.zeros((len(ra), len(part)), np.float32), np.zeros((len(rb), len(part)), np.float32)
        for m, flat, row in ((ma, flat_a, row_a), (mb, flat_b, row_b)):
            col = np.searchsorted(part, flat)
            hit = col < len(part)
            hit[hit] = part[col[hit]] == flat[hit]
            m[row[hit], col[hit]] = 1
        out += ma @ mb.T
    return out[ia, ib].astype(np.int64)


def node_hash(shingles: np.ndarray) -> np.ndarray:
    """A set of shingles as two numbers of 64 bits."""
    spread = mix(shingles[:, None] * CODES[40:42] + CODES[42:44]).sum(0, dtype=np.uint64)
    return (spread ^ (np.array([len(shingles)], np.uint64) * CODES[44:46])).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's set as a 64-bit hash, a second one to check it by, its size and MinHash values."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), ("values", pa.binary())])
    for b in batches:
        ids = b.column("doc_id")
        sets = list(shingle_sets(b.column("text")))
        nodes = np.array([node_hash(s) for s in sets], np.int64).reshape(-1, 2)
        values: list[bytes | None] = [None] * len(sets)
        full = [i for i, s in enumerate(sets) if len(s)]
        at = 0
        while at < len(full):
            to, size = at, 0
            while to < len(full) and (size < 1 << 18 or to == at):
                size += len(sets[full[to]])
                to += 1
            for i, v in zip(full[at:to], minhash([sets[i] for i in full[at:to]]), strict=True):
                values[i] = v.tobytes()
            at = to
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(nodes[:, 0]), pa.array(nodes[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array(values, pa.binary())], schema=schema)


def _classes(rows: DataFrame) -> DataFrame:
    usable = rows.where("n > 0 and doc_id is not null")
    return usable.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"), F.max("n").alias("n"), F.min("values").alias("values"), F.min("check").alias("lo"), F.max("check").alias("hi"))


def _likely_edges(similarity: float):
    """Compares the first HEAD values of the classes in each (band, i, j) of a sorted partition, step by step; emits edges of a forest that joins the
    pairs which can still reach the similarity, one a class at most, not the pairs."""
    steps = [s for s in least_matches(similarity) if s[0] <= HEAD]

    def pairs(sides: dict, same: bool) -> pa.RecordBatch | None:
        x = [(np.concatenate([r[0] for r in s]), np.concatenate([r[1] for r in s])) for s in ((sides[0], sides[0]) if same else (sides[0], sides[1])) if s]
        if len(x) < 2:
            return None
        (a_nodes, a_values), (b_nodes, b_values) = x
        nodes, values = (a_nodes, a_values) if same else (np.concatenate([a_nodes, b_nodes]), np.concatenate([a_values, b_values]))
        label, found, part = np.full(len(nodes), -1), [], 512
        for t in range(LEADERS if len(nodes) > 8 * LEADERS else 0):
            free = np.flatnonzero(label == -1)
            if not len(free):
                break
            near = likely(values[free[:1]], values, False, steps)[1]
            found.append((np.full(len(near), nodes[free[0]]), nodes[near]))
            label[near[label[near] == -1]] = t
        a_label, b_label = (label, label) if same else (label[: len(a_nodes)], label[len(a_nodes) :])
        for i in range(0, len(a_nodes), part):
            for j in range(0, i + 1 if same else len(b_nodes), part):
                mine, theirs = a_label[i : i + part], b_label[j : j + part]
                if mine[0] < 0 or (mine != mine[0]).any() or (theirs != mine[0]).any():
                    a, b = likely(a_values[i : i + part], b_values[j : j + part], same and i == j, steps, (mine, theirs))
                    found.append(forest(a_nodes[i + a], b_nodes[j + b]))
        if not found:
            return None
        u, v = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return pa.RecordBatch.from_pydict({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    def groups(band: np.ndarray, i: np.ndarray, j: np.ndarray, side: np.ndarray, node: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups. The pairs of small ones, which are most, are compared at once."""
        start = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        size = np.diff(np.r_[start, len(band)])
        small = (size <= SMALL) & (i[start] == j[start])
        rank = np.where(np.repeat(small, size), np.arange(len(band)) - np.repeat(start, size), 0)  # rows of the group before this one
        a = np.repeat(np.arange(len(band)), rank)
        b = np.arange(len(a)) - np.repeat(np.cumsum(rank) - rank, rank) + np.repeat(np.repeat(start, size), rank)
        before, so_far = 0, np.zeros(len(a), np.int16)
        for n, m in steps:
            so_far += (values[a, before:n] == values[b, before:n]).sum(1, dtype=np.int16)
            keep = so_far >= m
            a, b, so_far, before = a[keep], b[keep], so_far[keep], n
        u, v = forest(node[a], node[b])
        yield pa.RecordBatch.from_pydict({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})
        for lo, n in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
            mid = lo + int(np.searchsorted(side[lo : lo + n], 1))
            sides = {k: [(node[x:y], values[x:y])] if y > x else [] for k, x, y in ((0, lo, mid), (1, mid, lo + n))}
            if (out := pairs(sides, bool(i[lo] == j[lo]))) is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("head").to_pylist()), np.uint16).reshape(-1, HEAD)
            cols = (*(batch.column(c).to_numpy() for c in ("band", "i", "j", "side", "node")), values)
            if held is not None:
                cols = tuple(np.concatenate(c) for c in zip(held, cols, strict=True))
            at = len(cols[0]) - 1
            other = np.flatnonzero((cols[0] != cols[0][at]) | (cols[1] != cols[1][at]) | (cols[2] != cols[2][at]))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = tuple(c[cut:] for c in cols)
            if cut:
                yield from groups(*(c[:cut] for c in cols))
        if held is not None:
            yield from groups(*held)

    return run


def _by_blocks(rows: DataFrame, key: str, *carry: str) -> DataFrame:
    """Rows with ``blocks``, the number of blocks of their key, once for each pair of blocks (i, j) that theirs is in: ``side`` tells which it is."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", *carry)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes that take long to compare aren't put into few tasks
    return placed.repartition(tasks, key, "i", "j").sortWithinPartitions(key, "i", "j", "side", "node")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column replaced by its shingles as bytes; null if they aren't those of the node."""
    for b in batches:
        nodes, checks = b.column("node").to_pylist(), b.column("check").to_pylist()
        sets = pa.array([s.tobytes() if n in (h := node_hash(s).tolist()) and h[1] == c else None for s, n, c in zip(shingle_sets(b.column("text")), nodes, checks, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "family", "blocks", "n_docs", "values")), sets], names=["node", "family", "blocks", "n_docs", "values", "shingles"])


LINKS = "node long, n_docs long, n_classes long, other long"


def _compare(similarity: float):
    """Compares the blocks of each (family, i, j) in a sorted partition; emits for each node of a pair of blocks the numbers of documents and
    classes linked there and one edge towards its component."""
    steps = least_matches(similarity)
    schema = pa.schema([("node", pa.int64()), ("n_docs", pa.int64()), ("n_classes", pa.int64()), ("other", pa.int64())])

    def pairs(sides: dict, same: bool) -> pa.RecordBatch | None:
        if not sides[0] or not (same or sides[1]):
            return None
        x = [([r[0] for r in s], np.array([r[1] for r in s], np.int64), np.frombuffer(b"".join(r[2] for r in s), np.uint16).reshape(-1, VALUES), [np.frombuffer(r[3], np.uint64) for r in s]) for s in ((sides[0], sides[0]) if same else (sides[0], sides[1]))]
        nodes = np.array(x[0][0] if same else x[0][0] + x[1][0], np.int64)
        shift = 0 if same else len(x[0][0])
        docs, classes = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        parent = list(range(len(nodes)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        part = 512
        for i in range(0, len(x[0][0]), part):
            for j in range(0, (i + 1) if same else len(x[1][0]), part):
                a, b = linked(x[0][2][i : i + part], x[0][3][i : i + part], x[1][2][j : j + part], x[1][3][j : j + part], same and i == j, steps, similarity)
                if not len(a):
                    continue
                a, b = a + i, b + j
                np.add.at(docs, a, x[1][1][b])
                np.add.at(docs, b + shift, x[0][1][a])
                np.add.at(classes, a, 1)
                np.add.at(classes, b + shift, 1)
                for p, q in zip(*(x.tolist() for x in forest(a, b + shift)), strict=True):
                    p, q = root(p), root(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        roots = nodes[[root(k) for k in range(len(nodes))]]
        some = classes > 0
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(docs[some]), pa.array(classes[some]), pa.array(roots[some])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, {0: [], 1: []}
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("family", "i", "j", "side", "node", "n_docs", "values", "shingles")]
            for family, i, j, side, *row in zip(*cols, strict=True):
                if (family, i, j) != key:
                    if key and (out := pairs(sides, key[1] == key[2])) is not None:
                        yield out
                    key, sides = (family, i, j), {0: [], 1: []}
                if not sides[side] or sides[side][-1][0] != row[0]:  # a repeated row of the table
                    sides[side].append(row)
        if key and (out := pairs(sides, key[1] == key[2])) is not None:
            yield out

    return run


def similarity_join(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``(doc_id, class_id, n_links, n_linked_classes, component_id, kept)``.

    Documents with the same set of shingles form a class, named by its least id; links are pairs of classes whose sets have a Jaccard
    similarity of ``similarity`` or more. ``n_links`` counts the other documents linked with this one, its own class's included;
    ``component_id`` is the least id that links reach; ``kept`` marks that document. Rows that repeat an id and its text count as copies of which
    each is kept. Null and empty texts, and rows with a null id, link with nothing: their class is their own id. An empty table gives an empty result.

    1. Whole texts give MinHash values; equal sets (128 bits of hashes agree) are aggregated to classes before anything else, so copies cost one row.
    2. Classes that agree in a band of values meet in its bucket, where pairs are compared by 64 values, 16 at a time, and dropped once their posterior chance is below
       1e-9. What is left is one forest of edges a bucket; its components are families of likely pairs, which text that many documents share doesn't chain together.
    3. Families are split into blocks by number and bytes, and each pair of blocks is one group of a task: all MinHash values are compared in the same way
       and the rest is verified on the whole sets. Only sums and edges of a forest leave the task, not pairs.

    Buckets are split into blocks as well, so neither a frequent band nor a large family is one task.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(source.mapInArrow(_signatures, "doc_id long, node long, check long, n int, values binary"), "signatures")
    classes = materialize(_classes(rows), "classes")
    clash = classes.where("lo <> hi").select(F.col("node").alias("clash"))
    if not clash.isEmpty():  # sets of one hash that differ in the other, a few among billions: these take the other as their name
        rows = rows.join(clash, rows["node"] == F.col("clash"), "left").withColumn("node", F.when(F.col("clash").isNotNull(), F.col("check")).otherwise(F.col("node"))).drop("clash")
        rows = materialize(rows, "signatures")
        classes = materialize(_classes(rows), "classes")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)), lambda k: F.xxhash64(k, F.substring("values", k * (2 * BAND) + 1, F.lit(2 * BAND)))))
    bands = classes.select("node", band.alias("k", "band")).drop("k")
    buckets = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band", F.ceil(F.col("c") / BUCKET).cast("int").alias("blocks"))
    met = bands.join(buckets, "band").join(classes.select("node", F.substring("values", 1, 2 * HEAD).alias("head")), "node")
    edges = materialize(_by_blocks(met, "band", "head").mapInArrow(_likely_edges(similarity), "a long, b long"), "likely-edges")
    families = connected_components(edges).withColumnRenamed("component", "family")
    members = families.join(classes, "node")
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))
    members = materialize(members.join(sizes, "family").select("node", "hi", "class_id", "family", "blocks", "n_docs", "values"), "members")

    # the text of a class is that of a row with its id; another text under a repeated id is told by its hashes
    sets = members.withColumnRenamed("hi", "check").join(source, members["class_id"] == source["doc_id"]).select("node", "check", "family", "blocks", "n_docs", "values", "text")
    sets = sets.mapInArrow(_sets, "node long, family long, blocks int, n_docs long, values binary, shingles binary").where(F.col("shingles").isNotNull())
    grouped = _by_blocks(sets, "family", "n_docs", "values", "shingles")
    found = materialize(grouped.mapInArrow(_compare(similarity), LINKS), "links")
    counts = found.groupBy("node").agg(F.sum("n_docs").alias("linked_docs"), F.sum("n_classes").alias("linked_classes"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = parts.join(classes.select("node", "class_id"), "node")
    first = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    reached = parts.join(first, "component").select("node", "component_id")
    # written first, so that the join below has two plain sides and Spark can split a class of very many copies
    known = materialize(classes.select("node", "class_id", "n_docs").join(counts, "node", "left").join(reached, "node", "left"), "class-results")
    out = rows.join(known, (rows["node"] == known["node"]) & (rows["n"] > 0) & rows["doc_id"].isNotNull(), "left").drop(known["node"])
    own = F.coalesce("class_id", "doc_id")
    return out.select(
        F.col("doc_id").alias(id_col), own.alias("class_id"), F.coalesce(F.col("n_docs") - 1 + F.coalesce("linked_docs", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("linked_classes", F.lit(0)).cast("long").alias("n_linked_classes"), F.coalesce(F.col("component_id"), own).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce(F.col("component_id"), own), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``similarity_join`` keeps, with their columns: of each group that links join, the least id; of rows that repeat
    this id, one. Documents without words and rows with a null id all stay."""
    joined = similarity_join(docs, similarity, id_col, text_col)
    gone = materialize(joined.where("not kept").select(F.col(id_col).alias("__id")).distinct(), "near-copies")
    rest = docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
    twice = materialize(rest.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"), "repeated-ids")
    if twice.isEmpty():
        return rest
    again = rest.join(twice, rest[id_col] == twice["__id"], "left_semi")
    wordy = F.regexp_like(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    once, blank = again.where(wordy).dropDuplicates([id_col]), again.where(~wordy)
    return rest.join(twice, rest[id_col] == twice["__id"], "left_anti").unionByName(once).unionByName(blank)


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
