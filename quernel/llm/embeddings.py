"""Near duplicates among embeddings by an inverted multi-index: product cells of two codebooks, nearest cells first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.components import connected_components, forest
from quernel.llm.scratch import materialize

SIMILARITY = 0.95
#: Vectors that the codebooks are fitted on, the first in the order of a hash of their ids; all vectors are indexed.
SAMPLE = 20_000
#: Cells hold about so many vectors on average, within these numbers of codewords for each half.
CELL, FEWEST, MOST_WORDS = 64, 4, 4096
#: Share of the neighbours at the very similarity that the cells visited from one side must hold, for a random direction of the
#: difference, and of the sampled links whatever their direction; nearer ones are missed less, and a pair can be found from both sides.
RECALL = 0.9999
#: Vectors of the sample whose links within it show how far to walk.
PROBES = 1000
#: Vectors of a cell that one task compares with the probes at a time; a larger cell is split, its probes repeated.
BLOCK = 2048


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of half vectors, started from rows spread over the sample; empty words take the farthest rows."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = distances(x, words)
        near = d.argmin(1)
        far = iter(np.argsort(-d[np.arange(len(x)), near]))
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        for j in range(k):
            words[j] = sums[j] / n[j] if n[j] else x[next(far)]
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


def offsets(x: np.ndarray, words: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's word, and how far it lies on the near side of the plane between its word and every other word: a lower bound on
    its distance to any row of that word."""
    d = distances(x, words)
    near = d.argmin(1)
    gap = np.maximum(between[near], 1e-12)
    h = np.maximum(d - d[np.arange(len(x)), near][:, None], 0) / (2 * gap)
    h[np.arange(len(x)), near] = 0
    return near, h


def multi_sequence(h1: np.ndarray, h2: np.ndarray, most: float) -> np.ndarray:
    """Cells (i, j) as i * len(h2) + j in the order of h1[i]**2 + h2[j]**2, as far as ``most``. Both lists are sorted and walked together:
    row i of the sorted grid goes on while its next cell is near enough, so only visited cells and one more a row are looked at."""
    a, b = np.argsort(h1, kind="stable"), np.argsort(h2, kind="stable")
    s1, s2 = h1[a] ** 2, h2[b] ** 2
    rows = int(np.searchsorted(s1, most, side="right"))
    ends = np.searchsorted(s2, most - s1[:rows], side="right")
    i = np.repeat(np.arange(rows), ends)
    j = np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
    order = np.argsort(s1[i] + s2[j], kind="stable")
    return (a[i] * len(h2) + b[j])[order]


def reach(half: int, similarity: float, recall: float) -> float:
    """Squared bound to walk to. Two unit vectors at the similarity differ by r = sqrt(2 - 2 * similarity); for a random direction of the
    difference, its part across one plane in each half is about r / sqrt(2 * half) times a normal number, and the sum of two squares of
    these exceeds -2 * ln(1 - recall) times the variance with chance 1 - recall."""
    return float(-2 * np.log(1 - recall) * (2 - 2 * similarity) / (2 * half))


def reach_of_links(unit: np.ndarray, books: list[np.ndarray], between: list[np.ndarray], similarity: float, recall: float, probes: int = PROBES) -> float:
    """Squared bound that holds ``recall`` of the links of the first rows: in a group along few axes, codewords split the group along these, and
    differences cross the planes between them more often than random ones."""
    half, crossed = books[0].shape[1], [np.zeros(0)]
    home = [distances(u, w).argmin(1) for u, w in zip((unit[:, :half], unit[:, half:]), books, strict=True)]
    for at in range(0, min(probes, len(unit)), 250):
        some = unit[at : min(at + 250, probes)]
        i, j = np.nonzero(some @ unit.T >= similarity)
        h = [offsets(u, w, g)[1] for u, w, g in zip((some[:, :half], some[:, half:]), books, between, strict=True)]
        crossed.append(h[0][i, home[0][j]] ** 2 + h[1][i, home[1][j]] ** 2)
        crossed[-1] = crossed[-1][at + i != j]
    links = np.concatenate(crossed)
    return float(np.quantile(links, recall, method="higher")) if len(links) else 0.0


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that neither huge nor tiny ones leave the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def crossing(unit: np.ndarray, homes: np.ndarray, other: tuple[int, int], books: list[np.ndarray], between: list[np.ndarray], k: int) -> np.ndarray:
    """The squared bound of each row's distance to one cell, from the row's home cell. Plain sums row by row, so the same row gives the same bits in
    whatever company it is computed; products of matrices don't."""
    half, total = books[0].shape[1], np.zeros(len(unit))
    for part, book, gap, own, to in zip((unit[:, :half], unit[:, half:]), books, between, (homes // k, homes % k), other, strict=True):
        w, v = book[own], book[to]
        apart = ((v * v).sum() - (w * w).sum(1)) - 2 * (part * (v - w)).sum(1)
        total += (np.maximum(apart, 0) / (2 * np.maximum(gap[own, to], 1e-12))) ** 2
    return total


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector isn't null, has no null, NaN or infinite component and isn't zero."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda v: v != 0))


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Links are pairs whose cosine in doubles is ``similarity`` or more; ``n_links`` counts the other rows linked, ``component_id`` is the least id that links
    reach. Equal vectors are aggregated first and linked with each other. Each distinct vector is stored in its cell of the grid of two
    codebooks and looks for others in the nearest cells, walked until ``recall`` of its neighbours should have been met; a pair counts
    whichever side finds it. Vectors of one component have one codebook. Vectors of different lengths have no cosine: each length is a search of its own, the most
    frequent first, so a table should hold few lengths. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id link with nothing. Rows that repeat an id link with each other and are each kept. An empty table gives an empty result.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # floats are stored and dealt as such, half the bytes
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("x"))
    good = usable(rows.where("id is not null"), "x")
    lengths = [r["n"] for r in good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").collect()]
    blank = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return blank
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    coded = rows.withColumn("ok", F.when(F.col("id").isNotNull() & (F.size("x") > 0), fine).otherwise(False))
    coded = coded.withColumn("node", F.when(F.coalesce("ok", F.lit(False)), F.xxhash64("x", F.lit(2))))
    known = None
    for dim in lengths:
        found = _search(coded.where(F.col("node").isNotNull() & (F.size("x") == dim)), dim, kind, similarity, recall, sample)
        known = found if known is None else known.unionByName(found)
    out = coded.select("id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "first_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("n") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _search(coded: DataFrame, dim: int, kind: str, similarity: float, recall: float, sample: int) -> DataFrame:
    """``(node, first_id, n, linked, component_id)`` of each distinct vector: ``coded`` has id, node and vectors x of ``dim`` usable numbers. See ``near_duplicates``."""
    distinct = materialize(coded.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.min("x").alias("x")), "vectors")
    n = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("node", F.lit(5)), "node").select("x").limit(sample).collect()
    fit = units(np.array([r["x"] for r in chosen]))
    half = max(1, dim // 2)
    k = int(min(max(FEWEST, round((n / CELL) ** 0.5)), MOST_WORDS, max(1, len(fit) // 4)))
    books = [codebook(fit[:, :half], k), codebook(fit[:, half:], k)]
    between = [np.sqrt(distances(b, b)) for b in books]
    bound = min(max(reach(half, similarity, recall), reach_of_links(fit, books, between, similarity, recall)), 2 - 2 * similarity)  # the last one can't miss

    def vectors_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim).astype(np.float64)

    def placed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its home cell."""
        for b in batches:
            unit = units(vectors_of(b))
            near = [distances(u, w).argmin(1) for u, w in zip((unit[:, :half], unit[:, half:]), books, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near[0] * k + near[1], pa.int64())], names=[*b.schema.names, "home"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once in its home cell and, as a probe, in the cells that it visits, nearest first. The walk goes a hair beyond the bound; whether a
        cell is inside is decided where vectors meet."""
        schema = pa.schema([("cell", pa.int64()), ("probe", pa.bool_()), ("node", pa.int64()), ("n", pa.int64()), ("home", pa.int64()), ("x", pa.list_(pa.float32() if kind == "float" else pa.float64()))])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                given = vectors_of(b)
                unit, home, node, n = units(given), *(b.column(c).to_numpy() for c in ("home", "node", "n"))
                h = [offsets(u, w, g)[1] for u, w, g in zip((unit[:, :half], unit[:, half:]), books, between, strict=True)]
                visits = [multi_sequence(p, q, bound * (1 + 1e-9) + 1e-12) for p, q in zip(*h, strict=True)]
                source = np.concatenate([np.arange(len(unit)), np.repeat(np.arange(len(unit)), [len(v) for v in visits])])
                cell = np.concatenate([home, *visits])
                for part in np.array_split(np.arange(len(source)), max(1, len(source) // 8192)):
                    s = source[part]
                    x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(s) * dim + 1, dim), pa.int32()), pa.array(given[s].ravel().astype(np.float32 if kind == "float" else np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[part], pa.int64()), pa.array(part >= len(unit), pa.bool_()), pa.array(node[s]), pa.array(n[s]), pa.array(home[s]), x], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a partition sorted by cell, block and probe, the stored rows of a block come first and the probes stream past them. Emits, for each node
        linked here, how many rows it gained and one edge towards its component.

        A pair is met twice if each looks into the other's cell, and then each side counts what it found by its own probe; if only one
        looks, its probe counts for both."""
        schema = pa.schema([("node", pa.int64()), ("linked", pa.int64()), ("other", pa.int64())])

        def met(cell: int, stored: list[tuple], probes: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not stored or not probes:
                return
            (nodes, weights, _, s), (seekers, own, homes, p) = ([np.concatenate(c) for c in zip(*side, strict=True)] for side in (stored, probes))
            s, p = units(s), units(p)
            inside = crossing(p, homes, divmod(cell, k), books, between, k) <= bound
            seekers, own, homes, p = seekers[inside], own[inside], homes[inside], p[inside]
            i, j = np.nonzero(p @ s.T >= similarity - 1e-9)
            fine = (seekers[i] != nodes[j]) & ((p[i] * s[j]).sum(1) >= similarity)  # the exact check, as a plain sum of products
            i, j = i[fine], j[fine]
            if not len(i):
                return
            ru, su = np.unique(i), np.unique(j)
            away, which = np.unique(homes[ru], return_inverse=True)
            outside = np.zeros((len(away), len(nodes)), bool)  # from which homes of probes a stored row isn't looked for
            for a, there in enumerate(away.tolist()):
                outside[a, su] = crossing(s[su], np.full(len(su), cell), divmod(there, k), books, between, k) > bound
            alone = outside[which[np.searchsorted(ru, i)], j]
            gained = [np.bincount(i, weights[j], len(seekers)), np.bincount(j[alone], own[i[alone]], len(nodes))]
            names = np.concatenate([seekers, nodes])
            some = np.zeros(len(names), bool)
            some[ru] = some[su + len(seekers)] = True
            names, gained = names[some], np.concatenate(gained)[some].astype(np.int64)
            up, down = forest(seekers[i], nodes[j])  # in the order of ``up``
            at = np.minimum(np.searchsorted(up, names), max(len(up) - 1, 0))
            other = np.where(up[at] == names, down[at], names) if len(up) else names
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(gained), pa.array(other)], schema=schema)

        key, stored, probes, held = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cell, block, probe, node, n, home = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "probe", "node", "n", "home"))
            x = vectors_of(b)
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (probe[1:] != probe[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)], strict=True):
                if (cell[lo], block[lo]) != key:
                    if key:
                        yield from met(int(key[0]), stored, probes)
                    key, stored, probes, held = (cell[lo], block[lo]), [], [], 0
                if not probe[lo]:
                    stored.append((node[lo:hi], n[lo:hi], home[lo:hi], x[lo:hi]))
                    continue
                for at in range(lo, hi, BLOCK):
                    to = min(at + BLOCK, hi)
                    probes.append((node[at:to], n[at:to], home[at:to], x[at:to]))
                    held += to - at
                    if held >= BLOCK:
                        yield from met(int(key[0]), stored, probes)
                        probes, held = [], 0
        if key:
            yield from met(int(key[0]), stored, probes)

    homed = materialize(distinct.select("node", "n", "x").mapInArrow(placed_rows, f"node long, n long, x array<{kind}>, home long"), "homed-vectors")
    placed = homed.mapInArrow(cells, f"cell long, probe boolean, node long, n long, home long, x array<{kind}>")
    # cells above the block size: n / BLOCK at most, two numbers each, so their list may be broadcast while n / BLOCK stays below 100,000
    homes = homed.groupBy(F.col("home").alias("cell")).count().where(F.col("count") > BLOCK)
    homes = materialize(homes.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-cells")
    large = F.broadcast(homes) if n / BLOCK < 100_000 else homes
    placed = placed.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("block", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    dealt = placed.select("cell", "block", "probe", "node", "n", "home", "x").repartition("cell", "block").sortWithinPartitions("cell", "block", "probe")
    links = materialize(dealt.mapInArrow(compare, "node long, linked long, other long"), "vector-links")
    counts = links.groupBy(F.col("node").alias("a")).agg(F.sum("linked").alias("linked"))
    parts = connected_components(links, "node", "other")
    ids = distinct.select("node", "first_id", "n")
    first = parts.join(ids, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = ids.join(counts, ids["node"] == counts["a"], "left").drop("a").join(parts.join(first, "component").select("node", "component_id"), "node", "left")
    # written first, so that the join with all rows has two plain sides and Spark can split a vector of very many copies
    return materialize(known, "vector-results")


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
