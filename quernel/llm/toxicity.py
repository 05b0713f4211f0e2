"""Toxic spans by a linear-chain conditional random field, document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.scratch import materialize

WORD = re.compile(r"\w+")
#: Labelled documents of each class that the model is fitted on, the first in the order of a hash of their id.
SAMPLE_PER_CLASS = 4000
#: A word or beginning is a feature if so many toxic documents of the sample have it, at these log odds at least.
LEAST_SUPPORT, LEAST_LOG_ODDS = 3, 1.0
PREFIXES = (4, 5, 6, 7, 8)
#: Pull of the pairs of states to zero. Which tokens follow a toxic one in a toxic document, its label doesn't say, so without it a state could go on for good. The pull and the number of rounds are
#: those that ``cross_validate`` finds best inside the learning rows.
STEP_PRIOR, ROUNDS = 0.02, 100
#: Tokens of a segment, whose chain is fitted apart from its neighbours'; all segments of a document count in the fit.
SEGMENT = 48
#: Segments whose forward and backward passes are held at a time.
CHUNK = 16_384


def lowered(text: str) -> str:
    """Lower case, character for character, so that places stay the same."""
    return text.replace("\u0130", "i").lower()  # the one character whose lower case is two


def features(word: str) -> list[str]:
    """A word and its beginnings, which stand for its inflections."""
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


@dataclass
class Crf:
    """States 0 (clean) and 1 (toxic). Score of a path: ``step`` for each pair of states and, in state 1, ``bias`` and the weights of
    the token's features. Tokens without features all have the same transfer matrix, so a run of them is one
    power of it, in closed form; only tokens with features cost time."""

    weights: dict[str, float]
    step: list[list[float]]
    bias: float
    calibration: list[float]
    prior: float

    def __post_init__(self) -> None:
        self.heads = frozenset(f[1:5] for f in self.weights)
        (a, b), (c, d) = ([math.exp(x) for x in r] for r in self.step)
        e = math.exp(self.bias)
        self.matrix = ((a, b * e), (c, d * e))
        half, det = (a + d * e) / 2, a * d * e - b * e * c
        root = math.sqrt(max(half * half - det, 1e-300))
        self.large, self.ratio = half + root, (half - root) / (half + root)

    def run(self, k: int) -> tuple:
        """The transfer matrix of k tokens without features, scaled by its largest eigenvalue."""
        if k <= 0:
            return ((1.0, 0.0), (0.0, 1.0))
        (a, b), (c, d) = self.matrix
        q, lo = self.ratio**k, self.ratio * self.large
        s = self.large - lo
        return (((a - lo - (a - self.large) * q) / s, (b - b * q) / s), ((c - c * q) / s, (d - lo - (d - self.large) * q) / s))

    def marginals(self, hits: list[tuple[int, float]], n: int) -> list[float]:
        """Probability of state 1 at each hit (place, weight) of a text with n tokens: forward and backward passes."""
        forward, a0, a1, at = [], 1.0, 0.0, 0
        for place, w in hits:
            (p, q), (r, s) = self.run(place - at)
            a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
            (p, q), (r, s) = self.matrix
            boost = math.exp(min(w, 60.0))
            a0, a1 = a0 * p + a1 * r, (a0 * q + a1 * s) * boost
            z = a0 + a1
            a0, a1, at = a0 / z, a1 / z, place + 1
            forward.append((a0, a1))
        out, b0, b1, end = [], 1.0, 1.0, n
        for (place, w), (f0, f1) in zip(reversed(hits), reversed(forward), strict=True):
            (p, q), (r, s) = self.run(end - place - 1)
            b0, b1 = p * b0 + q * b1, r * b0 + s * b1
            out.append(f1 * b1 / (f0 * b0 + f1 * b1))
            (p, q), (r, s) = self.matrix
            boost = math.exp(min(w, 60.0))
            b0, b1 = p * b0 + q * boost * b1, r * b0 + s * boost * b1
            z = b0 + b1
            b0, b1, end = b0 / z, b1 / z, place
        return out[::-1]

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        heads, known = self.heads, self.weights
        out = []
        for i in [i for i, w in enumerate(words) if w[:4] in heads]:
            fs = [known[f] for f in features(words[i]) if f in known]
            if fs:
                out.append((i, sum(fs)))
        return out

    def score(self, marginals: list[float], n: int) -> float:
        x = document_features(marginals, n)
        z = sum(c * v for c, v in zip(self.calibration, (1.0, *x), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def document_features(marginals: list[float], n: int) -> tuple[float, ...]:
    """The chance that any token is toxic; the expected number of toxic tokens, on a log scale and up to three; its
    share of the tokens on a log scale."""
    clean = 1.0
    for p in marginals:
        clean *= 1 - p
    total = sum(marginals)
    return 1 - clean, math.log1p(total), min(total, 3.0), math.log1p(1000 * total / (n + 50))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of 1 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def labelled_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, toxic)`` outside the held-out fold. Null labels don't count; an id with several labels counts as toxic if one says so."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 1))
    return known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """``(toxic, text)``: at most ``per_class`` of the labelled ids of each class, so classes may be drawn at different rates. An id of several
    rows gives one, its least text."""
    known = labelled_ids(labels, id_col, label_col)
    order = F.xxhash64("id", F.lit(9))
    ids = [known.where(F.col("toxic") == c).orderBy(order, "id").limit(per_class) for c in (0, 1)]
    chosen = ids[0].unionByName(ids[1])  # 2 * per_class rows at most, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = sorted({f for w in set(WORD.findall(lowered(text))) for f in features(w)})
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic] * len(found), pa.int32()), "feature": pa.array(found, pa.string())})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, pull: float = STEP_PRIOR, rounds: int = ROUNDS) -> Crf:
    """Fit on a bounded sample. Labels are of documents, so the tokens' labels are the field's hidden states: a document is toxic if any of its tokens is, and the
    weights maximise the likelihood of the documents' labels under that. Words and beginnings that toxic documents have more often are the features.
    The document scores are fitted to the documents' labels by logistic regression. In both fits a document
    stands for as many as its class has labelled ids for each one drawn, so scores don't depend on the number of documents."""
    sample = materialize(labelled_sample(docs, labels, id_col, text_col, label_col, per_class), "toxicity-sample")
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    known = {r["toxic"]: r["count"] for r in labelled_ids(labels, id_col, label_col).groupBy("toxic").count().collect()}  # two rows
    each = {c: max(1.0, known[c] / per_class) for c in known}
    total = sum(counts[c] * each[c] for c in counts)
    prior = n1 * each[1] / total if n1 else 0.0
    if not n0 or not n1:
        return Crf({}, [[0.0, 0.0], [0.0, 0.0]], -5.0, [math.log((prior + 1e-3) / (1 - prior + 1e-3)), 0.0, 0.0, 0.0, 0.0], prior)
    odds = F.ln((F.col("n1") + 0.5) / (n1 + 1)) - F.ln((F.col("n0") + 0.5) / (n0 + 1))
    by_feature = sample.mapInArrow(_feature_rows, "toxic int, feature string").groupBy("feature").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).withColumn("odds", odds)
    chosen = by_feature.where((F.col("n1") >= LEAST_SUPPORT) & (F.col("odds") >= LEAST_LOG_ODDS))
    index = {f: i for i, f in enumerate(sorted(r["feature"] for r in chosen.select("feature").collect()))}  # words of the sample's per_class toxic documents
    heads = frozenset(f[1:5] for f in index)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's number of tokens, the places of its tokens with features, and these features, joined by commas."""
        for b in batches:
            toxic, texts = b.column("toxic").to_pylist(), b.column("text").to_pylist()
            n, places, found = [], [], []
            for text in texts:
                words = WORD.findall(lowered(text))
                hits = [(i, ids) for i, w in enumerate(words) if w[:4] in heads and (ids := [index[f] for f in features(w) if f in index])]
                n.append(len(words))
                places.append([i for i, _ in hits])
                found.append([",".join(map(str, ids)) for _, ids in hits])
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic, pa.int32()), "n": pa.array(n, pa.int64()), "places": pa.array(places, pa.list_(pa.int64())), "found": pa.array(found, pa.list_(pa.string()))})

    rows = sample.mapInArrow(sequences, "toxic int, n long, places array<long>, found array<string>").collect()  # 2 * per_class rows at most
    docs_ = sorted((r["toxic"], r["n"], list(r["places"]), [[int(x) for x in f.split(",")] for f in r["found"]]) for r in rows)
    theta, step, bias = _fit_field(docs_, len(index), each, rounds, pull=pull)
    crf = Crf({f: float(theta[i]) for f, i in index.items()}, step, bias, [0.0] * 5, prior)
    x = np.array([(1.0, *document_features(crf.marginals([(p, float(sum(theta[i] for i in ids))) for p, ids in zip(places, found, strict=True)], n), n)) for _, n, places, found in docs_])
    crf.calibration = _fit_logistic(x, np.array([d[0] for d in docs_], float), np.array([each[d[0]] for d in docs_]))
    return crf


def cross_validate(docs: DataFrame, labels: DataFrame, settings: Sequence[tuple[float, int]], folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> list[tuple]:
    """``(pull, rounds, loss)`` of each setting: the mean logarithmic loss of learning rows that a fit on the other folds scores. Rows of the held-out fold are neither fitted nor scored."""
    known = materialize(labelled_ids(labels, id_col, label_col).withColumn("part", F.pmod(F.xxhash64("id", F.lit(31)), F.lit(folds))), "learning-labels")
    out = []
    for pull, rounds in settings:
        total = n = 0.0
        for part in range(folds):
            own = known.where(F.col("part") != part).select(F.col("id").alias(id_col), F.col("toxic").alias(label_col))
            crf = fit(docs, own, id_col, text_col, label_col, per_class, pull, rounds)
            judged = known.where(F.col("part") == part).select(F.col("id").alias("judged_id"), "toxic")
            met = docs.join(judged, F.col(id_col) == F.col("judged_id"), "left_semi")
            scored = tag(met, crf, id_col, text_col).join(judged, F.col(id_col) == F.col("judged_id"))
            p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
            row = scored.agg(F.sum(-F.when(F.col("toxic") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"), F.count("*").alias("n")).first()
            total, n = total + (row["loss"] or 0.0), n + row["n"]
        out.append((pull, rounds, total / n if n else math.nan))
    return out


def _fit_field(docs: list[tuple], n_features: int, each: dict[int, float], rounds: int = ROUNDS, l2: float = 0.005, pull: float = STEP_PRIOR) -> tuple[np.ndarray, list[list[float]], float]:
    """Maximum likelihood of the documents' labels, with hidden states. A document is clean with the chance P0 that all its tokens are in state 0, the product of its
    segments'. The gradient of log P0 is that of the path of zeros less what the field expects; of log(1 - P0) it is the same times
    -P0 / (1 - P0). Segments without features differ in their length only, so each length is worked on once. ``each``: the weight of a document of each class."""
    segments, owner, blank = [(n, []) for n in range(1, SEGMENT + 1)], [], np.zeros((len(docs), SEGMENT))
    for d, (_, n, places, found) in enumerate(docs):
        inside: dict[int, list] = {}
        for p, ids in zip(places, found, strict=True):
            inside.setdefault(p // SEGMENT, []).append((p % SEGMENT, ids))
        segments += [(min(SEGMENT, n - s * SEGMENT), hits) for s, hits in sorted(inside.items())]
        owner += [d] * len(inside)
        full, rest = divmod(n, SEGMENT)
        blank[d, -1] = full - sum(s < full for s in inside)
        if rest and full not in inside:
            blank[d, rest - 1] += 1
    chunks = [_arrays(segments[k : k + CHUNK]) for k in range(0, len(segments), CHUNK)]
    owner_, toxic, weights = np.array(owner, int), np.array([d[0] for d in docs], bool), np.array([each[d[0]] for d in docs])
    params, m, v = (np.zeros(n_features + 5) for _ in range(3))
    params[-1] = -8.0  # so that long clean texts aren't toxic from the start
    for t in range(1, rounds + 1):
        parts = [_expected(params, n_features, *c) for c in chunks]
        log_zero = np.concatenate([p[0] for p in parts])
        zero = np.exp(np.minimum(blank @ log_zero[:SEGMENT] + np.bincount(owner_, log_zero[SEGMENT:], len(docs)), -1e-6))
        share = weights * np.where(toxic, zero / (1 - zero), -1.0)
        of_segments = np.concatenate([share @ blank, share[owner_]])
        grad, at = np.zeros(len(params)), 0
        for (_, pairs, on, at_hits), (lengths, row, _, feat) in zip(parts, chunks, strict=True):
            own = of_segments[at : at + len(lengths)]
            at += len(lengths)
            grad[n_features:-1] += pairs @ own
            grad[n_features] -= lengths @ own  # the pairs of the path of zeros
            grad[-1] += on @ own
            grad[:n_features] += np.bincount(feat, at_hits * own[row], n_features)
        grad = grad / weights.sum() - l2 * params / len(params) ** 0.5
        grad[n_features:-1] -= pull * params[n_features:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return params[:n_features], params[n_features:-1].reshape(2, 2).tolist(), float(params[-1])


def _arrays(segments: list[tuple]) -> tuple[np.ndarray, ...]:
    """Lengths of the segments; segment, place and feature of each feature in them."""
    hits = [(k, p, f) for k, (_, inside) in enumerate(segments) for p, ids in inside for f in ids]
    row, col, feat = np.array(hits, int).reshape(-1, 3).T
    return np.array([s[0] for s in segments]), row, col, feat


def _expected(params: np.ndarray, n_features: int, lengths: np.ndarray, row: np.ndarray, col: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each segment: log chance of the path of zeros, expected numbers of the four pairs of states and of tokens in state 1; and the chance of state 1 at each
    feature's token. Forward and backward passes over all segments at once."""
    size, step = len(lengths), params[n_features:-1]
    emit = np.full(SEGMENT * size, params[-1]) + np.bincount(col * size + row, params[feat], SEGMENT * size)
    a, b, c, d = np.exp(step)
    on = np.exp(np.clip(emit, -30, 30)).reshape(SEGMENT, size)
    ahead, log_z = np.zeros((SEGMENT + 1, size)), np.zeros(size)  # chance of state 1 before each place, from the left
    for i in range(SEGMENT):
        f, live = ahead[i], i < lengths
        zero, one = a + f * (c - a), (b + f * (d - b)) * on[i]
        total = zero + one
        ahead[i + 1] = one / total
        log_z += np.log(total) * live
    chance, back, pairs = np.zeros((SEGMENT, size)), np.full(size, 0.5), np.zeros((4, size))  # ``back``: the same from the right
    for i in range(SEGMENT - 1, -1, -1):
        f, live = ahead[i], i < lengths
        zero, one = 1 - back, back * on[i]
        az, bo, cz, do = a * zero, b * one, c * zero, d * one
        r0, r1 = az + bo, cz + do
        share = live / (r0 + f * (r1 - r0))
        left, right = (1 - f) * share, f * share
        pairs[0] += left * az
        pairs[2] += right * cz
        p01, p11 = left * bo, right * do
        pairs[1] += p01
        pairs[3] += p11
        chance[i] = p01 + p11
        back = np.where(live, r1 / (r0 + r1), back)
    return lengths * step[0] - log_z, pairs, chance.sum(0), chance[col, row]


def _fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, l2: float = 1e-3) -> list[float]:
    """Newton steps of a ridge logistic regression of weighted rows."""
    share = weights / weights.sum()
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (share * (y - p)) - l2 * w)
    return w.tolist()


def tag(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``(doc_id, score, spans)`` of every whole text, in the partitions of ``docs``: spans are the toxic tokens' offsets in code points of the text as it is, end
    exclusive, with their marginals. Null and empty texts are scored as texts without tokens; each row is scored by itself, so rows that repeat an
    id, or have a null one, each give theirs; other columns, whatever their names, are ignored; an empty table gives an empty result."""
    schema = pa.schema([(id_col, pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))])
    model = (crf.weights, crf.step, crf.bias, crf.calibration, crf.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*model)
        none = own.score([], 0)
        for b in batches:
            scores, spans = [], []
            for text in b.column("text"):
                lower = lowered(text.as_py() or "")
                words = WORD.findall(lower)
                hits = own.hits(words)
                if not hits:
                    scores.append(none)
                    spans.append([])
                    continue
                p = own.marginals(hits, len(words))
                scores.append(own.score(p, len(words)))
                toxic = {i: m for (i, _), m in zip(hits, p, strict=True) if m >= least}
                spans.append([{"start": m.start(), "end": m.end(), "marginal": toxic[i]} for i, m in enumerate(WORD.finditer(lower)) if i in toxic])
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, schema.field("spans").type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, score double, spans array<struct<start: long, end: long, marginal: double>>")


def reject(docs: DataFrame, crf: Crf, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with their columns; rows are judged one by one, null texts as empty ones."""
    text_at = docs.columns.index(text_col)
    model = (crf.weights, crf.step, crf.bias, crf.calibration, crf.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*model)
        none = own.score([], 0)
        for b in batches:
            keep = []
            for text in b.column(text_at):
                words = WORD.findall(lowered(text.as_py() or ""))
                hits = own.hits(words)
                keep.append((own.score(own.marginals(hits, len(words)), len(words)) if hits else none) < threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crf = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = tag(docs, crf)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), spans.alias("spans"))
