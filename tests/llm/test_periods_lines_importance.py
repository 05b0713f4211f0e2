"""Periodic runs, repeated lines and importance resampling against brute force, and with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import importance, lines, periods

SCHEMA = "doc_id long, text string, id string, row long, given string, line int, bucket int, `a.b` int, n_words string, shard int"


def docs(spark, texts):
    """Rows with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4, "z", 5) for i, t in texts], SCHEMA)


# --- periodic runs --------------------------------------------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and not any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts():
    rng = random.Random(5)
    made = []
    for i in range(120):
        w = []
        while len(w) < rng.choice([3, 20, 60, 150]):
            unit = [rng.choice("ab" if i % 3 else "abcdefg") for _ in range(rng.randint(1, 7))]
            w += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        made.append(rng.choice([" ", "\n", "\x0b\t"]).join(w))
    return made


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_runs_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periods, "PAIRS", pairs)
    for text in [*periodic_texts(), "", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "a b c a b c a b c a b"]:
        w = text.split()
        start, end, period = periods.runs(periods._coded([x.encode() for x in w]))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == brute_runs(w), text


def test_runs_of_three_periods():
    w = "x a b c a b c a b c y".split()
    assert [x.tolist() for x in periods.runs(periods._coded(w), times=3)] == [[1], [10], [3]]
    with pytest.raises(ValueError, match="three"):
        periods.runs(periods._coded(w), times=2)


def test_a_false_hash_is_noticed(monkeypatch):
    """Hashes that take all words for equal make every run too long; the words tell, and another base is taken."""
    whole, used = periods.PrefixHashes.same, []

    def same(self, at, period, length):
        used.append(int(self.powers[1]))
        return np.ones(len(at), bool) if used[-1] == periods.BASES[0] else whole(self, at, period, length)

    monkeypatch.setattr(periods.PrefixHashes, "same", same)
    w = "x a b a b a b a b a b y z".split()
    assert [x.tolist() for x in periods.runs(periods._coded(w))] == [[1], [11], [2]]
    assert set(used) == set(periods.BASES[:2])


def test_one_word_a_hundred_thousand_times():
    assert [x.tolist() for x in periods.runs(np.zeros(100_000, np.int64))] == [[0], [100_000], [1]]


def test_found_runs_and_collapsed_texts(spark):
    texts = [*enumerate(periodic_texts()), (500, None), (501, ""), (502, " \n "), (None, "a a a a a a b"), (503, "é é é é é é É"), (504, "w\x1cx " * 9), (505, " ".join(f"w{i % 3}" for i in range(30_000)))]
    texts += [texts[0], texts[3]]
    out = periods.find_runs(docs(spark, texts))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in out.collect())
    want = Counter()
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(w) if len(w) < 5000 else [(0, 30_000, 3)]
        want[(i, len(w), tuple(runs), brute_collapsed(w, runs))] += 1
    assert got == want
    assert periods.find_runs(docs(spark, [])).count() == 0


def test_planted_tails(spark):
    rng = random.Random(2)
    texts = [(i, " \n".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) + rng.choice(["", " "])) for i in range(200)] + [(None, "a b"), (7, None)]
    for r in docs(spark, texts).select("doc_id", "text", periods.planted(F.col("text"), F.col("doc_id")).alias("p")).collect():
        if r["doc_id"] is None or r["text"] is None or (h := zlib.crc32(str(r["doc_id"]).encode())) % 10:
            assert r["p"] == r["text"]
            continue
        w, g = r["text"].split(), h // 10
        if w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        assert r["p"].split() == w


# --- lines ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_numbers_its_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    mph = lines.PerfectHash.of(keys)
    assert sorted(mph.number(keys).tolist()) == list(range(len(keys)))
    other = mph.number(keys + np.uint64(1 << 63))
    assert len(keys) == 0 or (other.min() >= -1 and other.max() < len(keys))
    assert mph.sizes.sum() <= 64 * 40 + 2 * lines.BITS_PER_KEY * 3 * len(keys)


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError, match="repeat"):
        lines.PerfectHash.of(np.array([4, 4], np.uint64))


def brute_lines(rows, least=2):
    key = lambda s: re.sub(r"[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    held = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                held.setdefault(key(s), set()).add(i)
    first = {k: min(ids, key=order) for k, ids in held.items() if len(ids) >= least}
    out = Counter()
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [s for s in own if key(s) not in first or first[key(s)] == i]
        out[(i, len(own), len(own) - len(kept), "\n".join(kept))] += 1
    return out


def line_texts():
    rng = random.Random(3)
    pool = [f"line {i} of many words" for i in range(40)] + ["short", "123456789", "1234567890", "é" * 9, "é" * 10, "É" * 10, "TAB and Case", "\ttab AND case \x0b\r", "\x1cnot white space", "", " "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(i, f"a line that all hold\n{'x' * (i % 7)}") for i in range(200, 500)]
    rows += [(600, None), (601, ""), (602, "\n\n"), (603, "\n".join(f"line {i} of many words" for i in range(20_000))), (None, "line 3 of many words\nonly without an id"), (None, "only without an id"), (-5, "line 7 of many words"), (604, "twice in one text\ntwice in one text")]
    return [*rows, rows[0], rows[160], (3, "a second text of an id\nline 1 of many words"), (3, "a second text of an id")]


@pytest.mark.parametrize(("size", "least"), [(1 << 20, 2), (40, 2), (1 << 20, 5)])
def test_dropped_lines_equal_brute_force(spark, monkeypatch, size, least):
    monkeypatch.setattr(lines, "SHARD_LINES", size)
    rows = line_texts()
    out = lines.drop_repeated_lines(docs(spark, rows), least_docs=least)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert Counter(map(tuple, out.collect())) == brute_lines(rows, least)


def test_no_documents_have_no_lines(spark):
    assert lines.drop_repeated_lines(docs(spark, [])).count() == 0


def test_hashes_that_keys_share_stay_apart(spark, monkeypatch):
    """With three values of h for all lines, fingerprints and further rows of a shard tell them apart."""
    whole = lines.line_hashes
    monkeypatch.setattr(lines, "line_hashes", lambda *a: whole(*a).withColumn("h", F.pmod("h", F.lit(3))))
    rows = line_texts()
    assert Counter(map(tuple, lines.drop_repeated_lines(docs(spark, rows)).collect())) == brute_lines(rows)


def test_index_holds_counts_and_first_holders(spark):
    df = docs(spark, [(i, f"a line that all hold\nown line number {i}") for i in range(5, 25)])
    hashed = lines.line_hashes(lines._rows(df, "doc_id", "text"))
    rows = lines.build_index(hashed, 1).collect()
    assert [(r["n"], np.frombuffer(r["counts"], np.int64).tolist(), np.frombuffer(r["holders"], np.int64).tolist()) for r in rows] == [(1, [20], [5])]


def test_a_hot_line_is_dealt_over_copies_of_its_shard(spark):
    df = docs(spark, [(i, "a line that all hold\n" + "\n".join(f"own line {i} {j}" for j in range(4))) for i in range(400)])
    hashed = lines.line_hashes(lines._rows(df, "doc_id", "text"))
    shards = 64
    index = lines.build_index(hashed, shards)
    got = lines.repeated_lines(hashed, index, shards).collect()
    assert {(r["id"], r["line"], r["docs"]) for r in got} == {(i, 0, 400) for i in range(1, 400)}


# --- importance -------------------------------------------------------------------------------------------------------------------


def brute_features(text, order=3):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(brute_features(x)[1])
    for x in target:
        t.update(brute_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        n, f = brute_features(x)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = long[: percent * len(long) // 100]
    return Counter((*r, k + 1) for k, r in enumerate(drawn)) + Counter((*r, None) for r in [*long[len(drawn) :], *(r for r in out if r[1] < least)])


def prose():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéü9Z") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 19, 20, 21, 60])))) for i in range(400)]
    same = " ".join(words[:40])
    rows += [(500, None), (501, ""), (502, "?!"), (503, same), (503, same), (None, same), (504, " ".join(rng.choice(words) for _ in range(40_000))), rows[5]]
    return rows, [" ".join(words[i : i + 30]) for i in range(0, 120, 30)] + [None, ""]


def test_ring_gives_all_runs_of_words(monkeypatch):
    monkeypatch.setattr(importance, "EMITTED", 10)
    for _, text in prose()[0][:100]:
        for order in (1, 2, 3, 5):
            got = Counter(b for some in importance.feature_buckets((text or "").encode(), order) for b in some.tolist())
            assert got == Counter(brute_features(text, order)[1])


@pytest.mark.parametrize("percent", [5, 50])
def test_resample_equals_brute_force(spark, percent):
    rows, target = prose()
    out = importance.resample(docs(spark, rows), spark.createDataFrame([(x, 1) for x in target], "text string, gain int"), percent=percent)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, out.collect())) == brute_resample(rows, target, percent)


def test_resample_of_nothing_and_towards_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs(spark, []), none).count() == 0
    rows = prose()[0][:60]
    assert Counter(map(tuple, importance.resample(docs(spark, rows), none, percent=20).collect())) == brute_resample(rows, [], 20)


def test_ranks_are_gapless_under_ties(spark):
    scored = spark.range(1000).select((F.col("id") % 3).alias("score"), "id").repartition(7)
    got = importance.ranked(scored, [F.col("score").desc(), F.col("id").asc()]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001))
    assert all((-a["score"], a["id"]) < (-b["score"], b["id"]) for a, b in pairwise(got))
