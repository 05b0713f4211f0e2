"""Secret scans: fixed patterns, and candidate strings whose sliding windows are as random as keys are."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# For these two, a run that is too short has no longer match inside, so the least length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings: runs of the characters that keys are written in, a window long at least.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Matches whose places are summed up one by one; longer lists are summed by chunks.
CHUNK = 512


@dataclass(frozen=True)
class CharacterClass:
    """A candidate belongs to the first class whose pattern it matches; ``least`` is the entropy in bits that a window must reach."""

    name: str
    pattern: str
    least: float


CLASSES = (
    CharacterClass("digits", r"^[0-9]+$", math.inf),  # numbers aren't told from keys by their entropy
    CharacterClass("hex", r"^[0-9a-fA-F]+$", 3.2),
    CharacterClass("letters", r"^[A-Za-z]+$", math.inf),  # long words, invented ones too
    CharacterClass("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8),
)
#: Words that stand for a secret: the parts of a candidate around them are judged, not they.
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]?(?:api[_-]?)?key|dummy|xxxx+|abcdefghijklm|0123456789abcdef"
#: Parts that look like keys but are none: rulers, UUIDs, paths of words.
ALLOWED = (
    r"^[-_=+/]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z/_=+-]+$",
)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches, not overlapping, with places: array of (start, end, found) in code points, end exclusive.

    The text between matches is what ``split`` gives, so lengths of both, added up, give the places. Appending to an array copies it, so the
    sums run over chunks of matches and inside each chunk, which keeps the copies short however many matches a text has.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1 + group)) if group else whole
    gaps = F.split(text, pattern, -1)

    def piece(g: Column, m: Column) -> Column:
        return F.struct(F.char_length(g).alias("gap"), F.char_length(m["whole"]).alias("n"), m["value"].alias("value"))

    def chunk_sums(chunks: Column) -> Column:
        length = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, p: s + p["gap"] + p["n"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(length, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def places(chunk: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

        def add(s: Column, p: Column) -> Column:
            end = s["at"] + p["gap"] + p["n"]
            return F.struct(end.alias("at"), F.array_append(s["out"], F.struct((s["at"] + p["gap"]).alias("start"), end.alias("end"), p["value"].alias("value"))).alias("out"))

        return F.aggregate(chunk, start, add, lambda s: s["out"])

    pieces = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("whole"), value.alias("value")), piece)
    cut = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda k: F.slice(p, k * CHUNK + 1, CHUNK)))[0]
    return F.flatten(F.transform(F.array(cut), lambda chunks: F.zip_with(chunks, chunk_sums(chunks), places))[0])


def _spans(text: Column, kind: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Matches whose value has ``least`` characters or more, as (start, rank of the kind, end)."""
    found = F.filter(_matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least)
    rank = KINDS.index(kind)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("kind"), m["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def highest_entropy(s: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` characters of ``s`` in a row.

    With n counts, window * entropy = window * log2(window) - sum of f(n), f(n) = n * log2(n). One fold over the characters keeps the counts of the window's
    characters as a map: a step adds one to the count of the character that enters and takes one from that of the one that leaves, so the
    sum changes by two differences of f, and the time is linear in the length.
    """

    def step(n: Column) -> Column:  # f(n + 1) - f(n)
        m = n.cast("double")
        return (m + 1) * F.log2(m + 1) - F.when(n > 0, m * F.log2(F.greatest(m, F.lit(1.0)))).otherwise(0.0)

    def count(counts: Column, c: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, c), F.lit(0))

    def change(counts: Column, c: Column, by: int) -> Column:
        return F.map_concat(F.map_filter(counts, lambda k, n: (k != c) & (n > 0)), F.create_map(c, count(counts, c) + by))

    def inside(chars: Column) -> Column:
        def move(state: Column, at: Column) -> Column:
            enters, leaves = F.get(chars, at), F.get(chars, at - window)
            less = F.when(at >= window, change(state["counts"], leaves, -1)).otherwise(state["counts"])
            total = state["sum"] - F.when(at >= window, step(count(state["counts"], leaves) - 1)).otherwise(0.0)

            def enter(left: Column) -> Column:
                now = total + step(count(left, enters))
                return F.struct(change(left, enters, 1).alias("counts"), now.alias("sum"), F.when(at >= window - 1, F.least(state["least"], now)).otherwise(state["least"]).alias("least"))

            return F.transform(F.array(less), enter)[0]

        start = F.struct(F.create_map().cast("map<string,int>").alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e18).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, move, lambda t: F.lit(math.log2(window)) - t["least"] / window)

    return F.when(F.char_length(s) >= window, F.transform(F.array(F.split(s, "")), inside)[0]).otherwise(0.0)


def _secret(part: Column) -> Column:
    """Whether a window of the part reaches the entropy of the part's class."""
    least = F.lit(math.inf)
    for c in reversed(CLASSES):
        least = F.when(F.regexp_like(part, F.lit(c.pattern)), F.lit(c.least)).otherwise(least)
    for pattern in ALLOWED:
        least = F.when(F.regexp_like(part, F.lit(pattern)), F.lit(math.inf)).otherwise(least)
    return F.when((F.char_length(part) < WINDOW) | (least == math.inf), False).otherwise(highest_entropy(part, WINDOW) >= least)


def _entropy_spans(text: Column) -> Column:
    secret = lambda m: F.exists(F.split(m["value"], PLACEHOLDER, -1), _secret)
    spans = F.transform(F.filter(_matches(text, CANDIDATE), secret), lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``entropy``: sorted arrays of (start, kind, end), in code points, end exclusive.

    base holds the pattern matches of three kinds (0 assign, 1 access, 2 hex); entropy (kind 3) the candidate strings with a window at or
    above their class's entropy outside placeholder words and parts on the allow-list. The time is linear in the length of a text, whatever it holds. Null texts have no spans; columns named base or entropy are replaced. Rows are scanned one
    by one without a shuffle, so neither repeated rows nor hot keys matter, and memory holds one text at a time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_spans(text, "assign", ASSIGN, LEAST_VALUE, 2), _spans(text, "access", ACCESS), _spans(text, "hex", HEX))
    return docs.withColumn("__base", F.array_sort(base)).withColumn("__entropy", _entropy_spans(text)).drop("base", "entropy").withColumnsRenamed({"__base": "base", "__entropy": "entropy"})


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs)

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.concat("base", "entropy")).alias("spans"), F.size("entropy").cast("bigint").alias("n_entropy"),
    )
