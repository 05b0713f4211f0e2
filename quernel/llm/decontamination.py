"""Benchmark decontamination: spaced-seed hits, verified by overlaps that tolerate substituted words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.ordering import quoted
from quernel.llm.scratch import materialize

#: Places of a window that each mask looks at. Together they hit every window of 8 to 16 words of which 80% match, wherever the
#: other words are (tests try all cases), so no overlap that the check below accepts is missed.
MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
#: Items of fewer than LEAST_WORDS words can't be told from chance with a word changed: they are found where all their words stand in a row,
#: by a mask as long as the item.
WINDOW, SIMILARITY, LEAST_WORDS = 16, 0.8, 8
#: Bytes of the benchmark's seeds and words that are broadcast; a larger benchmark meets the documents' seeds by a shuffle.
MOST_BROADCAST = 64 << 20
#: Words of a block, and words before and after it that are kept along: all windows with a seed of the block lie inside.
BLOCK, HALO = 64, WINDOW


def words(text: Column) -> Column:
    """Words in lower case: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _coded(text: Column, masks: tuple) -> Column:
    """Struct of the words and the seed hashes: place p (from 0), mask k at index p * len(masks) + k, null where a mask reaches
    beyond the end. Arrays of one element bind words and their hashes to variables, so that both are computed once for each text."""

    def seeds(h: Column, p: Column) -> Column:
        return F.array(*[F.when(p + m[-1] < F.size(h), F.xxhash64(F.lit(k), *[F.get(h, p + o) for o in m])) for k, m in enumerate(masks)])

    def hashes(h: Column) -> Column:
        return F.flatten(F.transform(h, lambda _, p: seeds(h, p)))

    def both(w: Column) -> Column:
        coded = F.transform(w, lambda x: F.xxhash64(x))
        return F.struct(w.alias("words"), F.transform(F.array(coded), hashes)[0].alias("hashes"))

    return F.transform(F.array(words(text)), both)[0]


def _blocks(words: Column, hashes: Column | None = None, masks: int = 0) -> Column:
    """Structs of a block's number, the place of its first kept word, its words with the halo and, if given, the hashes of its seeds.
    Rows with the words of a hit are thus of bounded size, whatever the text's length."""

    def block(b: Column) -> Column:
        first = F.greatest(b * BLOCK - HALO, F.lit(0))
        own = [] if hashes is None else [F.slice(hashes, b * (BLOCK * masks) + 1, F.lit(BLOCK * masks)).alias("hashes")]
        return F.struct(b.alias("block"), first.alias("first"), F.slice(words, first + 1, b * BLOCK + (BLOCK + HALO) - first).alias("words"), *own)

    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / BLOCK).cast("int")), block)


def _matching(words: Column, item_words: Column, start: Column) -> Column:
    """0 or 1 for each word of the item that lies on a word of the document, if its first word lies at ``start``."""
    first = F.greatest(F.lit(0), -start)
    length = F.least(F.size(item_words), F.size(words) - start) - first
    return F.zip_with(F.slice(words, F.greatest(start, F.lit(0)) + 1, length), F.slice(item_words, first + 1, length), lambda a, b: (a == b).cast("int"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_key: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(<doc_key>, item_id, start, best)``: each alignment of a document with a benchmark item, ``best`` words of some
    window of 16 words of the item (the whole item if it is shorter) matching, 80% of them at least, all of them in an item of fewer than 8 words;
    ``start`` is the word of the document under the item's first word.

    Texts are compared word by word in lower case without gaps, whole texts on both sides. Null and empty texts have no words; repeated documents or items
    each give their rows; an empty table on either side gives an empty result; other columns, whatever their names, are ignored.

    Documents stay where they are and are verified in place while the benchmark's seeds and words, which are counted first, are small enough to be broadcast. Beyond that only
    (text's digest, place, hash) of each seed is shuffled, and words are fetched for the alignments that share a seed.
    """
    given = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("item_words")).where(F.size("item_words") > 0)
    # equal items are one for the search; the names are those of the first words that share a digest
    given = given.withColumn("item", F.xxhash64("item_words", F.size("item_words")))
    given = materialize(given.groupBy("item", "item_words").agg(F.collect_set(F.struct("item_id")).alias("names")), "benchmark-items")
    short = [r["n"] for r in given.where(F.size("item_words") < LEAST_WORDS).select(F.size("item_words").alias("n")).distinct().orderBy("n").collect()]  # seven at most
    masks = (*MASKS, *[tuple(range(n)) for n in short])
    n, k = F.size("item_words"), F.col("i") % len(masks)
    own = F.when(n >= LEAST_WORDS, k < len(MASKS)).otherwise((k == F.array_position(F.array(*map(F.lit, short)), n) + len(MASKS) - 1) if short else F.lit(False))
    seeds = given.select("item", "item_words", F.posexplode(_coded(F.array_join("item_words", " "), masks)["hashes"]).alias("i", "hash")).where(F.col("hash").isNotNull() & own)
    seeds = materialize(seeds.select("hash", "item", F.floor(F.col("i") / len(masks)).cast("int").alias("item_at")), "benchmark-seeds")
    kept_along = (BLOCK + 2 * HALO) / BLOCK
    size = seeds.count() * 48 + (given.agg(F.sum(F.length(F.array_join("item_words", " ")) + 16 * n)).first()[0] or 0) * kept_along
    keys = [f"key{j}" for j in range(len(doc_key))]
    text = docs.select(*[F.col(c).alias(f"key{j}") for j, c in enumerate(doc_key)], F.col(text_col).alias("text"))
    # The explodes of blocks and of places get their arrays from functions that Spark doesn't compile, so they hand on row by row;
    # a compiled one collects all rows of a text, each with its words, before the first goes on.
    blocks = F.transform(F.array(_coded(F.col("text"), masks)), lambda c: _blocks(c["words"], c["hashes"], len(masks)))[0]
    at = F.col("block") * BLOCK + F.floor(F.col("i") / len(masks)).cast("int")
    # A seed's block of its item is told by its place.
    items = given.select("item", F.size("item_words").alias("n"), F.explode(_blocks(F.col("item_words"))).alias("b"))
    items = items.select("item", F.col("b.block").alias("item_block"), "n", F.col("b.first").alias("item_first"), F.col("b.words").alias("item_words"))
    broadcast = size <= MOST_BROADCAST
    if broadcast:
        # One row for each hash with all its places, so that a repeated seed passes the join once. The outer explode keeps
        # Spark from adding a filter that computes the hashes a second time. Texts that share a key are told apart by their hash.
        places = seeds.groupBy("hash").agg(F.collect_list(F.struct("item", "item_at")).alias("at"))
        each = text.select(*keys, F.xxhash64("text").alias("text_id"), F.explode_outer(blocks).alias("b")).select(*keys, "text_id", "b.*")
        hits = each.select(*keys, "text_id", "block", "first", "words", F.posexplode_outer("hashes").alias("i", "hash")).join(F.broadcast(places), "hash")
        hit = F.transform("at", lambda a: F.struct(a["item"].alias("item"), F.floor(a["item_at"] / BLOCK).cast("int").alias("item_block"), (at - a["item_at"]).alias("start")))
        hits = hits.select(*keys, "text_id", "first", "words", F.explode_outer(hit).alias("hit")).select(*keys, "text_id", "first", "words", "hit.*")
        met = hits.join(F.broadcast(items), ["item", "item_block"])
    else:
        named = text.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
        each = named.select("digest", F.explode_outer(blocks).alias("b")).select("digest", "b.block", F.posexplode_outer("b.hashes").alias("i", "hash")).where("hash is not null")
        hits = each.join(seeds, "hash").select("digest", "block", "item", F.floor(F.col("item_at") / BLOCK).cast("int").alias("item_block"), (at - F.col("item_at")).alias("start"))
        hits = materialize(hits.distinct(), "seed-hits")
        texts = named.select("digest", "text").join(hits.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
        again = F.transform(F.array(words(F.col("text"))), lambda w: _blocks(w))[0]
        texts = texts.select("digest", F.explode_outer(again).alias("b")).select("digest", "b.*")
        # The join reads the hits one by one beside the one block of each.
        met = hits.join(texts, ["digest", "block"]).join(items, ["item", "item_block"])
    same = _matching(F.col("words"), F.col("item_words"), F.col("start") + F.col("item_first") - F.col("first"))
    one = [*keys, "text_id"] if broadcast else ["digest"]
    aligned = met.select(*one, "item", "start", "n", same.alias("same"))
    window = F.least(F.col("n"), F.lit(WINDOW))
    need = F.when(F.col("n") < LEAST_WORDS, F.col("n")).otherwise(F.ceil(window * SIMILARITY - 1e-9))
    total = F.aggregate("same", F.lit(0), lambda s, x: s + x)
    likely = aligned.where(total >= need).withColumn("window", window).withColumn("need", need)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("window") + 1, F.lit(1))), lambda p: F.aggregate(F.slice("same", p, F.col("window")), F.lit(0), lambda s, x: s + x)))
    # the best window of an alignment has a seed, and lies inside that seed's blocks
    found = likely.withColumn("best", best).where(F.col("best") >= F.col("need")).groupBy(*one, "item", "start").agg(F.max("best").alias("best"))
    if not broadcast:
        found = named.select(*keys, "digest").join(found, "digest")
    found = found.select(*keys, "item", "start", "best").distinct()
    out = found.join(given.select("item", F.explode("names").alias("name")), "item")
    return out.select(*[F.col(c).alias(name) for c, name in zip(keys, doc_key, strict=True)], F.col("name.item_id").alias("item_id"), "start", "best")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns, whatever these are called. Rows are matched by the digest of their text, so repeated ids don't
    mix. Short items count where all their words stand in a row, so a benchmark of single words should be filtered first."""
    digest = "digest"
    while digest in docs.columns:
        digest = f"_{digest}"
    named = docs.withColumn(digest, F.md5(F.coalesce(text_col, F.lit(""))))
    found = materialize(leaks(named.select(digest, text_col), benchmark, (digest,), text_col).select(digest).distinct(), "leaks")
    return named.join(found, digest, "left_anti").select(*quoted(docs.columns))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("best").cast("bigint").alias("best"), F.count("*").alias("n_places"))
