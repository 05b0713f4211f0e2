"""Token ids of documents in ORC files: ascending document ids, integer run lengths, row indexes and Bloom filters."""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.batches import slices
from quernel.llm.scratch import new_path

#: A piece begins before every space that a character other than white space follows. The vocabulary's own splitting
#: never joins characters across such a place, so pieces can be encoded one by one and their ids be kept.
PIECES = re.compile(r"(?= \S)")
SPACE = re.compile(r"[\s\x03]")
#: Texts without this are cut at every space.
SPACES = re.compile(r" \s")
#: Begins the key of a piece without a leading space; ends a text; stands for a space inside a piece. Texts that hold one of these characters aren't cut.
BARE, END, GAP = "\x01", "\x02", "\x03"
#: Where a comma or full stop after a Latin letter is a piece of its own: before a space or a line of text. The vocabulary's splitting parts it on both sides; so words with and without it are one piece.
MARKS = ((re.compile(r",(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f],)(?= \S)"), f" {BARE},"), (re.compile(r"\.(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]\.)(?= \S)"), f" {BARE}."),
         (re.compile(r"\.\n(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]\.\n)(?=\S)"), f" {BARE}.\n {BARE}"))
#: Letters that a vocabulary of bytes never splits between.
LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and (c.isascii() or c >= "\u00c0"))
WORD = re.compile(f"[{LATIN}]+")
#: The byte 255, which UTF-8 never has, as vocabularies of bytes write it.
NO_TEXT = "\u00ff"
#: Pieces whose ids a worker keeps; when it has more, the most used half stays. Results don't depend on it.
KEPT_PIECES = 600_000
#: What a vocabulary's model may set besides its words and merges.
MODEL_OPTIONS = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
ORC_OPTIONS = {
    "orc.compress": "zstd", "orc.compression.zstd.level": "1", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


class PieceEncoder(dict):
    """Ids of texts by the tokenizers library, each distinct piece encoded once. Maps a piece without its leading space to its number."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # the model's own cache of words only costs time here, where no piece is encoded twice
        options = {k: model[k] for k in MODEL_OPTIONS if model.get(k) is not None}
        self.tokenizer.model = BPE(vocab=model["vocab"], merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], cache_capacity=0, **options)
        self.uncut = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), BARE, END, GAP]
        self.words = None  # encodes words that are written in the vocabulary's own characters, so the library needn't split and map them one by one
        byte_level = (spec.get("pre_tokenizer") or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        if byte_level and not spec.get("normalizer") and not model.get("dropout") and [t for t in model["vocab"] if NO_TEXT in t] == [NO_TEXT]:
            self.words, self.word_end = Tokenizer(self.tokenizer.model), model["vocab"][NO_TEXT]
            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.characters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in f" {LATIN}"} | {ord("\n"): NO_TEXT}
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self[END] = 0
        self.pieces = [END]  # by number
        self.used = 1
        self.starts, self.lengths, self.counts = (np.full(1 << 16, x, np.int32) for x in (0, 1, 0))
        self.flat = np.zeros(1 << 18, np.int32)

    def _shrink(self) -> None:
        most = np.sort(np.argsort(-self.counts[1 : len(self.pieces)], kind="stable")[: KEPT_PIECES // 2] + 1)
        sizes, flat = self.lengths[most], self._gather(most)
        pieces = [self.pieces[i] for i in most.tolist()]
        self._reset()
        self._add(pieces, flat, sizes)

    def _add(self, pieces: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, end = len(self.pieces), len(self.pieces) + len(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end > len(self.starts):
            self.starts, self.lengths, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.counts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at:end] = self.used + np.cumsum(sizes) - sizes
        self.lengths[at:end] = sizes
        self.used += len(ids)
        self.pieces += pieces
        self.update(zip(pieces, range(at, end), strict=True))

    @staticmethod
    def cut(text: str) -> str:
        """The keys of a text's pieces, parted by spaces: a piece without its leading space, or BARE and a piece that has none."""
        if not text or text[0] == " " or text[-1] == " " or SPACES.search(text):  # by the rule itself
            return " ".join([(p[1:] if p[:1] == " " and len(p) > 1 and not p[1].isspace() else BARE + p).replace(" ", GAP) for p in PIECES.split(text)]) if text else ""
        for mark, apart in MARKS:
            text = mark.sub(apart, text)
        return BARE + text

    @staticmethod
    def split(text: str) -> list[str]:
        return PieceEncoder.cut(text).split(" ") if text else []

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces. Letters, and letters before punctuation, where the vocabulary splits, are encoded apart, so that they share their ids."""
        alpha = list(map(str.isalpha, new))
        plain, bare, rest, parts = list(compress(new, alpha)), [], [], {}
        for p in compress(new, map(not_, alpha)):
            head = p.rstrip(string.punctuation)
            if p[0] == BARE:
                (bare if p[1:].isalpha() else rest).append(p)
            elif len(head) < len(p) and head.isalpha():
                parts[p] = (head, BARE + p[len(head) :])
            elif SPACE.search(p):
                rest.append(p)
            else:
                plain.append(p)
        self._encode_lines(plain)
        self._encode_lines(bare, bare=True)
        self._encode_each(rest)
        if parts:
            lacking = [x for x in dict.fromkeys(chain.from_iterable(parts.values())) if x not in self]
            self._encode_lines([x for x in lacking if x[0] != BARE])
            self._encode_each([x for x in lacking if x[0] == BARE])
            two = np.fromiter(map(self.__getitem__, chain.from_iterable(parts.values())), np.int32, 2 * len(parts))
            self._add(list(parts), self._gather(two), self.lengths[two].reshape(-1, 2).sum(1))

    def _encode_lines(self, pieces: list[str], bare: bool = False) -> None:
        """Pieces without white space, all with or all without a leading space, as the lines of one text, whose ids the line ends part; words go a shorter way."""
        if self.words:
            word = [WORD.fullmatch(p, int(bare)) is not None for p in pieces]
            self._encode_words(list(compress(pieces, word)), bare)
            pieces = list(compress(pieces, map(not_, word)))
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            text = "\n".join(some).replace(BARE, "") if bare else " " + "\n ".join(some)
            self._add(some, *self._parted(self.tokenizer.encode_batch_fast([text + "\n"], add_special_tokens=False)[0].ids, self.line_end, len(some)))

    def _encode_words(self, pieces: list[str], bare: bool) -> None:
        """As strings of words that a byte parts which no text holds and no other piece of the vocabulary, so no merge goes over it."""
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            lines = [some[i : i + 64] for i in range(0, len(some), 64)]
            texts = ["\n".join([*x, ""]).replace(BARE, "") if bare else " " + "\n ".join(x) + "\n" for x in lines]
            ids = [e.ids for e in self.words.encode_batch_fast([t.translate(self.characters) for t in texts], add_special_tokens=False)]
            self._add(some, *self._parted(list(chain.from_iterable(ids)), self.word_end, len(some)))

    @staticmethod
    def _parted(ids: list[int], end: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids without the ``n`` ends, and how many stand before each."""
        ids = np.array(ids, np.int32)
        ends = np.flatnonzero(ids == end)
        if len(ends) != n:
            raise ValueError("the vocabulary joins ends of pieces with other text")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _encode_each(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([(p[1:] if p[0] == BARE else f" {p}").replace(GAP, " ") for p in some], add_special_tokens=False)]
            self._add(some, np.array([x for y in ids for x in y], np.int32), np.array([len(y) for y in ids], np.int64))

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the numbered pieces, one after the other."""
        sizes = self.lengths[numbers]
        ends = np.cumsum(sizes)
        source = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        source += np.repeat(self.starts[numbers] - (ends - sizes).astype(np.int32), sizes)
        return self.flat[source]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end_id`` after each, and the number of ids of each. Texts that hold an added token of the vocabulary
        aren't cut: what such a token does to the characters around it is the library's business. The keys of all pieces are one buffer, in which Arrow finds the distinct ones."""
        if len(self.pieces) > KEPT_PIECES:
            self._shrink()
        if whole := {i for i, t in enumerate(texts) if any(a in t for a in self.uncut)}:
            ids = [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end_id], np.int32) if i in whole else None for i, t in enumerate(texts)]
            plain = [t for i, t in enumerate(texts) if i not in whole]
            rest, n = self.encode(plain, end_id) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            cut = iter(np.split(rest, np.cumsum(n)[:-1]))
            ids = [next(cut) if x is None else x for x in ids]
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        keys = " ".join([f"{self.cut(t)} {END}" if t else END for t in texts] + [""]).encode()
        ends = np.flatnonzero(np.frombuffer(keys, np.uint8) == 32) + 1
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(keys)]).dictionary_encode()
        distinct = found.dictionary.buffers()[2].to_pybytes().decode().split(" ")[: len(found.dictionary)]
        own = np.fromiter(map(self.get, distinct, repeat(-1)), np.int32, len(distinct))
        if len(at := np.flatnonzero(own < 0)):
            unknown = [distinct[i] for i in at.tolist()]
            self._learn(unknown)
            own[at] = np.fromiter(map(self.__getitem__, unknown), np.int32, len(unknown))
        numbers = own[found.indices.to_numpy()]
        self.flat[0] = end_id
        used = np.bincount(numbers, minlength=len(self.pieces))
        self.counts[: len(used)] += used.astype(np.int32)
        return self._gather(numbers), np.diff(np.cumsum(self.lengths[numbers], dtype=np.int64)[numbers == 0], prepend=0)


def worker_encoder(vocabulary: str) -> PieceEncoder:
    """The encoder of this Python worker, kept on an imported module from task to task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_quernel_encoders", {})
    if vocabulary not in kept:
        kept[vocabulary] = PieceEncoder(vocabulary)
    return kept[vocabulary]


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every whole text, in the order and partitions of ``docs``; null text counts as empty and gives the end id alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = encoder.encode([t or "" for t in part.column("text").to_pylist()], end_id)
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``(doc_id, n_tokens, ids)`` as ORC files in ascending doc_id: ranges of ids go to files, rows are sorted
    within each (null ids first, equal ids by text); rows of one id, or of none, share a file and so one task, which streams them. Readers skip files, stripes and row groups by the
    ranges and Bloom filters of doc_id. An empty table gives files without rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    tokenize(ranged, vocabulary, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def digest_tokens(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the files' rows. Files are put in order by their least id, the
    tokens of earlier files are summed from the n_tokens column alone, and rows are summed within their file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("row", pa.int64())])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64()), b.column("file"), b.column("row")], schema=schema)

    place = [F.col("_metadata.file_path").alias("file")]
    read = read_tokens(spark, path)
    files = read.select("doc_id", "n_tokens", *place).groupBy("file").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("file_start"))
    rows = read.select("doc_id", "ids", *place, F.monotonically_increasing_id().alias("row")).mapInArrow(crc, "doc_id long, n_tokens long, ids_crc32 long, file string, row long")
    inner = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("file_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-ids")
    write_tokens(docs, path, vocabulary_path(), end_id=0)
    return digest_tokens(spark, path)
