"""Chat formatting: a finite-state machine over roles emits text segments with loss flags from a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, the roles whose text bears loss, and the role each role may follow.

    ``\\``, ``#`` and ``<`` in texts get a backslash before them (in roles ``:`` as well), so neither mark can occur inside a
    text and ``unescape`` gives every text back.
    """

    head: str = "### {role}: "
    tail: str = " </turn>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "system": frozenset({START}),
            "user": frozenset({START, "system", "assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        return self.head.format(role=escape(role).replace(":", "\\:")), escape(text), self.tail

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn without its tail."""
        before, after = self.head.split("{role}")
        m = re.match(rf"{re.escape(before)}((?:\\.|[^\\:])*){re.escape(after)}", turn, re.DOTALL)
        if not m:
            raise ValueError(f"not a turn: {turn[:60]!r}")
        return unescape(m[1]), unescape(turn[m.end() :])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


SEGMENTS = "conv_id long, part long, segment string, loss boolean, error string"


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _write(rows: Iterator[tuple], columns: list, schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows or about 8 MB of text."""
    out: list[tuple] = []
    chars = 0
    for r in rows:
        out.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(out) >= size or chars > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), columns, strict=True)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), columns, strict=True)], schema=schema)


def format_chat(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of the formatted conversations: ``(conv_id, part, segment, loss, error)``.

    Rows are dealt by conversation and sorted by turn (ties by role, then text; null turns last), and one pass over each partition walks the
    machine. Only the current turn is held, however long a conversation is. ``part`` numbers the three segments of each
    turn (head, text, tail); ``loss`` is true for the text of loss roles; ``error`` names a turn out of order, on the head of that
    turn, or a conversation that ends on a role that isn't final, on its last tail. Nothing is dropped: conversations
    in error are formatted as well. Null text and null role count as empty; rows of a null conv_id form one conversation; an empty table gives no
    segments; other columns are ignored.
    """
    t = template or ChatTemplate()
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    schema = pa.schema(list(zip(("conv_id", "part", "segment", "loss", "error"), types, strict=True)))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current: object = ()
        state, part, last = START, 0, None
        for conv, role, text in _rows(batches, "conv_id", "role", "text"):
            if conv != current or current == ():
                if last:
                    yield (*last[:4], None if state in t.final else f"ends on {state}")
                current, state, part, last = conv, START, 0, None
            if last:
                yield last
            head, body, tail = t.turn(role, text)
            error = None if state in t.follows.get(role, ()) else f"{role or 'no role'} after {state}"
            yield (conv, part, head, False, error)
            yield (conv, part + 1, body, role in t.loss_roles, None)
            last = (conv, part + 2, tail, False, None)
            state, part = role, part + 3
        if last:
            yield (*last[:4], None if state in t.final else f"ends on {state}")

    return dealt.mapInArrow(lambda b: _write(segments(b), types, schema), SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long"


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parse formatted conversations turn by turn and digest what they hold. ``segments`` lie in order within
    partitions and conversations are whole there, as ``format_chat`` leaves them."""
    t = template or ChatTemplate()
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip((c.split()[0] for c in DIGEST.split(", ")), types, strict=True)))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current: object = ()
        n = chars = formatted = errors = 0
        turns, loss, held = hashlib.sha256(), hashlib.sha256(), ""

        def row() -> tuple:
            if held:
                raise ValueError(f"conversation {current} ends inside a turn")
            return (current, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, errors)

        for conv, segment, masked, error in _rows(batches, "conv_id", "segment", "loss", "error"):
            if conv != current or current == ():
                if current != ():
                    yield row()
                current, n, chars, formatted, errors = conv, 0, 0, 0, 0
                turns, loss, held = hashlib.sha256(), hashlib.sha256(), ""
            formatted += len(segment)
            errors += error is not None
            if masked:
                plain = unescape(segment)
                chars += len(plain)
                loss.update(plain.encode())
            held += segment
            if segment.endswith(t.tail):
                while (end := held.find(t.tail)) >= 0:
                    role, text = t.parse(held[:end])
                    turns.update(f"{role}\n{text}\n".encode())
                    n, held = n + 1, held[end + len(t.tail) :]
        if current != ():
            yield row()

    return segments.mapInArrow(lambda b: _write(digests(b), types, schema), DIGEST)


def op10_chat(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return read_back(format_chat(given.unionByName(more)))
