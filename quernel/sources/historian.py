"""A process historian behind HTTP as a Spark source and sink: ``spark.read``, ``readStream``, ``write`` and ``writeStream`` with format ``historian``.

    spark.dataSource.register(Historian)
    spark.read.format("historian").options(url=..., tags="FIC-1,FIC-2", begin="2026-01-01 00:00:00", end="2026-01-02 00:00:00").load()

Options:

========== =============================================================================================
url        address of the historian
tags       names of points, parted by commas
begin, end times ``yyyy-mm-dd hh:mm:ss``; rows of [begin, end) are read. A stream without ``end`` goes on
interval   seconds between the values that the historian is asked for, 60 by default
slice      seconds of one request, 86,400 by default: a partition is one tag in one slice
pushdown   true: conditions on tag and time narrow the requests; Spark wants ``spark.sql.python.filterPushdown.enabled`` set for it
most       seconds of time that one micro-batch covers, 86,400 by default
settle     seconds that a stream stays behind the clock, 60 by default; values that reach the historian later than that are not seen
timeout    seconds a request may take, 10 by default; retries, 3 by default, for requests that fail
batch_tag  for streams that write: a point that takes the number of the last batch written
look_back  seconds in which the value of ``batch_tag`` is looked for, 604,800 by default
========== =============================================================================================
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "tag string, time timestamp_ntz, value double"
# fixed values: paths and field names of the historian's interface
HISTORY, WRITE = "/api/tag-value/getHistoryValue", "/api/tag-value/writeTagValues"
TIME_FIELDS = ("tagTime", "time", "timestamp", "appTime", "dataTime")
TAG_FIELDS = ("tagName", "tag", "pointName", "name")
VALUE_FIELDS = ("tagValue", "value", "val")
FORMAT = "%Y-%m-%d %H:%M:%S"
SECOND = timedelta(seconds=1)


class HistorianError(RuntimeError):
    """The historian refused a request."""


@dataclass(frozen=True)
class Settings:
    url: str
    tags: tuple[str, ...]
    begin: datetime | None
    end: datetime | None
    interval: int
    slice: int
    most: int
    settle: int
    timeout: float
    retries: int
    batch_tag: str | None
    look_back: int

    @classmethod
    def of(cls, options: dict[str, str]) -> Settings:
        def moment(name: str) -> datetime | None:
            return datetime.fromisoformat(options[name]).replace(microsecond=0) if options.get(name) else None

        if not options.get("url"):
            raise ValueError("option url is missing")
        number = lambda name, default: int(options.get(name, default))
        tags = tuple(dict.fromkeys(t.strip() for t in options.get("tags", "").split(",") if t.strip()))
        return cls(
            options["url"].rstrip("/"), tags, moment("begin"), moment("end"), number("interval", 60), number("slice", 86_400), number("most", 86_400), number("settle", 60),
            float(options.get("timeout", 10)), number("retries", 3), options.get("batch_tag"), number("look_back", 604_800),
        )


def _post(settings: Settings, path: str, body: dict) -> dict:
    """The answer to a request. Failures of the network and of the server (5xx) are tried again, after 0.2, 0.4, 0.8 ... seconds; refusals are not."""
    request = urllib.request.Request(settings.url + path, json.dumps(body, allow_nan=False).encode(), {"Content-Type": "application/json"})
    for trial in range(settings.retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=settings.timeout) as answer:
                held = answer.read()
                return json.loads(held) if held else {}
        except urllib.error.HTTPError as e:
            if e.code < 500 or trial == settings.retries:
                raise HistorianError(f"{path}: {e.code} {e.read()[:200]!r}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if trial == settings.retries:
                raise HistorianError(f"{path}: {e}") from None
        time.sleep(0.2 * 2**trial)
    raise AssertionError


def _first(record: dict, names: Sequence[str]) -> object:
    return next((record[n] for n in names if n in record), None)


def _number(value: object) -> float | None:
    """The value as a finite number, else null."""
    try:
        x = float(str(value).strip())
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def _moment(value: object) -> datetime | None:
    try:
        return datetime.fromisoformat(str(value).strip()).replace(tzinfo=None)
    except ValueError:
        return None


def history(settings: Settings, tags: Sequence[str], begin: datetime, end: datetime) -> Iterator[tuple[str, datetime, float | None]]:
    """``(tag, time, value)`` of the tags in [begin, end). The historian's own ranges hold both ends, in seconds. Records without a time or tag that can be read, and records outside the
    range or of other tags, are left out; values that are no finite number are null."""
    if begin >= end or not tags:
        return
    data = {"begTime": begin.strftime(FORMAT), "endTime": (end - SECOND).strftime(FORMAT), "interval": settings.interval, "isSecond": True, "option": 0, "tagNames": list(tags)}
    answer = _post(settings, HISTORY, {"data": data, "requestBase": {"page": "0-0", "sort": "-appTime"}})
    if not answer.get("isSuccess"):
        raise HistorianError(f"{HISTORY}: {str(answer)[:200]}")
    for record in (answer.get("content") or {}).get("records") or []:
        tag, at = _first(record, TAG_FIELDS), _moment(_first(record, TIME_FIELDS))
        if tag is not None and (tag := str(tag).strip()) in tags and at is not None and begin <= at < end:
            yield tag, at, _number(_first(record, VALUE_FIELDS))


@dataclass
class Slice(InputPartition):
    """One tag in one range of time."""

    tag: str
    begin: datetime
    end: datetime


def slices(tags: Sequence[str], begin: datetime, end: datetime, seconds: int) -> list[Slice]:
    """Ranges start at multiples of ``seconds`` after ``begin``, so the same times always make the same partitions."""
    cuts, at = [], begin
    while at < end:
        cuts.append((at, min(end, at + timedelta(seconds=seconds))))
        at = cuts[-1][1]
    return [Slice(tag, a, b) for tag in tags for a, b in cuts]


class HistorianReader(DataSourceReader):
    def __init__(self, settings: Settings) -> None:
        if not settings.tags or settings.begin is None or settings.end is None:
            raise ValueError("options tags, begin and end are needed")
        self.settings, self.tags, self.begin, self.end = settings, settings.tags, settings.begin, settings.end

    def partitions(self) -> list[InputPartition]:
        return slices(self.tags, self.begin, self.end, self.settings.slice)

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        return iter(()) if partition is None else history(self.settings, [partition.tag], partition.begin, partition.end)  # none: Spark's word for no partitions


class NarrowedReader(HistorianReader):
    """Conditions on ``tag`` and ``time`` narrow the requests."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("tag",) and isinstance(f, EqualTo | In):
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.tags = tuple(t for t in self.tags if t in wanted)
            elif column == ("time",) and isinstance(value, datetime) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                # whole seconds that hold the bound, which Spark then tests exactly
                floor = value.replace(microsecond=0, tzinfo=None)
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.begin = max(self.begin, floor)
                else:
                    self.end = min(self.end, floor + SECOND)
                yield f
            else:
                yield f


class HistorianStreamReader(DataSourceStreamReader):
    """Offsets are times: a batch holds [start, end). A batch that is run again asks for the same range, so it holds the same rows unless the historian changed its past."""

    def __init__(self, settings: Settings) -> None:
        if not settings.tags or settings.begin is None:
            raise ValueError("options tags and begin are needed")
        self.settings, self.at = settings, settings.begin

    def initialOffset(self) -> dict:
        return {"time": self.settings.begin.strftime(FORMAT)}

    def latestOffset(self) -> dict:
        now = (datetime.now() - timedelta(seconds=self.settings.settle)).replace(microsecond=0)
        latest = min(now, self.settings.end or now, self.at + timedelta(seconds=self.settings.most))
        return {"time": max(latest, self.at).strftime(FORMAT)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = (datetime.strptime(x["time"], FORMAT) for x in (start, end))
        self.at = max(self.at, b)
        return slices(self.settings.tags, a, b, self.settings.slice)

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        return iter(()) if partition is None else history(self.settings, [partition.tag], partition.begin, partition.end)  # none: Spark's word for no partitions

    def commit(self, end: dict) -> None:
        self.at = max(self.at, datetime.strptime(end["time"], FORMAT))


@dataclass
class LastValues(WriterCommitMessage):
    """The last value of each tag in one task: a number a tag, however many rows the task has."""

    values: dict[str, tuple[datetime, float]]


def last_values(rows: Iterator[Row]) -> LastValues:
    """Rows have tag, time and value. Nulls, NaN and infinite values are left out; of values of one time the largest is taken, in whatever order rows come."""
    held: dict[str, tuple[datetime, float]] = {}
    for r in rows:
        value = None if r["value"] is None else _number(r["value"])
        if r["tag"] is not None and r["time"] is not None and value is not None:
            held[r["tag"]] = max(held.get(r["tag"], (r["time"], value)), (r["time"], value))
    return LastValues(held)


def _merged(messages: Iterable[LastValues | None]) -> dict[str, float]:
    held: dict[str, tuple[datetime, float]] = {}
    for m in messages:
        for tag, value in (m.values if m else {}).items():
            held[tag] = max(held.get(tag, value), value)
    return {tag: value for tag, (_, value) in sorted(held.items())}


def write_values(settings: Settings, values: dict[str, float]) -> None:
    """One request for all tags, so they change together or not at all."""
    if values:
        _post(settings, WRITE, {"data": {"values": values}, "requestBase": {"page": "1-10", "sort": "-createTime"}})


class HistorianWriter(DataSourceWriter):
    """Writes the last value of each tag, once all tasks are done."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def write(self, iterator: Iterator[Row]) -> LastValues:
        return last_values(iterator)

    def commit(self, messages: list[LastValues | None]) -> None:
        write_values(self.settings, _merged(messages))

    def abort(self, messages: list[LastValues | None]) -> None:
        """Nothing has been sent before the commit."""


class HistorianStreamWriter(DataSourceStreamWriter):
    """Writes the last values of each batch once. The number of the batch goes along in the same request, as the value of ``batch_tag``; a batch whose number the historian holds already, because
    the query ended between the request and its own log, is not sent again. So each query needs a ``batch_tag`` of its own, and a new one if its checkpoint is thrown away."""

    def __init__(self, settings: Settings) -> None:
        if not settings.batch_tag:
            raise ValueError("option batch_tag is needed to write streams")
        self.settings = settings

    def write(self, iterator: Iterator[Row]) -> LastValues:
        return last_values(iterator)

    def last_batch(self) -> int:
        now = datetime.now()
        held = history(self.settings, [self.settings.batch_tag], now - timedelta(seconds=self.settings.look_back), now + timedelta(days=1))
        return max((int(v) for _, _, v in held if v is not None), default=-1)

    def commit(self, messages: list[LastValues | None], batchId: int) -> None:
        values = _merged(messages)
        if values and batchId > self.last_batch():
            write_values(self.settings, {**values, self.settings.batch_tag: float(batchId)})

    def abort(self, messages: list[LastValues | None], batchId: int) -> None:
        """Nothing has been sent before the commit."""


class Historian(DataSource):
    @classmethod
    def name(cls) -> str:
        return "historian"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HistorianReader:
        narrowed = self.options.get("pushdown", "false").lower() == "true"
        return (NarrowedReader if narrowed else HistorianReader)(Settings.of(self.options))

    def streamReader(self, schema: StructType) -> HistorianStreamReader:
        return HistorianStreamReader(Settings.of(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> HistorianWriter:
        return HistorianWriter(Settings.of(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> HistorianStreamWriter:
        return HistorianStreamWriter(Settings.of(self.options))
