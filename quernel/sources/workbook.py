"""Workbooks (.xlsx) without a library: sheets are streamed out of the zip file as XML, one task a sheet, and come as rows of cells.

    rows = sheets(spark, "folder/*.xlsx")          # path, sheet, position, row, cells
    wide_values(rows, "name of a column")          # time, value of sheets with a header
    long_values(rows, tags)                        # tag, time, value of sheets of three columns
    discover_sheets(rows, tags)                    # which tag is where
    score_sheets(rows, ...), sheet_bounds(...)     # the sheet that holds the points' bounds
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.scalars import normalise_tag, num, ordered_bounds, timestamp
from quernel.sources.tables import pick_column

SCHEMA = "path string, sheet string, position int, row long, cells array<string>"
#: Rows of a long sheet in which tags are looked for.
DISCOVERED_ROWS = 5000
# Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
BATCH = 2000


# --- the file -----------------------------------------------------------------------------------------------------------------


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _plain(k) == name), None)


def _text(element: ElementTree.Element) -> str:
    """The text of an item, its runs joined, phonetic hints left out."""
    out = []
    for part in element:
        if _plain(part.tag) == "t":
            out.append(part.text or "")
        elif _plain(part.tag) == "r":
            out += [t.text or "" for t in part if _plain(t.tag) == "t"]
    return "".join(out)


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(name, part of the zip file)`` of each sheet, in the order of the workbook."""
    targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    root = ElementTree.parse(book.open("xl/workbook.xml")).getroot()
    out = []
    for s in root.iter():
        if _plain(s.tag) == "sheet":
            rel = next(v for k, v in s.attrib.items() if k.endswith("}id"))
            target = targets[rel]
            out.append((s.attrib["name"], target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(e) for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")) if _plain(e.tag) == "si"]


def shows_date(code: str) -> bool:
    """Whether a number format has a day, month, year, hour or second outside quotes and brackets."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\[[^\]]*\]', "", code), re.IGNORECASE)) and "general" not in code.lower()


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    own = {int(e.attrib["numFmtId"]): shows_date(e.attrib.get("formatCode", "")) for e in root.iter() if _plain(e.tag) == "numFmt"}
    styles = next((e for e in root if _plain(e.tag) == "cellXfs"), [])
    return {i for i, e in enumerate(styles) if (f := int(e.attrib.get("numFmtId", 0))) in DATE_FORMATS or own.get(f, False)}


def serial_time(serial: float, from_1904: bool = False) -> str:
    """A date's number as text. Numbers below 60 lie before the day that 1900 did not have."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31 if serial < 60 else 30)
    at = start + timedelta(milliseconds=round(serial * 86_400_000))
    return at.isoformat(sep=" ", timespec="milliseconds" if at.microsecond else "seconds")


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """``(row number from 1, cells)`` of the rows that have cells, parsed as they are read: only one row is held, besides the workbook's shared strings. Dates are ``yyyy-mm-dd hh:mm:ss``, numbers as they
    are written, errors null."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strings, dates = _shared_strings(book), _date_styles(book)
    properties = next((e for e in ElementTree.parse(book.open("xl/workbook.xml")).getroot() if _plain(e.tag) == "workbookPr"), None)
    from_1904 = properties is not None and properties.attrib.get("date1904") in ("1", "true")
    number, parents = 0, []
    for event, e in ElementTree.iterparse(book.open(part), events=("start", "end")):
        if event == "start":
            parents.append(e)
            continue
        parents.pop()
        if _plain(e.tag) != "row":
            continue
        number = int(e.attrib.get("r", number + 1))
        cells: list[str | None] = []
        for c in e:
            at = column_number(c.attrib["r"]) if "r" in c.attrib else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, value = c.attrib.get("t", "n"), next((x.text for x in c if _plain(x.tag) == "v"), None)
            if kind == "inlineStr":
                cells[at] = next((_text(x) for x in c if _plain(x.tag) == "is"), None)
            elif value is None or kind == "e":
                continue
            elif kind == "s":
                cells[at] = strings[int(value)]
            elif kind == "n" and int(c.attrib.get("s", 0)) in dates:
                cells[at] = serial_time(float(value), from_1904)
            else:
                cells[at] = value
        if any(x is not None for x in cells):
            yield number, cells
        parents[-1].clear()  # rows that are done


def sheets(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of all sheets of the workbooks that ``path`` names (any path that Spark reads; lock files ``~$...`` are left out). A task opens a workbook for its names only, then there is one a sheet."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths).where(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content")

    def names(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, i, name, inside) for p, content in zip(part["path"], part["content"], strict=True) for i, (name, inside) in enumerate(sheet_parts(zipfile.ZipFile(io.BytesIO(content))))]
            yield pd.DataFrame(rows, columns=["path", "position", "sheet", "part"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content, position, sheet, inside in part[["path", "content", "position", "sheet", "part"]].itertuples(index=False):
                held = []
                for row, cells in sheet_rows(content, inside):
                    held.append((p, sheet, position, row, cells))
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=["path", "sheet", "position", "row", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "sheet", "position", "row", "cells"])

    found = files.mapInPandas(names, "path string, position int, sheet string, part string")
    return files.join(found, "path").repartition(F.col("path"), F.col("position")).mapInPandas(read, SCHEMA)


# --- tables in sheets -----------------------------------------------------------------------------------------------------------


def headers(rows: DataFrame) -> DataFrame:
    """``(path, sheet, position, header_row, header)``: the first row with cells of each sheet."""
    return rows.groupBy("path", "sheet", "position").agg(F.min("row").alias("header_row"), F.min_by("cells", "row").alias("header"))


def body(rows: DataFrame) -> DataFrame:
    """Rows below the header, with the header."""
    return rows.join(headers(rows).select("path", "position", "header_row", "header"), ["path", "position"]).where(F.col("row") > F.col("header_row"))


def _cell(name: Column | str) -> Column:
    """The cell of the first column of that name; null if there is none."""
    at = F.array_position("header", F.lit(name) if isinstance(name, str) else name)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def wide_values(rows: DataFrame, column: str, time: str = "time") -> DataFrame:
    """``(path, sheet, time, value)`` of the sheets that have both columns; rows without a time go."""
    own = body(rows).where(F.array_contains("header", time) & F.array_contains("header", column))
    return own.select("path", "sheet", timestamp(_cell(time)).alias("time"), num(_cell(column)).alias("value")).where("time is not null")


def long_values(rows: DataFrame, tags: Sequence[str] | None = None, drop_prefix: str | None = "B4_") -> DataFrame:
    """``(path, sheet, tag, time, value)`` by place: the first three columns of sheets whose header has three or more. Tags are normalised; rows without a time go."""
    cell = lambda i: F.get("cells", F.lit(i))
    own = body(rows).where(F.size("header") >= 3).select("path", "sheet", normalise_tag(cell(0), drop_prefix).alias("tag"), timestamp(cell(1)).alias("time"), num(cell(2)).alias("value"))
    own = own.where("time is not null")
    return own if tags is None else own.where(F.col("tag").isin(*tags))


def discover_sheets(rows: DataFrame, tags: Sequence[str], drop_prefix: str | None = "B4_", first: int = DISCOVERED_ROWS) -> DataFrame:
    """``(tag, kind, path, sheet, column)`` of the wanted (normalised) tags: ``xlsx_wide`` where a column is called so, ``xlsx_long`` where the first column of one of the first rows says so. For
    ``tables.pick_sources``."""
    named = headers(rows).select("path", "sheet", F.explode("header").alias("column")).where("column is not null")
    wide = named.select(normalise_tag(F.col("column"), drop_prefix).alias("tag"), F.lit("xlsx_wide").alias("kind"), "path", "sheet", "column")
    w = Window.partitionBy("path", "position").orderBy("row")
    early = body(rows).where((F.size("header") >= 3)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= first)
    long = early.select(normalise_tag(F.get("cells", F.lit(0)), drop_prefix).alias("tag"), F.lit("xlsx_long").alias("kind"), "path", "sheet", F.lit(None).cast("string").alias("column")).distinct()
    return wide.unionByName(long).where(F.col("tag").isin(*tags))


def score_sheets(rows: DataFrame, tags: Sequence[str], candidates: Mapping[str, Sequence[str]], drop_prefix: str | None = None) -> DataFrame:
    """``(path, sheet, position, rows, matched, score, selected, columns)``: ten points for each row whose tag is wanted, and one for each of the columns low, high and variable that is found.
    ``candidates`` names columns for tag, low, high, variable, unit. The best sheet with rows of each workbook is selected, the first of equals."""
    every = headers(rows).collect()  # a row a sheet
    found = [(r["path"], r["position"], {k: pick_column([c for c in r["header"] if c is not None], names) for k, names in candidates.items()}) for r in every]
    if not found:
        return rows.select("path", "sheet", "position").where("false").selectExpr("*", "0L as rows", "0L as matched", "0L as score", "false as selected", "map('', '') as columns")
    columns = rows.sparkSession.createDataFrame(found, "path string, position int, columns map<string,string>")
    held = body(rows).join(F.broadcast(columns), ["path", "position"])  # a row a sheet
    hit = normalise_tag(_cell(F.col("columns")["tag"]), drop_prefix).isin(*tags)
    scored = held.groupBy("path", "position").agg(F.count("*").alias("rows"), F.count(F.when(hit, 1)).alias("matched"))
    out = headers(rows).select("path", "sheet", "position").join(F.broadcast(columns), ["path", "position"]).join(scored, ["path", "position"], "left").fillna(0, ["rows", "matched"])
    bonus = sum((F.col("columns")[k].isNotNull().cast("int") for k in ("low", "high", "variable") if k in candidates), F.lit(0))
    out = out.withColumn("score", F.when(F.col("rows") > 0, 10 * F.col("matched") + bonus).otherwise(0).cast("long"))
    w = Window.partitionBy("path").orderBy(F.desc(F.col("rows") > 0), F.desc("score"), "position")
    return out.withColumn("selected", (F.row_number().over(w) == 1) & (F.col("rows") > 0)).select("path", "sheet", "position", "rows", "matched", "score", "selected", "columns")


def sheet_bounds(rows: DataFrame, scores: DataFrame, tags: Sequence[str], drop_prefix: str | None = None) -> DataFrame:
    """``(path, tag, variable, unit, lower, upper, swapped, found)`` for each wanted tag, from the selected sheet of each workbook; of several rows of a tag the last. Bounds in the wrong order are swapped;
    one alone stays."""
    chosen = scores.where("selected").select("path", "position", "columns")
    own = body(rows).join(F.broadcast(chosen), ["path", "position"])  # a row a workbook
    cell = lambda k: _cell(F.col("columns")[k])
    own = own.select("path", "row", normalise_tag(cell("tag"), drop_prefix).alias("tag"), cell("variable").alias("variable"), cell("unit").alias("unit"), num(cell("low")).alias("low"), num(cell("high")).alias("high"))
    last = own.where(F.col("tag").isin(*tags)).groupBy("path", "tag").agg(F.max_by(F.struct("variable", "unit", "low", "high"), "row").alias("r")).select("path", "tag", "r.*")
    wanted = chosen.select("path", F.explode(F.array(*map(F.lit, tags))).alias("tag"))
    a, b = ordered_bounds(F.col("low"), F.col("high"))
    swapped = F.coalesce(F.col("low") > F.col("high"), F.lit(False))
    out = wanted.join(last, ["path", "tag"], "left")
    return out.select("path", "tag", "variable", "unit", F.coalesce(a, "low").alias("lower"), F.coalesce(b, "high").alias("upper"), swapped.alias("swapped"), (F.col("low").isNotNull() | F.col("high").isNotNull()).alias("found"))
