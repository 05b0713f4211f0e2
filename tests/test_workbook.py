"""Workbooks written by hand into zip files, read back as rows, values, places of tags and bounds."""

import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest
from quernel.sources import tables
from quernel.sources import workbook as W

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_book(path, sheets, strings=(), styles=None, properties="", refs=True):
    """``sheets``: name -> rows of cells, each None, a number, text, or a ready element."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS} {REL}>{properties}<sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(strings)}</sst>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        for i, rows in enumerate(sheets.values(), 1):
            out = []
            for number, cells in enumerate(rows, 1):
                made = []
                for j, v in enumerate(cells):
                    at = f' r="{letters(j)}{number}"' if refs else ""
                    if v is None and refs:
                        continue
                    if v is None:
                        made.append("<c/>")
                    elif isinstance(v, str) and v.startswith("<c"):
                        made.append(v.replace("<c", f"<c{at}", 1))
                    elif isinstance(v, str):
                        made.append(f'<c{at} t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                    else:
                        made.append(f"<c{at}><v>{v}</v></c>")
                out.append(f'<row r="{number}">{"".join(made)}</row>' if refs else f"<row>{''.join(made)}</row>")
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{''.join(out)}</sheetData></worksheet>")


STYLES = f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'


def test_kinds_of_cells(spark, tmp_path):
    cells = ["<c t=\"s\"><v>0</v></c>", "<c t=\"s\"><v>1</v></c>", "<c s=\"1\"><v>46023.5</v></c>", "<c s=\"2\"><v>46023</v></c>", "<c s=\"3\"><v>2.5</v></c>", None, "<c t=\"b\"><v>1</v></c>", "<c t=\"e\"><v>#DIV/0!</v></c>", "<c t=\"str\"><v>sum</v></c>", 1.5, "a & b"]
    write_book(tmp_path / "a.xlsx", {"one": [cells, [], [None, None, 7]], "empty": []}, ["<si><t>plain</t></si>", "<si><r><t>in </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si>"], STYLES)
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    got = W.sheets(spark, str(tmp_path / "*.xlsx")).orderBy("row").collect()
    assert [(r["sheet"], r["position"], r["row"]) for r in got] == [("one", 0, 1), ("one", 0, 3)]
    assert list(got[0]["cells"]) == ["plain", "in runs", "2026-01-01 12:00:00", "2026-01-01 00:00:00", "2.5", None, "1", None, "sum", "1.5", "a & b"]
    assert list(got[1]["cells"]) == [None, None, "7"]


def test_serial_times_and_columns():
    assert [W.serial_time(x) for x in (1, 59, 61, 46023.000011574)] == ["1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "2026-01-01 00:00:01"]
    assert W.serial_time(44561, from_1904=True) == "2026-01-01 00:00:00"
    assert [W.column_number(r) for r in ("A1", "Z9", "AA10", "BC3")] == [0, 25, 26, 54]
    assert [W.shows_date(c) for c in ("General", "0.00", '0 "days"', "[Red]0", "m/d/yy", "[h]:mm", "yyyy")] == [False, False, False, False, True, True, True]


def test_cells_and_rows_without_places(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"s": [["x", None, "y"], [1, 2, 3]]}, refs=False, properties='<workbookPr date1904="1"/>', styles=STYLES)
    assert [(r["row"], list(r["cells"])) for r in W.sheets(spark, str(tmp_path)).orderBy("row").collect()] == [(1, ["x", None, "y"]), (2, ["1", "2", "3"])]


@pytest.fixture
def folder(spark, tmp_path):
    wide = [["time", "B4-TI/1", "other", "FI.2"], ["2026-01-01 00:00:00", 1.5, "x", 7], ["2026-01-01 00:01:00", "bad", None, 8], ["never", 3, None, 9], [None, 4, None, 10]]
    long = [["tag", "when", "value", "quality"], *[[("TI 1" if i % 2 else "P-9"), f"2026-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00", i, "ok"] for i in range(6000)], ["LATE", "2026-01-02 00:00:00", 1, "ok"]]
    write_book(tmp_path / "a.xlsx", {"wide": wide, "narrow": [["FI 2", "v"], [1, 2]]})
    write_book(tmp_path / "b.xlsx", {"long": long})
    return tmp_path


def test_values_of_wide_and_long_sheets(spark, folder):
    rows = W.sheets(spark, str(folder))
    got = W.wide_values(rows, "B4-TI/1").orderBy("time").collect()
    assert [(r["sheet"], r["time"], r["value"]) for r in got] == [("wide", datetime(2026, 1, 1), 1.5), ("wide", datetime(2026, 1, 1, 0, 1), None)]
    assert W.wide_values(rows, "FI 2").count() == 0  # its sheet has no times
    long = W.long_values(rows.where("sheet = 'long'"), ["TI_1"])
    assert long.count() == 3000 and {r["value"] % 2 for r in long.collect()} == {1.0}


def test_tags_are_found_in_headers_and_early_rows(spark, folder):
    rows = W.sheets(spark, str(folder))
    found = W.discover_sheets(rows, ["TI_1", "FI_2", "P_9", "LATE", "X"])
    name = lambda p: p.rsplit("/", 1)[-1]
    assert {(r["tag"], r["kind"], name(r["path"]), r["sheet"], r["column"]) for r in found.collect()} == {
        ("TI_1", "xlsx_wide", "a.xlsx", "wide", "B4-TI/1"), ("FI_2", "xlsx_wide", "a.xlsx", "wide", "FI.2"), ("FI_2", "xlsx_wide", "a.xlsx", "narrow", "FI 2"), ("TI_1", "xlsx_long", "b.xlsx", "long", None), ("P_9", "xlsx_long", "b.xlsx", "long", None),
    }
    assert W.discover_sheets(rows, ["LATE"], first=10_000).count() == 1
    picked = tables.pick_sources(found.select("tag", "kind", "path"))
    assert {(r["tag"], r["kind"]) for r in picked.collect()} == {("TI_1", "xlsx_wide"), ("FI_2", "xlsx_wide"), ("P_9", "xlsx_long")}


CANDIDATES = {"tag": ["tag", "point"], "low": ["low", "lower bound"], "high": ["high", "upper bound"], "variable": ["variable"], "unit": ["unit"]}


def test_the_sheet_of_bounds_is_scored_and_read(spark, tmp_path):
    good = [["Variable", "Point Name", "Lower Bound", "Upper Bound", "Unit"], ["temp", "TI-1", 5, 1, "C"], ["flow", "FI-2", "x", 9, None], ["old", "P-9", 1, 2, "bar"], ["new", "P-9", 3, 4, "bar"], ["no", "Z-1", 0, 1, "m"]]
    write_book(tmp_path / "p.xlsx", {"notes": [["text"], ["TI-1"]], "empty": [["tag", "low", "high", "variable"]], "bounds": good, "copy": good})
    rows = W.sheets(spark, str(tmp_path))
    tags = ["TI_1", "FI_2", "P_9", "LOST"]
    scores = W.score_sheets(rows, tags, CANDIDATES)
    assert {(r["sheet"], r["rows"], r["matched"], r["score"], r["selected"]) for r in scores.collect()} == {("notes", 1, 0, 0, False), ("empty", 0, 0, 0, False), ("bounds", 5, 4, 43, True), ("copy", 5, 4, 43, False)}
    got = {r["tag"]: tuple(r)[2:] for r in W.sheet_bounds(rows, scores, tags).collect()}
    assert got == {"TI_1": ("temp", "C", 1.0, 5.0, True, True), "FI_2": ("flow", None, None, 9.0, False, True), "P_9": ("new", "bar", 3.0, 4.0, False, True), "LOST": (None, None, None, None, False, False)}
