"""Files in several encodings in one folder, read in splits."""

from datetime import datetime

import pytest
from quernel.sources import encoded as E


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def name(path):
    return path.rsplit("/", 1)[-1]


def test_point_files_of_one_folder(spark, tmp_path, small_splits):
    lines = lambda tag, n=200, sep="\t": [sep.join([tag, f"2026-01-01 {i // 60:02d}:{i % 60:02d}:00", str(i), "好"]) for i in range(n)]
    (tmp_path / "u.txt").write_bytes("﻿".encode() + "\n".join(lines("温度-1")).encode())
    (tmp_path / "g.txt").write_bytes("\n".join(lines("温度 2")).encode("gbk"))
    (tmp_path / "h.txt").write_bytes("\r\n".join(lines("㐀3", 150)).encode("gb18030"))  # a character that GBK lacks
    (tmp_path / "TI-9.txt").write_text("\n".join(f"2026-01-02 00:{i:02d}:00\t{i}.5" for i in range(50)) + "\nnever\t1\n2026-01-02 01:00:00\tbad\n")
    (tmp_path / "c.csv").write_text("\n".join(lines("P/1", 30, ",")).replace("好", "ok"))
    (tmp_path / "one.txt").write_text("alone\nalone")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff\t2026-01-01\t1")
    (tmp_path / "empty.txt").write_text("")
    points, files = E.read_encoded_points(spark, str(tmp_path))
    told = {name(r["file"]): r for r in files.collect()}
    assert {k: (r["encoding"], r["rows"], r["tag_value"], r["parse_error"]) for k, r in told.items()} == {
        "u.txt": ("UTF-8", 200, "温度-1", None), "g.txt": ("GBK", 200, "温度 2", None), "h.txt": ("GB18030", 150, "㐀3", None), "TI-9.txt": ("UTF-8", 51, "TI-9", None), "c.csv": ("UTF-8", 30, "P/1", None),
        "one.txt": ("UTF-8", 0, None, "fewer than two columns"), "bad.txt": (None, 0, None, "no encoding decodes the file"),
    }
    assert (told["g.txt"]["time_min"], told["g.txt"]["time_max"]) == (datetime(2026, 1, 1), datetime(2026, 1, 1, 3, 19))
    rows = points.collect()
    assert {r["tag"] for r in rows} == {"温度_1", "温度_2", "㐀3", "TI_9", "P_1"} and len(rows) == 631
    assert sorted(r["value"] for r in rows if r["tag"] == "温度_2") == [float(i) for i in range(200)]
    assert [r["value"] for r in rows if r["tag"] == "TI_9" and r["time"].hour == 1] == [None]


def test_first_and_last_columns(spark, tmp_path, small_splits):
    middle = ",".join(str(i) for i in range(50))
    rows = [f"2026-01-01 00:{i // 2:02d}:{30 * (i % 2):02d},{middle},{i}" for i in range(100)]
    head = "时间," + ",".join(f"c{i}" for i in range(50)) + ",校正值"
    (tmp_path / "a.csv").write_bytes("\n".join([head, *rows]).encode("gbk"))
    (tmp_path / "b.csv").write_bytes(("﻿time,v\n" + "\n".join(f"2026-01-01 00:00:0{i},{'x' if i < 3 else i}" for i in range(10))).encode())
    (tmp_path / "c.csv").write_text("time\n1\n2")
    (tmp_path / "d.csv").write_text("time,v")
    minutes, files = E.read_first_and_last(spark, str(tmp_path))
    told = {name(r["file"]): (r["encoding"], r["n"], r["columns"], r["time_name"], r["value_name"], r["time_rate"], r["value_rate"], r["accepted"]) for r in files.collect()}
    assert told["a.csv"] == ("GBK", 100, 52, "时间", "校正值", 1.0, 1.0, True)
    assert told["b.csv"] == ("UTF-8", 10, 2, "time", "v", 1.0, 0.7, False)
    assert told["c.csv"][2] == 1 and not told["c.csv"][-1] and told["d.csv"][1] == 0 and not told["d.csv"][-1]
    got = minutes.orderBy("minute").collect()
    assert [(r["minute"].minute, r["value"]) for r in got] == [(i, 2 * i + 0.5) for i in range(50)] and {name(r["file"]) for r in got} == {"a.csv"}
