"""The historian source and sink against a local server."""

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from historian_server import serve  # noqa: E402
from quernel.sources import historian as H  # noqa: E402

T0 = datetime(2026, 1, 1)


@pytest.fixture
def hub(spark):
    spark.dataSource.register(H.Historian)
    server, url = serve()
    yield server.store, url
    server.shutdown()


def at(minutes):
    return (T0 + timedelta(minutes=minutes)).strftime(H.FORMAT)


def fill(store, minutes, tags=("a", "b")):
    store.points += [(t, at(m), m + (0.5 if t == "b" else 0)) for t in tags for m in range(minutes)]


def test_rows_of_slices_are_those_of_the_whole_range(spark, hub):
    store, url = hub
    fill(store, 180, ("a", "b", "c"))
    read = lambda **o: spark.read.format("historian").options(url=url, tags="a, b", begin=at(10), end=at(130), **o).load()
    whole = sorted(map(tuple, read().collect()))
    assert whole == sorted((t, T0 + timedelta(minutes=m), m + (0.5 if t == "b" else 0)) for t in "ab" for m in range(10, 130))
    store.asked.clear()
    parted = read(slice=1800)
    assert sorted(map(tuple, parted.collect())) == whole and parted.rdd.getNumPartitions() == 8
    asked = {x for x in store.asked if x[1] == at(40)}
    assert asked == {(("a",), at(40), "2026-01-01 01:09:59"), (("b",), at(40), "2026-01-01 01:09:59")}


def test_conditions_narrow_the_requests(spark, hub):
    store, url = hub
    fill(store, 180)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("historian").options(url=url, tags="a,b", begin=at(0), end=at(180), pushdown="true").load()
        some = df.where((F.col("tag") == "b") & (F.col("time") > F.lit(at(30)).cast("timestamp_ntz")) & (F.col("time") <= F.lit(at(60)).cast("timestamp_ntz")) & (F.col("value") != 40.5))
        store.asked.clear()
        got = [r["value"] for r in some.orderBy("time").collect()]
        assert got == [m + 0.5 for m in range(31, 61) if m != 40]
        assert set(store.asked) == {(("b",), at(30), at(60))}
        assert df.where("tag = 'z'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_odd_records_and_refusals(spark, hub):
    store, url = hub
    store.points += [("a", at(1), "1.5"), ("a ", at(2), "bad"), ("a", at(3), None), ("a", at(4), "nan"), ("a", "2026-01-01 00:05:00.250", 7), ("a", "2026-01-01 00:0x", 1)]
    settings = H.Settings.of({"url": url, "tags": "a"})
    got = list(H.history(settings, ["a"], T0, T0 + timedelta(hours=1)))
    assert [(r[1].minute, r[2]) for r in got] == [(1, 1.5), (2, None), (3, None), (4, None), (5, 7.0)]
    assert list(H.history(settings, ["a"], T0, T0)) == [] and list(H.history(settings, [], T0, T0 + H.SECOND)) == []
    with pytest.raises(H.HistorianError, match="unknown tag"):
        list(H.history(settings, ["refused"], T0, T0 + timedelta(hours=1)))
    with pytest.raises(ValueError, match="url"):
        H.Settings.of({})
    with pytest.raises(ValueError, match="begin"):
        H.HistorianReader(settings)


def test_a_busy_historian_is_asked_again(hub):
    store, url = hub
    fill(store, 5)
    store.failing = 2
    assert len(list(H.history(H.Settings.of({"url": url, "tags": "a"}), ["a"], T0, T0 + timedelta(hours=1)))) == 5
    store.failing = 2
    with pytest.raises(H.HistorianError, match="503"):
        list(H.history(H.Settings.of({"url": url, "tags": "a", "retries": "1"}), ["a"], T0, T0 + timedelta(hours=1)))


def run_stream(spark, url, out, checkpoint, end, **options):
    df = spark.readStream.format("historian").options(url=url, tags="a,b", begin=at(0), end=at(end), most=1800, slice=600, **options).load()
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(600):
            if q.lastProgress and q.lastProgress["sources"][0]["endOffset"] and at(end) in str(q.lastProgress["sources"][0]["endOffset"]) or not q.isActive:
                break
            q.awaitTermination(0.1)
        q.processAllAvailable()
        assert q.exception() is None
        return [p for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def test_a_stream_reads_each_time_once(spark, hub, tmp_path):
    store, url = hub
    fill(store, 200)
    batches = run_stream(spark, url, tmp_path / "out", tmp_path / "at", 90)
    assert len(batches) == 3 and [b["numInputRows"] for b in batches] == [60, 60, 60]
    run_stream(spark, url, tmp_path / "out", tmp_path / "at", 150)  # goes on from its checkpoint
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted((t, T0 + timedelta(minutes=m), m + (0.5 if t == "b" else 0)) for t in "ab" for m in range(150))


def test_offsets_stay_behind_the_clock():
    now = datetime.now()
    begin = (now - timedelta(hours=1)).strftime(H.FORMAT)
    r = H.HistorianStreamReader(H.Settings.of({"url": "http://x", "tags": "a", "begin": begin, "settle": "600", "most": "86400"}))
    assert abs(datetime.strptime(r.latestOffset()["time"], H.FORMAT) - (now - timedelta(seconds=600))) < timedelta(seconds=5)
    r.at = now  # beyond: no offset goes back
    assert r.latestOffset()["time"] == now.strftime(H.FORMAT)


def test_batch_writes_the_last_value_of_each_tag_at_once(spark, hub):
    store, url = hub
    rows = [("x", T0 + timedelta(minutes=i), float(i)) for i in range(20)] + [("x", T0 + timedelta(minutes=19), 3.0), ("x", T0 + timedelta(minutes=30), float("nan")), ("y", T0, -1.0), ("z", T0, None), (None, T0, 1.0), ("y", None, 5.0)]
    spark.createDataFrame(rows, H.SCHEMA).repartition(5).write.format("historian").option("url", url).mode("append").save()
    assert store.written == [{"x": 19.0, "y": -1.0}]
    spark.createDataFrame([], H.SCHEMA).write.format("historian").option("url", url).mode("append").save()
    assert len(store.written) == 1


def test_a_batch_that_is_run_again_writes_nothing_twice(spark, hub, tmp_path):
    store, url = hub
    source = tmp_path / "in"
    batch = lambda i: spark.createDataFrame([("x", T0 + timedelta(minutes=i), float(i))], H.SCHEMA).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        df = spark.readStream.schema(H.SCHEMA).parquet(str(source))
        q = df.writeStream.format("historian").options(url=url, batch_tag="quernel.batch").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None

    for i in range(3):
        batch(i)
        run()
    assert store.written == [{"x": float(i), "quernel.batch": float(i)} for i in range(3)]
    for kept in (tmp_path / "at" / "commits").iterdir():  # the query ended after the last request, before its own log
        if kept.name.strip(".").removesuffix(".crc") == "2":
            kept.unlink()
    run()
    assert len(store.written) == 3
    batch(3)
    run()
    assert store.written[3:] == [{"x": 3.0, "quernel.batch": 3.0}]
    with pytest.raises(ValueError, match="batch_tag"):
        H.HistorianStreamWriter(H.Settings.of({"url": url}))
