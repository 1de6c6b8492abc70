import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import lifecycle
from quillstream.sources import paged


@pytest.fixture
def pages(spark, tmp_path, monkeypatch):
    path = tmp_path / "pages.json"
    # Python workers of a local session are started with the environment of the session, so the name must be fixed there.
    monkeypatch.setenv("RECORDED_PAGES", str(path))
    spark.dataSource.register(paged.PagedRecords)
    return path


def reader(path, **options):
    return paged.PagedReader({"fetch": "tests.recorded_pages:counted", "channels": "a, b,none", **options})


def test_pages_until_the_watermark(pages):
    pages.write_text(json.dumps({"a": [{"id": i, "time": 100 + i} for i in range(10)], "b": [{"id": "x", "time": 5}, {"id": None, "time": 9}, {"time": 7}]}))
    one = reader(pages, since=json.dumps({"a": 105}))
    got = [r for p in one.partitions() for r in one.read(p)]
    assert [(c, i, t, n) for c, i, t, n, _ in got] == [("a", "9", 109, 0), ("a", "8", 108, 1), ("a", "7", 107, 2), ("a", "6", 106, 3), ("b", "x", 5, 0)]
    assert open(f"{pages}.log").read().split() == ["a:0", "a:1", "b:0", "b:1", "none:0"]  # no page of a after the one that has old rows
    assert json.loads(got[0][4]) == {"id": 9, "time": 109}


def test_stream_offsets_are_watermarks(pages):
    pages.write_text(json.dumps({"a": [{"id": i, "time": i} for i in range(1, 5)], "b": []}))
    stream = paged.PagedStream({"fetch": "tests.recorded_pages:fetch", "channels": "a,b"})
    start, end = stream.initialOffset(), stream.latestOffset()
    assert (start, end) == ({"a": -1, "b": -1}, {"a": 4, "b": -1})
    first = [r[1] for p in stream.partitions(start, end) for r in stream.read(p)]
    pages.write_text(json.dumps({"a": [{"id": i, "time": i} for i in range(1, 8)], "b": [{"id": "n", "time": 3}]}))
    late = [r[1] for p in stream.partitions(start, end) for r in stream.read(p)]  # a batch that is read again gives the same
    assert first == late == ["4", "3", "2", "1"]
    again = stream.latestOffset()
    assert [(r[0], r[1]) for p in stream.partitions(end, again) for r in stream.read(p)] == [("a", "7"), ("a", "6"), ("a", "5"), ("b", "n")]
    assert stream.partitions(again, again) == []


def test_as_a_spark_source_and_channels_merge(spark, tmp_path):
    spark.dataSource.register(paged.PagedRecords)
    df = spark.read.format("paged_records").option("fetch", "tests.test_paged:fixed").option("channels", "a,b").option("since", '{"a": 1}').load()
    rows = df.select("channel", "id", "time", F.get_json_object("payload", "$.s").alias("s"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "1", 3, None), ("a", "2", 2, "two"), ("b", "1", 9, "one")]
    merged = lifecycle.merge_channels(rows.withColumn("o", -F.col("time")), "id", ["o", "channel"], "channel", ["s"])
    assert sorted((r.id, r.s, r.channels) for r in merged.collect()) == [("1", "one", ["b", "a"]), ("2", "two", ["a"])]
    stream = spark.readStream.format("paged_records").option("fetch", "tests.test_paged:fixed").option("channels", "a,b").load()
    for _ in range(2):  # the second run finds nothing new
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
    assert sorted((r.channel, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]


def fixed(channel, page):
    rows = {"a": [[{"id": 1, "time": 3}, {"id": 2, "time": 2, "s": "two"}], [{"id": 3, "time": 1}]], "b": [[{"id": 1, "time": 9, "s": "one"}]]}[channel]
    return rows[page] if page < len(rows) else []
