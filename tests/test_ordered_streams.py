import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import events
from quillstream.streaming import ordered

T0 = dt.datetime(2024, 1, 1)
END = T0 + dt.timedelta(days=400)


def run(spark, tmp_path, rows, schema, build, batches=4):
    """The rows in ``batches`` files, one a micro-batch, and a last row far ahead that lets the watermark pass all others."""
    folder, out = tmp_path / "in", []
    folder.mkdir()
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.parquet(str(folder / f"b{k:09d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = build(source).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return out


def late(rows, rng, minutes):
    """Rows in the order of their arrival, up to ``minutes`` late."""
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.random() * minutes))


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_look_back_of_late_rows_equals_batch(two_partitions, tmp_path):
    spark, rng = two_partitions, random.Random(1)
    rows = [(f"k{rng.randrange(3)}", T0 + dt.timedelta(minutes=rng.randrange(3000)), i) for i in range(200)]
    schema = "k string, t timestamp, i long"
    minutes = F.when(F.col("i") % 2 == 0, 45).otherwise(90)
    want = {r.i: r.duplicate for r in events.look_back(spark.createDataFrame(rows, schema), ["k"], "t", "i", minutes).collect()}
    got = run(spark, tmp_path, [*late(rows, rng, 100), ("end", END, -1)], schema, lambda s: ordered.look_back(s, ["k"], "t", "i", minutes, "2 hours", 90))
    assert {r.i: r.duplicate for r in got} == want


def test_alerts_of_late_rows_equal_batch(two_partitions, tmp_path):
    spark, rng = two_partitions, random.Random(2)
    rows = [("s", T0 + dt.timedelta(minutes=7 * i + rng.randrange(7)), i, rng.random() < 0.8) for i in range(150)]
    schema = "k string, t timestamp, i long, bad boolean"
    want = {(r.i, r.kind) for r in events.alerts(spark.createDataFrame(rows, schema), ["k"], "t", "i", F.col("bad")).collect()}
    got = run(spark, tmp_path, [*late(rows, rng, 100), ("end", END, -1, False)], schema, lambda s: ordered.alerts(s, ["k"], "t", "i", F.col("bad"), lateness="2 hours"))
    assert {(r.i, r.kind) for r in got} == want


def test_reservations_confirm_release_and_expire(two_partitions, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("k", at(0), "a", 60, None), ("k", at(5), "b", 60, None), ("k", at(6), "a", 60, "failed"), ("k", at(10), "c", 60, None), ("k", at(11), "c", 60, "sent"), ("k", at(12), "c", 60, "failed"), ("k", at(70), "d", 60, None), ("k", at(71), "e", 60, None)]
    got = run(two_partitions, tmp_path, [*[rows[i] for i in (1, 0, 3, 2, 5, 4, 7, 6)], ("end", END, "z", 1, None)], "k string, t timestamp, e string, m long, o string", lambda s: ordered.reservations(s, "k", "t", "e", F.col("m"), "o", "1 hour"), batches=3)
    assert {r.e: (r.status, r.first_event) for r in got if r.k == "k"} == {"a": ("reserved", "a"), "b": ("duplicate", "a"), "c": ("reserved", "c"), "d": ("duplicate", "c"), "e": ("reserved", "e")}


def test_feedback_counts_each_event_once(two_partitions, tmp_path):
    spark = two_partitions
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("x", at(0), "1", "high_value", None), ("x", at(2), "3", "invalid", ["b", " a ", "b"]), ("x", at(1), "2", "duplicate", None), ("x", at(300), "3", "invalid", ["b"]), ("x", at(301), "4", "high_value", None), ("x", at(302), "5", "invalid", ["c"]), ("x", at(303), "6", "invalid", None)]
    schema = "k string, t timestamp, e string, l string, r array<string>"
    got = run(spark, tmp_path, [*rows, ("end", END, "9", "invalid", None)], schema, lambda s: ordered.feedback(s, ["k"], "t", "e", "l", "r", "1 hour"))
    told = [(r.e, r.counted, r.active_labels, r.reason_tags) for r in sorted((r for r in got if r.k == "x"), key=lambda r: r.t)]
    assert told == [
        ("1", True, "high_value", ""), ("2", True, "high_value,duplicate", ""), ("3", True, "high_value,duplicate,invalid", "b,a"), ("3", False, "high_value,duplicate,invalid", "b,a"),
        ("4", True, "duplicate,invalid", "b,a"), ("5", True, "duplicate,invalid", "c"), ("6", True, "duplicate", ""),
    ]
    batch = events.feedback_state(spark.createDataFrame(rows, schema), ["k"], ["t"], "e", "l", "r").first()
    assert (",".join(batch.active_labels), ",".join(batch.reason_tags)) == told[-1][2:]


def test_keys_share_the_state_of_their_group(two_partitions, tmp_path):
    spark = two_partitions
    rows = [(f"k{i % 700}", T0 + dt.timedelta(minutes=i), i, "useful", None) for i in range(1400)]
    schema = "k string, t timestamp, i long, label string, reasons array<string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    clicks = ordered.folded(source, ["k"], "t", ["i"], ["i", "label", "reasons"], ordered.Clicks(), {"counted": "boolean", "active": "string", "tags": "string"}, "1 hour", groups=8)
    query = clicks.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    told = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert told and max(told) <= 8 * 8  # and not by the 700 keys
