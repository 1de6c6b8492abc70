import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import events, scan

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", range(30))
def test_summaries_equal_steps(seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(400) for _ in range(rng.randint(1, 60)))
    spans = [rng.choice([0, 5, 20, 90, None]) if seed % 2 else 30 for _ in times]
    fold = scan.LookBack()
    s = fold.begin()
    for t, span in zip(times, spans, strict=True):
        s = fold.add(s, t, span)
    done = fold.end(s)
    for entry in [None, *range(times[0] - 100, times[0] + 1)]:
        state = entry
        for t, span in zip(times, spans, strict=True):
            state = fold.step(state, t, span)[0]
        assert fold.after(done, entry) == state
    alerts = scan.Alerts(3, 40)
    rows = [(None, True)] * rng.choice([0, 0, 4]) + [(t, rng.random() < 0.8) for t in times]
    s = alerts.begin()
    for r in rows:
        s = alerts.add(s, *r)
    done = alerts.end(s)
    for n in range(6):
        for last in [None, *range(times[0] - 60, times[0] + 1, 7)]:
            state = (n, last)
            for r in rows:
                state = alerts.step(state, *r)[0]
            assert alerts.after(done, (n, last)) == state


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_key_with_nine_tenths_of_the_rows_runs_in_several_tasks(uncoalesced):
    spark, rng = uncoalesced, random.Random(7)
    rows = [("hot" if i % 10 else f"k{i % 7}", T0 + dt.timedelta(minutes=rng.randrange(30_000)), i, rng.random() < 0.8) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i long, bad boolean")
    minutes = F.when(F.col("i") % 3 == 0, 45).otherwise(20)
    done = events.look_back(df, ["k"], "t", "i", minutes)
    got = {r.i: r.duplicate for r in done.collect()}
    want, by_key = {}, {}
    for k, t, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        span = 45 if i % 3 == 0 else 20
        covered = k in by_key and (t - by_key[k]).total_seconds() <= span * 60
        want[i] = covered
        if not covered:
            by_key[k] = t
    assert got == want
    micros = df.select("k", F.unix_micros("t").alias("_t"), "i", F.lit(45 * 60_000_000).alias("_span"))
    told = scan.scanned(micros, ["k"], ["_t", "i"], ["_t", "_span"], scan.LookBack(), {"duplicate": "boolean", "_anchor": "bigint"})
    assert told.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() >= 3
    log = events.alerts(df, ["k"], "t", "i", F.col("bad")).collect()
    fold, state, told = scan.Alerts(3, 60 * 60_000_000), {}, set()
    for k, t, i, bad in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        state[k], (kind,) = fold.step(state.get(k, fold.start()), int((t - T0).total_seconds() * 1_000_000), bad)
        if kind:
            told.add((i, kind))
    assert {(r.i, r.kind) for r in log} == told


def test_several_keys_nulls_and_no_rows(spark):
    rows = [(None, 1, T0, 1), (None, None, T0, 2), ("a", 1, T0, 3), (None, 1, T0 + dt.timedelta(minutes=1), 4), ("a", 1, None, 5)]
    df = spark.createDataFrame(rows, "k string, j int, t timestamp, i long")
    assert sorted((r.i, r.duplicate) for r in events.look_back(df, ["k", "j"], "t", "i", 5).collect()) == [(1, False), (2, False), (3, False), (4, True)]
    assert events.look_back(df.limit(0), ["k", "j"], "t", "i", 5).count() == 0
    assert events.alerts(df.withColumn("b", F.lit(True)).limit(0), ["k"], "t", "i", F.col("b")).count() == 0
