"""Folds over keys with long histories: no row or state grows with them."""

import random

from pyspark.sql import functions as F

from quillstream.operators import events
from tests.test_operators import at, greedy

LISTS = ("collect_list", "array_append")


def unlisted(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in LISTS)
    return df


def test_one_long_key(spark):
    n = 20_000
    rng = random.Random(8)
    rows = [("k", rng.randint(0, 3 * n), i) for i in range(n)]
    df = spark.createDataFrame([(k, at(m), i) for k, m, i in rows], "k string, t timestamp, i long")
    assert {r.i: r.duplicate for r in unlisted(events.look_back(df, ["k"], "t", "i", 45)).collect()} == greedy(rows, 45)
    log = df.withColumn("bad", F.col("i") % 7 != 0)
    told = unlisted(events.alerts(log, ["k"], "t", "i", F.col("bad"))).collect()
    streak, last, want = 0, None, []
    for _, m, i in sorted(rows, key=lambda r: (r[1], r[2])):
        bad, cool = i % 7 != 0, last is None or m - last >= 60
        if bad and streak + 1 >= 3 and cool:
            want.append((i, "failure"))
            last = m
        elif not bad and streak >= 3 and last is not None and cool:
            want.append((i, "recovery"))
        streak = streak + 1 if bad else 0
    assert sorted((r.i, r.kind) for r in told) == sorted(want)


def test_feedback_equals_model(spark):
    rng = random.Random(9)
    clicks = [(rng.choice("ab"), rng.randint(0, 50), f"e{i:03}", rng.choice(events.LABELS), rng.choice(([], ["x"], ["y", "y", " "], None))) for i in range(rng.randint(300, 320))]
    for size in (3, 10, 40, 300):
        df = spark.createDataFrame(clicks[:size], "k string, t long, id string, label string, tags array<string>")
        got = {r.k: (r.active_labels, r.reason_tags, r.last_id) for r in unlisted(events.feedback_state(df, ["k"], ["t"], "id", "label", "tags")).collect()}
        want = {}
        for k, _, i, label, tags in sorted(clicks[:size], key=lambda c: c[1:3]):
            active, kept, _ = want.get(k, (set(), [], None))
            tags = [x for x in dict.fromkeys(x.strip() for x in tags or ()) if x]
            active = active | {label} if label == "invalid" and tags else active ^ {label}
            kept = [] if "invalid" not in active else tags if label == "invalid" else kept
            want[k] = (active, kept, i)
        assert got == {k: ([x for x in events.LABELS if x in a], t, i) for k, (a, t, i) in want.items()}
