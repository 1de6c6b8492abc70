import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import readmodels as M

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_first_kind(spark):
    df = spark.createDataFrame([(1, "k", True), (2, None, True), (3, None, False), (4, None, None)], "i int, a string, b boolean")
    assert rows(df.select("i", M.first_kind({"key": F.col("a"), "flag": F.col("b")}).alias("k"))) == [(1, "key"), (2, "flag"), (3, "none"), (4, "none")]


def test_backfill_and_overlay(spark):
    stored = spark.createDataFrame([(1, "-", "x"), (2, "kept", "x"), (3, None, "x"), (4, " ", "x"), (5, "-", "x")], "k int, t string, _fresh2 string")
    details = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, " ", 3), (2, "other", 1), (3, "three", 1), (4, None, 1)], "k int, t string, at int")
    assert rows(M.backfilled(stored, details, "k", "t", ["at"]), "k", "t") == [(1, "new"), (2, "kept"), (3, "three"), (4, " "), (5, "-")]
    over = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, None, None), (9, "z", True)], "k int, t string, disabled boolean")
    assert rows(M.overlaid(stored, over, "k", ["t"]), "k", "t", "disabled") == [(1, "b", True), (2, "kept", False), (3, None, False), (4, " ", False), (5, "-", False)]


def test_ordered_distinct_and_lists_with_rest(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 0), ("a", None, 0), (None, "z", 5), ("a", "w", 1)], "k string, v string, o int")
    assert rows(M.ordered_distinct(df, ["k"], "v", ["o"], "l")) == [("a", ["x", "w", "y"]), (None, ["z"])]
    assert rows(M.shown_and_omitted(df, ["k"], ["o", "v"], "v", 2)) == [("a", [None, "x"], 3), (None, ["z"], 0)]


def pairwise(items, sources=None, hours=None):
    out = {}
    for i, s, t, u, a in items:
        told = (None, None)
        mine = [x for x in items if x[4] is not None and x[1] is not None and (sources is None or x[1] in sources)]
        if (i, s, t, u, a) in mine:
            for k, by in ((3, "url"), (2, "title")):
                v = ((i, s, t, u, a)[k] or "").strip() if k == 2 else (i, s, t, u, a)[k] or ""
                same = [x for x in mine if v and (((x[k] or "").strip() if k == 2 else x[k] or "") == v) and x[1] != s and (x[4], x[0]) < (a, i)]
                if same:
                    pick = min(same, key=lambda x: (x[4], x[0])) if hours is None else max(same, key=lambda x: (x[4], x[0]))
                    if hours is None or a - pick[4] <= dt.timedelta(hours=hours):
                        told = (pick[0], by)
                        break
        out[i] = told
    return out


@pytest.mark.parametrize("hours", [None, 5])
@pytest.mark.parametrize("sources", [None, ("a", "b")])
def test_cross_source_equals_pairwise(spark, hours, sources):
    rng = random.Random(5)
    items = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["t1", " t2 ", "t2", "", None]), rng.choice(["u1", "u2", "", None, f"own{i}"]), rng.choice([None, *[at(h) for h in range(40)]])) for i in range(160)]
    df = spark.createDataFrame(items, "i long, s string, t string, u string, at timestamp")
    got = {r.i: (r.duplicate_of, r.by) for r in M.cross_source(df, "i", "s", "t", "u", "at", sources, hours).collect()}
    assert got == pairwise(items, sources, hours)


def test_counts_and_totals(spark):
    df = spark.createDataFrame([("p", True, 3), ("p", None, None), ("q", True, 1), ("r", False, 2)], "k string, bad boolean, n int")
    assert rows(M.usage(df, ["k"], F.col("bad"), F.col("n"))) == [("p", 2, 1, 3, "partial"), ("q", 1, 1, 1, "failed"), ("r", 1, 0, 2, "ok")]
    log = spark.createDataFrame([(1, 1, "u"), (1, 2, "c"), (2, 3, "u"), (2, 2, "c"), (3, 1, None)], "k int, t int, s string")
    assert rows(M.decision_counts(log, ["k"], "t", F.col("s") == "c", F.col("s") == "u")) == [(1, 2, 1, 1, 0, True), (2, 2, 1, 1, 0, False), (3, 1, 0, 0, 0, False)]
    health = spark.createDataFrame([("a", 0, 1), ("b", 2, 5), ("c", 2, 9), ("d", 4, None), ("e", None, 1)], "s string, f long, u int")
    assert M.health_totals(health, "f", 3, 2).first() == (5, 2, 2, 1, 8, 2, True) and M.health_totals(health.limit(0), "f").first() == (0, 0, 0, 0, 0, 0, False)
    assert [r.s for r in M.top_issues(health, "s", "f", "u", 3).collect()] == ["d", "c", "b"]
    assert [tuple(r) for r in M.counts_by_category(health, "s", ["z", "b"], {"bad": F.col("f") > 1}).orderBy("place").collect()] == [(0, "z", 0, 0), (1, "b", 1, 1)]


def test_selections_and_comparisons(spark):
    items = spark.createDataFrame([(1, "a", "new"), (2, "a", "unpushed"), (3, "a", "unpushed"), (4, "a", "unpushed"), (5, "b", "done"), (6, "b", "retry"), (7, "b", "done")], "i int, s string, st string")
    assert [r[0] for r in rows(M.preview_selection(items, "i", "s", "st", 2, [3, 5]))] == [1, 2, 3, 5, 6]
    assert [r[0] for r in rows(M.preview_selection(items, "i", "s", "st", 1))] == [1, 2, 6]
    held, cache = spark.createDataFrame([(1, "x"), (2, "x"), (None, "y")], "c int, g string"), spark.createDataFrame([(1,), (1,), (None,)], "c int")
    assert rows(M.missing(held, cache, "c", ["g"])) == [("x", 2, 1, 2), ("y", 1, 1, None)]
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, v string, w int"), spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "q", 1)], "k int, v string, w int")
    assert rows(M.compared(a, b, "k", ["v", "w"])) == [(1, "equal"), (2, "differs"), (3, "only_table"), (4, "only_config")]


def test_preferred_first_seen_union_and_intervals(spark):
    df = spark.createDataFrame([("k", 1, False, "a"), ("k", 2, True, "b"), ("k", 3, True, "c"), ("m", 5, None, "d"), ("m", 4, None, "e")], "k string, o int, f boolean, v string")
    assert rows(M.preferred(df, ["k"], F.col("f"), ["o"], ["v"])) == [("k", "b", True), ("m", "e", False)]
    assert rows(M.first_seen(df, "k", "v", "o", "v")) == [("k", "a", 1, 3), ("m", "e", 4, 2)]
    both = M.union_as({"p": df.select("k"), "q": df.select("o", "v").limit(1)})
    assert both.columns == ["kind", "k", "o", "v"] and both.count() == 6
    starts, marks = spark.createDataFrame([("x", 1, 10), ("x", 5, 11), ("y", 1, 12)], "k string, t int, i int"), spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("x", 4, 3), ("x", 5, 4), ("z", 1, 5)], "k string, t int, m int")
    assert rows(M.interval_members(starts, marks, ["k"], "t", "i", "m")) == [(10, 3, 2), (11, 4, 1), (12, None, 0)]
    labels = spark.createDataFrame([(1, "b", at(1)), (1, "a", at(3)), (2, "a", at(9)), (3, "c", None)], "i int, l string, t timestamp")
    assert [(r.i, r.labels) for r in M.recent_examples(labels, "i", "l", F.upper("l"), "t", 2).collect()] == [(2, ["A"]), (1, ["A", "B"])]
