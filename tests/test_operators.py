import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import admission, events, versions
from quillstream.operators.admission import Corridor, Holding, RuleConfig

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def greedy(rows, minutes):
    """Sequential model: (id -> duplicate) for rows of (key, minute, id)."""
    anchor, out = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        covered = key in anchor and t - anchor[key] <= minutes
        if not covered:
            anchor[key] = t
        out[i] = covered
    return out


def test_look_back_re_anchors(spark):
    rows = [("k", at(m), i) for i, m in enumerate([0, 30, 50, 80, 100, 140])]
    got = events.look_back(spark.createDataFrame(rows, "k string, t timestamp, i long"), ["k"], "t", "i", 45)
    assert [r.duplicate for r in got.orderBy("i").collect()] == [False, True, False, True, False, True]


def test_look_back_random(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 4)}", rng.randint(0, 600), i) for i in range(300)]
    df = spark.createDataFrame([(k, at(m), i) for k, m, i in rows], "k string, t timestamp, i long")
    got = {r.i: r.duplicate for r in events.look_back(df, ["k"], "t", "i", 45).collect()}
    assert got == greedy(rows, 45)


def test_look_back_empty_and_null(spark):
    df = spark.createDataFrame([(None, at(0), 1), (None, at(1), 2), ("a", None, 3)], "k string, t timestamp, i long")
    assert sorted((r.i, r.duplicate) for r in events.look_back(df, ["k"], "t", "i", 5).collect()) == [(1, False), (2, True)]
    assert events.look_back(df.where("false"), ["k"], "t", "i", 5).count() == 0


def test_fact_sets(spark):
    rows = [(1, "a", at(0)), (1, "b", at(0)), (2, "a", at(5)), (2, "c", at(5)), (3, "a", at(6)), (3, "c", at(6))]
    got = events.fact_set_duplicates(spark.createDataFrame(rows, "item long, fact string, t timestamp"), "item", "fact", "t", 60)
    assert {r.item: (r.n_facts, r.n_covered, r.duplicate) for r in got.collect()} == {1: (2, 0, False), 2: (2, 1, False), 3: (2, 2, True)}


def test_alerts_and_recovery(spark):
    outcome = [(0, True), (1, True), (2, True), (3, True), (70, True), (71, False), (140, True), (141, True), (142, True), (210, False)]
    rows = [("s", at(m), i, bad) for i, (m, bad) in enumerate(outcome)]
    df = spark.createDataFrame(rows, "s string, t timestamp, i long, bad boolean")
    got = events.alerts(df, ["s"], "t", "i", F.col("bad")).orderBy("i").collect()
    assert [(r.i, r.kind) for r in got] == [(2, "failure"), (4, "failure"), (8, "failure"), (9, "recovery")]


def test_feedback_toggles(spark):
    clicks = [
        ("i", "o", 1, "e1", "high_value", []),
        ("i", "o", 2, "e2", "invalid", ["x", "x", " "]),
        ("i", "o", 3, "e3", "invalid", ["y"]),
        ("i", "o", 3, "e3", "invalid", ["y"]),
        ("i", "o", 4, "e4", "high_value", []),
        ("i", "p", 1, "f1", "invalid", []),
        ("i", "p", 2, "f2", "invalid", []),
    ]
    df = spark.createDataFrame(clicks, "item string, op string, t long, id string, label string, tags array<string>")
    got = {r.op: (r.active_labels, r.reason_tags) for r in events.feedback_state(df, ["item", "op"], ["t"], "id", "label", "tags").collect()}
    assert got == {"o": (["invalid"], ["y"]), "p": ([], [])}


def test_quality_rates(spark):
    df = spark.createDataFrame([("s", ["invalid", "duplicate"]), ("s", None), (None, ["invalid"])], "s string, l array<string>")
    got = {r["key"]: (r.delivered, r.labelled, r.invalid_rate, r.coverage, r.low_sample) for r in events.quality(df, F.col("s"), "l").collect()}
    assert got == {"s": (2, 1, 1.0, 0.5, True), "unknown": (1, 1, 1.0, 1.0, True)}


def test_merge_versions(spark):
    rows = [(1, 1, "T", "long text", "baseline", "unknown"), (1, 2, "", "short", "live", "news"), (1, 3, None, "same size", "live", "unknown")]
    df = spark.createDataFrame(rows, "k int, seq int, title string, body string, class string, kind string")
    got = versions.merge_versions(df, ["k"], ["seq"], {"title": "filled", "body": "longest", "kind": ("filled", "unknown"), "seq": "newest"}, promote=("class", "baseline", "live")).first()
    assert (got.title, got.body, got.kind, got.seq, got["class"], got.n_versions) == ("T", "same size", "news", 3, "live", 3)


def test_latest_first_and_difference(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert {r.k: r.v for r in versions.latest(df, ["k"], ["n"]).collect()} == {"a": "y", "b": None}
    assert {r.k: r.v for r in versions.first(df, ["k"], ["n"]).collect()} == {"a": "x", "b": None}
    old, new = df.where("n = 1").select("k", "v"), spark.createDataFrame([("a", "x"), ("c", "z")], "k string, v string")
    assert {r.k: r.change for r in versions.difference(old, new, "k", ["v"]).collect()} == {"a": "same", "b": "removed", "c": "added"}


def test_ledger_and_watermark(spark):
    found = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("t", 1)], "source string, id int")
    ledger = spark.createDataFrame([("s", 1, False), ("s", 2, True)], "source string, id int, retry boolean")
    got = sorted((r.source, r.id, r.is_retry, r.is_baseline) for r in versions.admit_new(found, ledger, ["source", "id"], "source", F.col("retry")).collect())
    assert got == [("s", 2, True, False), ("s", 3, False, False), ("t", 1, False, True)]
    state = spark.createDataFrame([("s", 2)], "source string, watermark int")
    assert sorted(tuple(r) for r in versions.beyond_watermark(found, state, "source", "id").collect()) == [("s", 3), ("t", 1)]
    assert {r.source: r.watermark for r in versions.next_watermark(found, state, "source", "id").collect()} == {"s": 3, "t": 1}


CONFIG = RuleConfig(
    "v", topics=("chip", "gpu"), title_topics=("gpu",), indicators=("cpi",), contexts=("us",), policy_terms=("fed",), corridors=(Corridor("c", ("china",), ("us",), ("sino-us",)),),
    trade_actions=("tariff",), excluded=("horoscope",), holdings=(Holding("600000.SH", ("acme",), ("widgets",), ("toy",)),), holding_only_sources=("stock",), official_sources=("gov",),
)


@pytest.mark.parametrize(
    "source, title, text, reason, families",
    [
        ("n", "", None, "empty_rule_text", []),
        ("n", "x", "plain words", "out_of_scope", []),
        ("n", "x", "a gpu here", "out_of_scope", []),
        ("n", "gpu", "a gpu here", "content_scope_match", ["semiconductor_ai"]),
        ("n", "x", "CPI in the US. fed", "content_scope_match", ["macro_data", "fed_policy"]),
        ("n", "x", "China and US tariff", "content_scope_match", ["trade_policy"]),
        ("n", "x", "China and US\ntariff", "out_of_scope", []),
        ("n", "x", "chip horoscope", "global_exclude", []),
        ("n", "x", "acme horoscope", "content_scope_match", ["holding"]),
        ("n", "x", "widgets toy", "out_of_scope", []),
        ("stock", "x", "chip", "holding_scope_required_for_source", []),
        ("stock", "x", "acme chip", "holding_scope_match", ["holding"]),
        ("gov", "x", "anything", "content_scope_match", ["trade_policy"]),
    ],
)
def test_admission(spark, source, title, text, reason, families):
    df = spark.createDataFrame([(source, title, text)], "source string, title string, rule_text string")
    got = admission.admit(df, CONFIG).first().admission
    assert (got.reason_code, got.matched_families) == (reason, families)
    assert (got.status == "admitted") == bool(families)
    assert {e.rule_family for e in got.evidence} <= set(families) | {"global"}


def test_config_is_checked():
    with pytest.raises(ValueError):
        RuleConfig("v", topics=("a",), title_topics=("b",))
    with pytest.raises(ValueError):
        Corridor("c", ("a",), ())


def test_reasons_are_trimmed_of_white_space_only(spark):
    rows = [("x", at(0), 1, "invalid", ["0 bad", " 1st", "2", "0 bad", " "])]
    got = events.feedback_state(spark.createDataFrame(rows, "k string, t timestamp, e long, l string, r array<string>"), ["k"], ["t"], "e", "l", "r").first()
    assert got.active_labels == ["invalid"] and got.reason_tags == ["0 bad", "1st", "2"]


def test_an_items_own_symbols_are_direct_mentions(spark):
    config = RuleConfig("v", holdings=(Holding("AC.1", ("Acme",), ("anvil",), ("cartoon",)), Holding("BO.2", ("Bolt",))), holding_only_sources=("h",))
    rows = [(1, "nothing named", ["AC.1", "AC.1"], "x"), (2, "acme", ["AC.1"], "x"), (3, "nothing", None, "x"), (4, "ac.1 here", ["BO.2"], "x"), (5, "anvil", ["zz"], "h"), (6, "", ["AC.1"], "x")]
    df = spark.createDataFrame(rows, "id int, rule_text string, own array<string>, source string").withColumn("title", F.lit(""))
    got = {r.id: (r.admission.reason_code, [(e.reason_code, e.matched_term_ids) for e in r.admission.evidence]) for r in admission.admit(df, config, symbols="own").collect()}
    term = lambda t: "term:" + __import__("hashlib").sha256(t.encode()).hexdigest()[:12]
    assert got[1] == ("content_scope_match", [("holding_direct_identity", [term("ac.1")])]) and got[2][1] == [("holding_direct_identity", [term("acme")])]
    assert got[3] == ("out_of_scope", []) and [t for _, (t,) in got[4][1]] == [term("ac.1"), term("bo.2")] and got[5][0] == "holding_scope_match" and got[6][0] == "empty_rule_text"
    assert admission.admit(df, config).where("id = 1").first().admission.reason_code == "out_of_scope"
