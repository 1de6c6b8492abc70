import datetime as dt

from pyspark.sql import functions as F

from quillstream.operators import projections as P

T0 = dt.datetime(2024, 1, 1)


def hit(rule="r", action="push", brief=None, reason=None, evidence=None, related=None, affected=None):
    return (rule, action, brief, reason, evidence, related, affected)


def shown(spark, make, *decisions):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(decisions)], f"i int, d {P.DECISION}")
    return [r.x for r in df.select("i", make(F.col("d")).alias("x")).orderBy("i").collect()]


def test_reasons_of_the_winning_action(spark):
    many = ("push", None, "own", [hit(brief=" A  b "), hit(reason="a B"), hit(action="daily", reason="no"), hit(brief="", reason="c"), *[hit(reason=f"x{i}") for i in range(4)], hit()], None)
    got = shown(spark, P.basis_reasons, many, ("daily", " Brief ", "long", [hit()], None), ("push", None, None, None, None), None)
    assert [(r.reasons, r.omitted) for r in got] == [(["A b", "c", "x0", "x1"], 2), (["Brief"], 0), ([], 0), ([], 0)]


def test_targets_and_interpretations(spark):
    d = ("push", "b", "r", [hit(related=[(" N ", "1"), (None, "2"), (None, None)], affected=["t", "", None, "N 1"]), hit()], [("Z", None), ("N", "1")])
    assert shown(spark, P.target_labels, d, None) == [["N 1", "2", "t", "Z"], []]
    got = shown(spark, lambda c: P.rule_only_interpretation(F.lit("T"), F.when(c["action"] == "push", "S"), c), d, ("daily", "", "why", None, None))
    assert [tuple(x) for x in got] == [("S", "b", "rule_only"), ("T", "why", "rule_only")]


def test_views_are_bounded(spark):
    d = ("push", None, "r" * 900, [hit(rule="q" * 200, reason="w" * 900, evidence=[("e", "x" * 400), ("f", " "), ("g", "y"), ("h", "z")])] * 40, None)
    one, none = shown(spark, P.decision_view, d, None)
    assert len(one.reason) == 800 and len(one.rule_assessments) == 32 and none is None
    a = one.rule_assessments[0]
    assert (len(a.rule_id), len(a.reason), [(e.evidence_id, len(e.quote)) for e in a.evidence]) == (120, 800, [("e", 300), ("g", 1)])
    row = spark.range(1).select(P.shown_values(F.array(*[F.lit(v) for v in (" a ", "", "b", "c")]), 2).alias("v"), P.shown_values(F.lit(None).cast("array<string>")).alias("n"), P.duplicate_label(F.lit("company_event_dedup")).alias("l"), P.duplicate_label(F.lit(None).cast("string")).alias("d")).first()
    assert tuple(row.v) == (["a", "b"], 3, True) and tuple(row.n) == ([], 0, False) and row.l.startswith("同一公司") and row.d == P.DUPLICATE_DEFAULT


def test_updates_of_stored_rows(spark):
    schema = "source string, item_id string, collection_class string, processability_status string, processability_reason string, admission_status string, processing_status string, processed_at timestamp, lifecycle_updated_at timestamp"
    base = ("s", "1", "live", "failed_terminal", "empty", "not_applicable", "not_applicable", T0, T0)
    rows = [base, ("t", *base[1:]), (*base[:2], "baseline", *base[3:]), (*base[:4], "other", *base[5:]), (*base[:4], None, *base[5:])]
    got = P.restored(spark.createDataFrame(rows, schema), "s", "empty", "ValueError: empty", F.lit(T0 + dt.timedelta(days=1))).collect()
    assert [r.restored for r in got] == [True, False, False, False, False]
    assert (got[0].processability_status, got[0].processability_reason, got[0].admission_status, got[0].processed_at) == ("failed_retryable", "ValueError: empty", "pending", None) and got[1].processed_at == T0
    posts = spark.createDataFrame([("a", 1), ("a", 2)], "source string, post int")
    tries = spark.createDataFrame([("a", 1, "sent", None, 1), ("a", 1, "failed", "e" * 1200, 3), ("a", 1, "failed", "x", 2), ("b", 9, "sent", None, 1)], "source string, post int, status string, error string, at int")
    out = {r.post: r for r in P.delivery_attempts(posts, tries, ["source", "post"], ["at"]).collect()}
    assert (out[1].delivery_status, len(out[1].delivery_error), out[1].delivery_attempts, out[1].delivered_at) == ("failed", 1000, 3, 1) and (out[2].delivery_status, out[2].delivery_attempts) == (None, 0)
    stored = spark.createDataFrame([("A.1", "Alpha", False, ["x"])], "symbol string, name string, enabled boolean, aliases array<string>")
    sent = spark.createDataFrame([(" a.1 ", None, None, None), ("B.2", " ", True, ["p", "p", " "]), (None, "Only", None, None), ("", " ", True, None)], stored.schema)
    assert sorted((r.symbol, r.name, r.enabled, r.aliases, r.state) for r in P.holdings_saved(stored, sent).collect()) == [("", "", True, [], "refused"), ("", "Only", True, [], "saved"), ("A.1", "Alpha", False, ["x"], "saved"), ("B.2", "B.2", True, ["p"], "saved")]


def test_orders(spark):
    items = spark.createDataFrame([("s", 1, "2024-02"), ("s", 2, None), ("s", 3, "2024-01"), ("t", 4, "9"), ("s", 5, "")], "source string, i int, p string")
    assert {r.i: r.turn for r in P.process_order(items, "p", "i").collect()} == {2: 1, 5: 2, 3: 3, 1: 4, 4: 1}
    rows = spark.createDataFrame([(1, 5, "ok"), (2, 9, "ok"), (3, 9, "bad"), (4, None, "ok")], "review int, t int, status string")
    assert [r.review for r in P.latest_decisions(rows, "t", "review").collect()] == [3, 2, 1, 4] and [r.review for r in P.latest_decisions(rows, "t", "review", "ok", 2).collect()] == [2, 1]
