import json

from pyspark.sql import functions as F

from quillstream import session
from quillstream.catalog import QUERIES
from quillstream.operators import decisions as D

GOOD = {"rule_id": "r1", "action": "push", "evidence_ids": ["T1"], "reason": "because"}
SEGMENTS = [(k, s) for k in range(60) for s in ("T1", "B1", "B2", "B3")]


def judged(spark, responses, rules=("r1",), allowed=D.ACTIONS):
    df = spark.createDataFrame([(k, r if r is None or isinstance(r, str) else json.dumps(r)) for k, r in enumerate(responses)], "k long, raw string")
    told = D.read_responses(df, "k", "raw")
    expected = spark.createDataFrame([(k, r, list(allowed)) for k in range(len(responses)) for r in rules], "k long, rule_id string, allowed_actions array<string>")
    segments = spark.createDataFrame(SEGMENTS, "k long, segment_id string")
    verdict = D.validate(told, expected, segments, "k")
    return {r.k: r for r in verdict.collect()}, {r.k: r for r in D.results(told, verdict, "k").collect()}


def one(**changes):
    return {"rule_results": [{k: v for k, v in {**GOOD, **changes}.items() if v is not ...}]}


def test_exact_fields_and_types(spark):
    bad = [
        None, "", "no json", "[]", '{"rule_results": [], "more": 1}', {"rules": []}, {"rule_results": {}}, {"rule_results": ["text"]}, one(extra=1), one(reason=...), one(action="archive"), one(action="maybe"), one(action=1),
        one(rule_id=7), one(evidence_ids="T1"), one(evidence_ids=[1]), one(evidence_ids=[" "]), one(reason=None), {"rule_results": []},
    ]
    verdict, results = judged(spark, [one(), *bad, one(action="archive", evidence_ids=..., reason=...), one(evidence_ids=[" T1 "])])
    assert verdict[0].failure == "" and results[0].asDict() == {"k": 0, "action": "push", "reason": "because", "hits": ["r1"], "candidates": []}
    for k in range(1, len(bad) + 1):  # one fault of form and the rule that is not told
        assert (verdict[k].failure, verdict[k].n_structure, verdict[k].action) == ("invalid_output", 2, None), bad[k - 1]
        assert k not in results
    assert results[len(bad) + 1].action == "archive" and results[len(bad) + 1].reason == D.ARCHIVED and results[len(bad) + 1].hits == []
    assert results[len(bad) + 2].action == "push"


def test_limits_references_and_conflicts(spark):
    many = lambda n, **c: {"rule_results": [{**GOOD, "rule_id": f"r{i}", **c} for i in range(n)]}
    cases = [one(evidence_ids=["T1", "B1", "B2"]), one(evidence_ids=["T1", "B1", "B2", "B3"]), one(evidence_ids=["T1", "T1"]), one(evidence_ids=["T1", "X9"]), one(evidence_ids=["X9"]), one(reason="x" * 800), one(reason="x" * 801), one(reason=" "), one(rule_id="other"), {"rule_results": [GOOD, {**GOOD, "action": "daily"}]}]
    verdict, _ = judged(spark, cases)
    assert [verdict[k].failure for k in range(len(cases))] == ["", "invalid_output", "invalid_output", "invalid_evidence", "invalid_output", "", "invalid_output", "invalid_output", "invalid_output", "conflict"]
    verdict, results = judged(spark, [many(64), many(65)], [f"r{i}" for i in range(65)])
    assert verdict[0].n_structure == 1 and verdict[1].n_structure == 1  # a rule missing, and one too many
    verdict, results = judged(spark, [{"rule_results": [{**GOOD, "rule_id": "r2", "action": "daily", "reason": "b"}, {**GOOD, "reason": "a"}, {**GOOD, "rule_id": "r3", "reason": " c "}]}], ("r1", "r2", "r3"))
    assert results[0].action == "push" and results[0].reason == "a c" and results[0].hits == ["r2", "r1", "r3"] and results[0].candidates == ["r2"]
    verdict, _ = judged(spark, [one()], allowed=("archive", "daily"))
    assert verdict[0].failure == "invalid_output"


def test_prompt_inputs(spark):
    rows = [(1, "Title. More", "Sum", "Body one. Body two"), (2, "T", " ", "x" * 3500), (3, "only", None, ""), (4, " ", "", None), (5, "t", "s" * 50, " ")]
    df = spark.createDataFrame(rows, "k long, t string, s string, b string")
    got = {r.k: r for r in D.prompt_inputs(df, "k", "t", "s", "b", 3200).collect()}
    assert [(x.id, x.field, x.text) for x in got[1].segments] == [("T1", "title", "Title."), ("T2", "title", " More"), ("S1", "summary", "Sum"), ("B1", "full_text", "Body one."), ("B2", "full_text", " Body two")]
    assert (got[2].scope, got[2].input_chars, got[2].body_chars, got[2].body_given, got[2].body_cut, len(got[2].segments)) == ("title_summary_full_text", 3001, 3500, 3000, True, 11)
    assert got[3].scope == "title" and [x.id for x in got[3].segments] == ["T1"] and got[4].error == "insufficient_input" and got[4].segments is None and got[5].scope == "title_summary"
    assert {r.k: r.error for r in D.prompt_inputs(df, "k", "t", "s", "b", 40).collect()} == {1: "", 2: "input_too_large", 3: "", 4: "insufficient_input", 5: "input_too_large"}


def test_applicable_rules(spark):
    items = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, ["a"], ["c"]), (3, None, ["a"])], "k long, admitted array<string>, allowed array<string>")
    rules = spark.createDataFrame([("r1", ["b"]), ("r2", ["c", "a"]), ("r3", ["b", "b"])], "rule_id string, families array<string>")
    assert sorted(tuple(r) for r in D.applicable_rules(items, rules, "k", "admitted", "allowed", "families", "rule_id").collect()) == [(1, "r1"), (1, "r3")]
    assert D.applicable_rules(items, rules.where(F.lit(False)), "k", "admitted", "allowed", "families", "rule_id").count() == 0


def test_responses_judged_where_they_are_read(spark):
    many = lambda n, **c: {"rule_results": [{**GOOD, "rule_id": f"r{i}", **c} for i in range(n)]}
    archived = {"rule_id": "r1", "action": "archive"}
    responses = [
        None, "", "no json", "[]", '{"rule_results": [], "more": 1}', {"rules": []}, {"rule_results": {}}, {"rule_results": ["text"]}, {"rule_results": []}, {"rule_results": [None]}, '{"rule_results": [{"rule_id": "r1", "rule_id": "r1", "action": "archive"}]}',
        one(), one(extra=1), one(reason=...), one(action="archive"), one(action="maybe"), one(action=1), one(action=None), one(rule_id=7), one(rule_id=" r1 "), one(rule_id="other"), one(rule_id="R1"), one(evidence_ids="T1"), one(evidence_ids=[1]), one(evidence_ids=[" "]), one(evidence_ids=[]), one(evidence_ids=None),
        one(evidence_ids=[" T1 "]), one(evidence_ids=["T1", "B1", "B2"]), one(evidence_ids=["T1", "B1", "B2", "B3"]), one(evidence_ids=["T1", " T1"]), one(evidence_ids=["T1", "X9"]), one(evidence_ids=["X9"]), one(reason=None), one(reason=" "), one(reason=" x "), one(reason="x" * 800), one(reason="x" * 801),
        {"rule_results": [archived]}, {"rule_results": [archived, archived]}, {"rule_results": [GOOD, {**GOOD, "action": "daily"}]}, {"rule_results": [GOOD, {**GOOD, "rule_id": "r2", "evidence_ids": ["X9"]}]}, many(1), many(2), many(3), many(64), many(65),
        {"rule_results": [{**GOOD, "rule_id": "r2", "action": "daily", "reason": "b"}, {**GOOD, "reason": "a"}, {**GOOD, "rule_id": "r0", "reason": " c "}]}, {"rule_results": [{**GOOD, "rule_id": "r0", "reason": " c "}, archived, {**GOOD, "rule_id": "r2", "action": "daily"}]},
    ]
    rows = [(k, r if r is None or isinstance(r, str) else json.dumps(r)) for k, r in enumerate(responses)]
    for rules, allowed in ((["r1"], D.ACTIONS), (["r1"], ("archive", "daily")), (["r0", "r1", "r2"], D.ACTIONS), ([f"r{i}" for i in range(64)], D.ACTIONS), ([f"r{i}" for i in range(65)], D.ACTIONS), ([], D.ACTIONS)):
        known = [(r, list(allowed)) for r in rules]
        df = spark.createDataFrame([(k, r, known, ["T1", "B1", "B2", "B3"]) for k, r in [*rows, (None, json.dumps(one()))]], "k long, raw string, expected array<struct<rule_id:string,allowed_actions:array<string>>>, segments array<string>")
        told = D.read_responses(df, "k", "raw")
        expected, segments = df.selectExpr("k", "inline(expected)"), df.selectExpr("k", "explode(segments) AS segment_id")
        want = {r.k: r.asDict() for r in D.results(told, D.validate(told, expected, segments, "k"), "k").collect()}
        got = [r.asDict() for r in D.response_results(df, "k", "raw", "expected", "segments").collect()]
        assert len(got) == len(want) and {r["k"]: r for r in got} == want
        assert bool(want) == (0 < len(rules) <= D.MOST_ASSESSMENTS) and (len(rules) != 64 or [*want] == [responses.index(many(64))])
    none = df.withColumn("expected", F.lit(None).cast(df.schema["expected"].dataType)).withColumn("segments", F.lit(None).cast("array<string>"))
    assert D.response_results(none, "k", "raw", "expected", "segments").count() == 0


def test_a_response_is_grouped_once(spark, sf_dir):
    plan = QUERIES["response_results"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1 and "Join" not in plan and "Sort" not in plan


def test_tasks_of_bounded_rows(spark, monkeypatch):
    df = spark.range(95).select((F.col("id") % 40).alias("k"), "id")
    assert session.dealt(df, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "DEALT", 10)
    cut = session.dealt(df, "k").withColumn("p", F.spark_partition_id())
    assert cut.rdd.getNumPartitions() == 10 and cut.count() == 95
    assert cut.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    assert session.dealt(df.where("id < 0"), "k").count() == 0


def test_rules_meet_their_assessments_in_one_grouping(spark):
    rows = [(1, "r1", "push", ["T1"], "a"), (1, None, "push", ["T1"], "a"), (2, "r1", "push", ["T1"], "a"), (2, "r1", "maybe", None, None), (3, "r9", "daily", ["T1", "X9"], "a"), (None, "r1", "push", ["T1"], "a"), (5, "r1", "push", ["T1"], "a"), (6, "r1", "push", ["T1"], "a")]
    told = spark.createDataFrame(rows, "k long, rule_id string, action string, evidence_ids array<string>, reason string")
    expected = spark.createDataFrame([(1, "r1", ["push"]), (1, None, ["push"]), (2, "r1", ["push"]), (4, "r1", ["push"]), (None, "r1", ["push"]), (5, "r1", ["daily"]), (6, "r1", None)], "k long, rule_id string, allowed_actions array<string>")
    verdict = D.validate(told, expected, spark.createDataFrame(SEGMENTS, "k long, segment_id string"), "k")
    # A rule without a name, or of no response, is missing and is unknown to what names it; null allows any action.
    assert {r.k: (r.n_structure, r.n_evidence, r.n_conflict, r.failure) for r in verdict.collect()} == {
        1: (2, 0, 0, "invalid_output"), 2: (1, 0, 0, "invalid_output"), 3: (1, 1, 0, "invalid_output"), 4: (1, 0, 0, "invalid_output"), None: (3, 1, 0, "invalid_output"), 5: (1, 0, 0, "invalid_output"), 6: (0, 0, 0, ""),
    }
    assert verdict._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # evidence alone
