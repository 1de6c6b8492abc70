"""Rule decisions: which rules apply, whether a response is valid, and the action that follows.

A response is a row per assessment. Errors are found row by row or by grouping, and counted per class;
nothing of a response is gathered beyond its own assessments, whose number is bounded by a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: Actions by rank, the strongest last.
ACTIONS = ("archive", "daily", "push")
#: Evidence references of an assessment, assessments of a response, characters of a reason at most.
MOST_REFS, MOST_ASSESSMENTS, MOST_REASON = 3, 64, 800
#: Fields of a response and of its assessments, and what is said of an item that no rule holds.
TOP_FIELDS, ARCHIVE_FIELDS, EVIDENCED_FIELDS = ("rule_results",), ("rule_id", "action"), ("rule_id", "action", "evidence_ids", "reason")
ARCHIVED = "所有适用程度规则均不满足 push 或 daily，归为 archive。"
#: Characters of a prompt's input and of its body at most.
MOST_INPUT, MOST_BODY = 120_000, 3_000


def rank_of(action: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action)


def applicable_rules(items: DataFrame, rules: DataFrame, key: str, admitted: str, allowed: str, families: str, rule: str) -> DataFrame:
    """(key, rule): rules one of whose ``families`` the item was admitted for and may be judged by.

    Rules are exploded by family and joined by it, so an item meets only rules of its own families.
    """
    one = items.select(key, F.explode(F.array_intersect(admitted, allowed)).alias("_family"))
    by_family = rules.select(rule, F.explode(families).alias("_family"))
    return one.join(by_family, "_family").select(key, rule).distinct()


def read_responses(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, place, rule_id, action, evidence_ids, reason): the assessments of JSON responses, for ``validate``.

    An assessment must be an object of exactly the fields of its action, texts where texts are due, and a list of
    texts that are not blank as references; else its action is null. A response that is no JSON, has other fields or
    no list is one such row. An empty list gives one as well, so that its missing rules are told.
    """
    return _with_assessments(responses.select(key, raw), raw).select(key, F.inline("_told"))


def _with_assessments(responses: DataFrame, raw: str) -> DataFrame:
    """``responses`` with the list ``_told`` of (place, rule_id, action, evidence_ids, reason) for ``raw``; what several expressions read is a column or a step of its own."""
    same = lambda keys, fields: F.coalesce(F.size(keys) == len(fields), F.lit(False)) & F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))) == 0, F.lit(False))
    text = F.trim(F.coalesce(raw, F.lit("")))
    rows = responses.withColumn("_told", F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), text))
    rows = rows.withColumn("_told", F.when(same(F.json_object_keys("_told"), TOP_FIELDS), F.get_json_object("_told", "$.rule_results")))
    rows = rows.withColumn("_told", F.when(F.col("_told").startswith("["), F.from_json("_told", "array<string>")))
    each = F.when(F.size("_told") > 0, F.col("_told")).otherwise(F.array(F.lit(None).cast("string")))
    each = F.transform(each, lambda x: F.struct(x.alias("one"), F.json_object_keys(x).alias("keys")))
    each = F.transform(each, lambda x: F.struct(x["keys"].alias("keys"), F.when(x["keys"].isNotNull(), F.try_parse_json(x["one"])).alias("v")))

    def read(x: Column) -> Column:
        kind = lambda name: F.schema_of_variant(F.try_variant_get(x["v"], f"$.{name}", "variant"))
        value = lambda name: F.try_variant_get(x["v"], f"$.{name}", "string")
        is_text = lambda name: F.coalesce(kind(name) == "STRING", F.lit(False))
        refs = F.try_variant_get(x["v"], "$.evidence_ids", "array<variant>")
        names = F.transform(F.try_variant_get(x["v"], "$.evidence_ids", "array<string>"), lambda n: F.trim(n))
        good_refs = F.coalesce(F.forall(refs, lambda r: F.schema_of_variant(r) == "STRING"), F.lit(False)) & F.coalesce(F.forall(names, lambda n: n != ""), F.lit(False))
        archive = value("action") == "archive"
        good = is_text("action") & is_text("rule_id") & F.when(archive, same(x["keys"], ARCHIVE_FIELDS)).otherwise(same(x["keys"], EVIDENCED_FIELDS) & is_text("reason") & good_refs)
        return F.struct(F.when(is_text("rule_id"), F.trim(value("rule_id"))).alias("rule_id"), F.when(good, value("action")).alias("action"), names.alias("names"), value("reason").alias("reason"))

    def told(x: Column, place: Column) -> Column:
        evidenced = x["action"] != "archive"  # null where the form is not good
        return F.struct(
            place.alias("place"), x["rule_id"].alias("rule_id"), x["action"].alias("action"),
            F.when(evidenced, x["names"]).otherwise(F.array().cast("array<string>")).alias("evidence_ids"), F.when(evidenced, x["reason"]).otherwise("").alias("reason"),
        )

    return rows.withColumn("_told", F.transform(F.transform(each, read), told))


def response_results(responses: DataFrame, key: str, raw: str, expected: str, segments: str) -> DataFrame:
    """(key, action, reason, hits, candidates) of the JSON responses without a fault, as ``results`` has them, one row a key.

    ``expected`` is the list of (rule_id, allowed_actions) of a response, one a rule, and ``segments`` the list of its evidence's ids. A response
    is judged where it is read: ``validate`` deals assessments, rules and segments as rows, which a task sorts and groups one after the other.
    A response of too many assessments is at fault whatever they say, so no more of them are looked at than may be.
    """
    rows = _with_assessments(responses.where(F.col(key).isNotNull()), raw)
    known = F.coalesce(expected, F.array().cast("array<struct<rule_id:string,allowed_actions:array<string>>>"))
    ids = F.coalesce(segments, F.array().cast("array<string>"))

    def sound(a: Column) -> Column:
        unknown = F.size(F.array_except(a["evidence_ids"], ids))
        rule = F.get(F.filter(known, lambda e: e["rule_id"] == a["rule_id"]), F.lit(0))
        faults = _structure(a["action"].isin(*ACTIONS), a["action"], a["evidence_ids"], F.trim(a["reason"]), unknown)
        return (faults == 0) & rule.isNotNull() & _may(rule["allowed_actions"], a["action"]) & ((a["action"] == "archive") | (unknown == 0))

    told = F.transform("_told", lambda a: a["rule_id"])
    every = (F.size(F.array_distinct(told)) == F.size(told)) & (F.size(F.array_except(F.transform(known, lambda e: e["rule_id"]), told)) == 0)
    good = F.when(F.size("_told") <= MOST_ASSESSMENTS, every & F.forall("_told", sound))
    # A plain filter would be moved below the columns, and so read each response once more for each condition.
    rows = rows.select(key, F.explode_outer(F.when(good, F.array("_told"))).alias("_told")).where("_told IS NOT NULL")
    ranks = F.array_max(F.transform("_told", lambda a: rank_of(a["action"])))
    rows = rows.withColumn("_action", F.get(F.array(*[F.lit(a) for a in ACTIONS]), ranks.cast("int") - 1))
    hits = F.filter("_told", lambda a: a["action"] != "archive")
    rows = rows.withColumn("_told", F.transform(hits, lambda a: F.struct(a["place"].alias("place"), a["rule_id"].alias("rule_id"), a["action"].alias("action"), F.trim(a["reason"]).alias("reason"))))
    return _results(rows, key)


def results(assessments: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """(key, action, reason, hits, candidates) of the responses that ``validate`` found no fault with.

    ``hits`` are the rules that are not archived, in the order of the response; ``candidates`` those of a weaker action than the
    strongest; the reason joins what the strongest say.
    """
    good = judged.where("failure = ''").select(F.col(key).alias("_key"), F.col("action").alias("_action"))
    rows = assessments.join(good, F.col(key) == F.col("_key"))
    told = F.array_sort(F.collect_list(F.when(F.col("action") != "archive", F.struct("place", "rule_id", "action", F.trim("reason").alias("reason")))))
    return _results(rows.groupBy(key, "_action").agg(told.alias("_told")), key)


def _results(rows: DataFrame, key: str) -> DataFrame:
    """What ``results`` tells of rows with the strongest ``_action`` and the list ``_told`` of hits (place, rule_id, action, reason)."""
    won = F.filter("_told", lambda t: t["action"] == F.col("_action"))
    reason = F.when(F.col("_action") == "archive", ARCHIVED).otherwise(F.array_join(F.transform(won, lambda t: t["reason"]), " "))
    weaker = F.filter("_told", lambda t: t["action"] != F.col("_action"))
    return rows.select(key, F.col("_action").alias("action"), reason.alias("reason"), F.transform("_told", lambda t: t["rule_id"]).alias("hits"), F.transform(weaker, lambda t: t["rule_id"]).alias("candidates"))


def prompt_inputs(items: DataFrame, key: str, title: str, summary: str, body: str, most: int = MOST_INPUT) -> DataFrame:
    """(key, scope, error, input_chars, body_chars, body_given, body_cut, segments): what a model is given of an item.

    The scope is the richest of body, summary and title that is there; fields of white space are left out; a body is cut at 3,000
    characters. ``error`` is ``insufficient_input`` without any text, ``input_too_large`` beyond ``most`` characters. Segments are (id, field, text) with
    ids T1…, S1…, B1… by field.
    """
    t, s, b = (T.text_of(F.col(c)) for c in (title, summary, body))
    scope = F.when(T.strip(b) != "", "title_summary_full_text").when(T.strip(s) != "", "title_summary").otherwise("title")
    given = F.when(scope == "title_summary_full_text", F.substring(b, 1, MOST_BODY)).otherwise("")
    fields = [("title", "T", t), ("summary", "S", F.when(scope == "title", "").otherwise(s)), ("full_text", "B", given)]
    kept = [(name, prefix, F.when(T.strip(c) != "", c).otherwise("")) for name, prefix, c in fields]
    chars = sum((F.length(c) for _, _, c in kept[1:]), F.length(kept[0][2]))
    error = F.when(chars == 0, "insufficient_input").when(chars > most, "input_too_large").otherwise("")
    segments = F.concat(*[_segments(c, prefix, name) for name, prefix, c in kept])
    return items.select(key, scope.alias("scope"), error.alias("error"), chars.cast("long").alias("input_chars"), F.length(b).alias("body_chars"), F.length(given).alias("body_given"), (F.length(b) > F.length(given)).alias("body_cut"), F.when(error == "", segments).alias("segments"))


def _segments(text: Column, prefix: str, field: str) -> Column:
    return F.transform(T.evidence_segments(text, prefix), lambda x: F.struct(x["id"].alias("id"), F.lit(field).alias("field"), x["text"].alias("text")))


def validate(assessments: DataFrame, expected: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, n_structure, n_evidence, n_conflict, failure, action) of every response in ``assessments`` or ``expected``.

    ``assessments`` has rule_id, action, evidence_ids and reason; ``expected`` the rules of each key with
    allowed_actions; ``segments`` the ids of each key's evidence. Structure: a wrong action, one that the rule
    does not allow, an unknown or missing rule, no evidence or reason where one is needed (or any where none
    may be), too many references or assessments, repeated references. Evidence: references to unknown
    segments. Conflict: rules told twice. The failure is the first class that has errors, in that order;
    without one the action is the strongest of the assessments.
    """
    acts, evidenced = F.col("action").isin(*ACTIONS), F.col("action") != "archive"
    refs = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    reason = F.trim(F.coalesce("reason", F.lit("")))
    found = segments.groupBy(key).agg(F.collect_set("segment_id").alias("_ids"))
    rows = assessments.select(key, "rule_id", "action", "evidence_ids", "reason").join(found, key, "left")
    unknown = F.size(F.array_except(refs, F.coalesce("_ids", F.array().cast("array<string>"))))
    faults = _structure(acts, F.col("action"), refs, reason, unknown)
    judged = rows.select(key, "rule_id", faults.alias("_s"), F.when(acts & evidenced, unknown).otherwise(0).cast("long").alias("_e"), F.lit(1).alias("_n"), *[_yes(F.col("action") == a).alias(f"_{a}") for a in ACTIONS])
    # Rules meet their assessments in one grouping, with what each allows as flags, so that neither side is sorted for a join.
    rules = expected.select(key, "rule_id", F.lit(1).alias("_known"), *[_may(F.col("allowed_actions"), F.lit(a)).cast("int").alias(f"_may_{a}") for a in ACTIONS])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_s", "_e", "_n", "_known", *[f"_{a}" for a in ACTIONS])]
    by_rule = judged.unionByName(rules, allowMissingColumns=True).groupBy(key, "rule_id").agg(*sums, *[F.max(f"_may_{a}").alias(f"_may_{a}") for a in ACTIONS])
    apart = F.col(key).isNull() | F.col("rule_id").isNull()  # such a rule is told by no assessment
    n_told = sum((F.col(f"_{a}") for a in ACTIONS[1:]), F.col(f"_{ACTIONS[0]}"))
    wrong = [F.when(apart | (F.col("_known") == 0) | (F.col(f"_may_{a}") == 0), F.col(f"_{a}")).otherwise(0) for a in ACTIONS]
    missing = F.when(apart, F.col("_known")).otherwise(_yes((F.col("_known") > 0) & (n_told == 0)))
    rank = F.greatest(*[F.when(F.col(f"_{a}") > 0, k) for k, a in enumerate(ACTIONS, 1)])
    done = by_rule.groupBy(key).agg(
        F.sum(sum(wrong, F.col("_s")) + missing).alias("_s"), F.sum("_e").alias("n_evidence"),
        F.count_if(n_told > 1).alias("n_conflict"), F.sum("_n").alias("_n"), F.max(rank).alias("_rank"),
    ).withColumn("n_structure", F.col("_s") + _yes(F.col("_n") > MOST_ASSESSMENTS))
    failure = F.when(F.col("n_structure") > 0, "invalid_output").when(F.col("n_evidence") > 0, "invalid_evidence").when(F.col("n_conflict") > 0, "conflict").otherwise("")
    action = F.when(failure == "", F.get(F.array(*[F.lit(a) for a in ACTIONS]), F.col("_rank").cast("int") - 1))
    return done.select(key, "n_structure", "n_evidence", "n_conflict", failure.alias("failure"), action.alias("action"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("long")


def _may(allowed: Column, action: Column) -> Column:
    return F.coalesce(F.array_contains(allowed, action), F.lit(True))


def _structure(acts: Column, action: Column, refs: Column, reason: Column, unknown: Column) -> Column:
    """Faults of form of one assessment, but for what its rule allows; ``unknown`` counts references to no segment."""
    evidenced = action != "archive"
    return (
        _yes(~acts | action.isNull()) + _yes(acts & evidenced & (F.size(refs) - unknown <= 0)) + _yes(acts & evidenced & (reason == "")) + _yes(acts & (F.length(reason) > MOST_REASON))
        + _yes(acts & evidenced & (F.size(refs) > MOST_REFS)) + _yes(acts & (F.size(refs) > F.size(F.array_distinct(refs)))) + _yes(acts & ~evidenced & ((F.size(refs) > 0) | (reason != "")))
    )
