import json
import time

import pytest
from pyspark.sql import functions as F

from quillstream.functions import records as R

CASES = [
    ('{"a": 1}', '{"a": 1}'), (' {"a": 1}\n', '{"a": 1}'), ('note {"a":1} then {"b":2}', '{"a":1}'), ('x {a} y {"b":1} z', None), ('```json\n{"a": {"b": 2}}\n```', '{"a": {"b": 2}}'),
    ('``` {"a":1} ``` and {"b":2}', '{"a":1}'), ('so {"s": "}{", "t": "\\"}"} end }', '{"s": "}{", "t": "\\"}"}'), ('{"s": "\\\\"} tail', '{"s": "\\\\"}'), ("[1, 2]", None), ("{", None), ("}{", None), ("", None), (None, None),
    ('{"a": 1', None), ('{"a": 1}}', '{"a": 1}'), ("{'a': 1}", None), ('[{"a": 1}]', '{"a": 1}'), ('pre {"k": [1, {"m": "é{漢"}]} post', '{"k": [1, {"m": "é{漢"}]}'), ('{"x": 1}' + " " * 50_000 + "}", '{"x": 1}'),
]


@pytest.mark.parametrize("text, want", CASES)
def test_find_object(text, want):
    assert R.find_object(text) == want
    if want:
        assert isinstance(json.loads(R.find_object(text)), dict)


def test_json_object_column(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i long, t string")
    assert [r.found for r in rows.select("i", R.json_object(F.col("t")).alias("found")).orderBy("i").collect()] == [w for _, w in CASES]


def test_relevant_lines_and_authors(spark):
    lines = R.relevant_lines(F.lit("Apple one\nnone\n APPLE one \napple two\n" + "\n".join(f"apple {i}" for i in range(9))), ["apple"])
    authors = R.author_targets(F.lit(" 7@@Ann ##7@@Bob##@@x##8##9@@"))
    row = spark.range(1).select(lines.alias("l"), authors.alias("a"), R.author_targets(F.lit(None)).alias("n"), R.relevant_lines(F.lit(None), ["a"]).alias("e")).first()
    assert row.l == ["Apple one", "apple two", "apple 0", "apple 1", "apple 2", "apple 3"]
    assert [tuple(a) for a in row.a] == [("7", "Ann"), ("8", ""), ("9", "")] and row.n == [] and row.e == []


def test_report_titles(spark):
    titles = ["Bank A-Target price €12.5 20240131【12页】上调", "no word of it", "", None, "首次覆盖 买入"]
    got = [tuple(r.x) for r in spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", R.report_title(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got[0] == ("Bank A", "2024-01-31", "12", "€12.5", "upgrade") and got[1][0] == "unknown"
    assert got[2] == got[3] and got[4][4] == "buy"


def longest_spans(text, patterns, most=8):
    import re

    found = sorted(((m.start(), m.end(), m.group()) for p in patterns for m in re.finditer(p, text or "") if m.group()), key=lambda m: (m[0], m[0] - m[1]))
    kept = []
    for a, b, v in found:
        if not any(a >= x and b <= y for x, y, _ in kept):
            kept.append((a, b, v))
    return [v for _, _, v in kept[:most]]


def test_quantified_spans_equal_pairwise_comparison(spark):
    import random

    rng = random.Random(8)
    patterns = [r"\d+", r"\d+(?:\.\d+)?%?", r"up \d+%", r"[ab]+ up", r"b"]
    texts = ["".join(rng.choice(["up ", "12", "3.5", "%", "a", "b", " ", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "", "up 5% " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", R.quantified_spans(F.col("t"), patterns).alias("x")).collect()}
    assert got == {i: longest_spans(t, patterns) for i, t in enumerate(texts)}


def test_claims_and_attributions_are_verbatim(spark):
    text = F.lit("Bank A said  rates rise\nby 3% soon. Mr Bo of Bank A spoke.")
    claims = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(e).alias("event_type"), F.lit(q).alias("evidence_quote")) for t, e, q in (("rates", "change", "rates rise by 3%"), ("rates", "other", "rates rise"), ("x", "change", "rates rise"), (" rates ", "change", "rates fall"), ("rates", "change", ""), ("rates", "change", "Bank A said"))])
    row = spark.range(1).select(R.valid_claims(text, claims, ["rates"], ["change"], [r"\d+%"]).alias("c"), R.valid_claims(text, F.lit(None).cast("array<struct<topic:string,event_type:string,evidence_quote:string>>"), ["a"], ["b"], ["c"]).alias("n")).first()
    assert [tuple(c) for c in row.c] == [("rates", "change", "rates rise by 3%", ["3%"]), ("rates", "change", "Bank A said", [])] and row.n == []
    ok = lambda attribution, quote, speaker="": spark.range(1).select(R.valid_attribution(text, F.lit(attribution), F.lit(quote), ["bank a"], F.lit(speaker), ["Mr Bo"], ["wrong"])).first()[0]
    assert ok("explicit", "Bank A said rates rise") and not ok("implied", "Bank A said rates rise") and not ok("explicit", "Bank A says") and not ok("explicit", "rates rise")
    assert ok("explicit", "Mr Bo of", "Mr Bo") and not ok("explicit", "Mr Bo of", "mr bo") and not ok("explicit", "Mr Bo of", "Mr Cy") and not ok("explicit", "")


def test_spans_of_a_long_text_take_one_pass(spark):
    df, patterns = spark.createDataFrame([("running 1.5 " * 20_000,)], "t string"), (r"[a-z]+ing", r"\d+(?:\.\d+)?", r"[a-z]+ing \d")
    start = time.monotonic()
    assert df.select(R.quantified_spans(F.col("t"), patterns).alias("x")).first().x == ["running 1", "1.5"] * 4
    assert time.monotonic() - start < 30  # minutes, if each match read the text again
