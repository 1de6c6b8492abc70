import datetime as dt
import random

from pyspark.sql import functions as F

from quillstream.functions import market
from quillstream.operators import admission, lifecycle

T0 = dt.datetime(2024, 3, 10)


def test_probe_titles_equals_pairwise(spark):
    rng = random.Random(3)
    at = lambda: rng.choice([None, *[T0 + dt.timedelta(hours=h) for h in range(0, 400, 7)]])
    ledger = [(f"e{i:03}", rng.choice(["a", " a ", "b", "", None]), at()) for i in range(60)]
    items = [(i, rng.choice(["a", "b", "c", "", None]), at()) for i in range(120)]
    got = {r.k: r.match_id for r in lifecycle.probe_titles(spark.createDataFrame(items, "k long, t string, at timestamp"), spark.createDataFrame(ledger, "e string, t string, at timestamp"), "k", "t", "at", "e", 2).collect()}
    for k, t, when in items:
        near = sorted((abs(when - w), w, e) for e, x, w in ledger if when and w and t and (x or "").strip() == t and abs(when - w) <= dt.timedelta(days=2))
        assert got[k] == (near[0][2] if near else None)


def test_probe_by_kind_and_merge_and_queue(spark):
    ledger = spark.createDataFrame([("1", "u1", 10), ("1", "u9", 7), ("2", "", 11), (None, "u3", 12)], "id string, url string, n int")
    items = spark.createDataFrame([(1, "1", "u3"), (2, "9", "u3"), (3, None, ""), (4, "2", None)], "k int, id string, url string")
    got = {r.k: (r.match_kind, r.match_id) for r in lifecycle.probe(items, "k", [("id", ledger, "id", "n"), ("url", ledger, "url", "n")]).collect()}
    assert got == {1: ("id", 7), 2: ("url", 12), 3: ("new", None), 4: ("id", 11)}
    rows = spark.createDataFrame([("x", 1, "c2", ""), ("x", 2, "c1", "s"), ("x", 3, "c2", "late"), ("y", 1, "c1", None)], "k string, o int, ch string, s string")
    assert sorted((r.k, r.s, r.first_row, r.channels) for r in lifecycle.merge_channels(rows, "k", ["o"], "ch", ["s"]).collect()) == [("x", "s", 1, ["c2", "c1"]), ("y", None, 1, ["c1"])]
    queue = spark.createDataFrame([("s", i, i, a) for i, a in enumerate([0, 0, 5, 0, 0])], "src string, seen int, id int, n int")
    states = {r.id: r.state for r in lifecycle.retry_queue(queue, "src", "seen", "id", "n", 5, 2, F.col("id") == 4).collect()}
    assert states == {0: "retry", 1: "retry", 2: "failed_terminal", 3: "waiting", 4: "failed_terminal"}


def test_reviews_admissions_and_imports(spark):
    log = spark.createDataFrame([("a", 1, "s"), ("a", 2, "c"), ("a", 3, "s"), ("b", 1, "c"), ("c", 1, "s"), ("c", 2, "f")], "k string, o int, e string")
    is_ = lambda x: F.col("e") == x
    got = {r.k: (r.status, r.n_reviews, r.last_review) for r in lifecycle.reviews(log, "k", ["o"], is_("s"), is_("c"), is_("f")).collect()}
    assert got == {"a": ("admitted_pending", 2, 3), "b": ("baseline", 0, None), "c": ("failed", 1, 1)}
    rows = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "x", False), ("a", 3, "x", True), ("a", 4, None, False), ("a", 5, None, False)], "k string, o int, v string, f boolean")
    assert [r.recorded for r in lifecycle.admissions_recorded(rows, "k", ["o"], ["v"], F.col("f")).orderBy("o").collect()] == [True, False, True, True, False]
    stored, config = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, None), (4, "d"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in lifecycle.import_rows(stored, config, "k", ["v"]).collect()) == [(1, "a", True, "kept"), (2, "b", True, "kept"), (3, "z", True, "changed"), (4, "d", True, "added")]


def test_price_reaction_and_move_targets(spark):
    say = lambda t: spark.range(1).select(market.freshness(F.lit(T0), F.lit(t)).alias("f")).first().f
    assert say("3月1日，股价大跌后收于 5.5%") == ("stale_or_rehash", dt.date(2024, 3, 1), dt.date(2024, 3, 1), 9, True)
    assert not say("3月1日 nothing").reacted and not say("股价跌 5%").reacted and not say("2024年3月9日 股价" + "x" * 21 + "5%").reacted and say("2024年3月9日 股价").status == "possibly_stale"
    kind = "i int, hits array<struct<rule_id:string,related_targets:array<struct<name:string,code:string>>>>, ev array<struct<rule_family:string,matched_subjects:array<string>>>"
    rows = [
        (1, [("other", [("No", "1")]), ("r", [(None, ""), (" A-B ", "x"), ("C", "y")])], [("holding", ["H"])]), (2, [("r", [(" ", "600.SH")])], None), (3, [("r", None)], [("macro", ["M"]), ("holding", [" - ", "持仓 K"])]), (4, None, None), (5, [("other", [("No", "1")])], []),
    ]
    got = {r.i: r.t for r in spark.createDataFrame(rows, kind).select("i", market.move_target(F.col("hits"), F.col("ev"), ["r"]).alias("t")).collect()}
    assert got == {1: "ab", 2: "600.sh", 3: "持仓k", 4: "", 5: ""}


def test_window_of_a_bank_and_a_role(spark):
    text = "The Fed met. Chair Lee of the Fed spoke. Rates rise soon. Risks remain. Mr Lee left."
    df = spark.createDataFrame([(1, text), (2, "The Fed met. Rates rise. Risks remain."), (3, None)], "k int, t string")
    found = admission.sentence_window(df, "k", "t", ["fed"], ["left"], [["rates"], ["risks"], ["growth"]], also=[["chair", "governor"]]).collect()
    assert [(r.k, r.n_signals) for r in found] == [(1, 2)]  # full stops do not part sentences there
    lines = spark.createDataFrame([(1, text.replace(". ", ".\n")), (2, "The Fed met.\nRates rise.\nRisks remain.")], "k int, t string")
    found = admission.sentence_window(lines, "k", "t", ["fed"], ["left"], [["rates"], ["risks"], ["growth"]], also=[["chair", "governor"]]).collect()
    assert [(r.k, r["index"], r.n_signals) for r in found] == [(1, 1, 2)]
    assert len(admission.sentence_window(lines, "k", "t", ["fed"], ["left"], [["rates"], ["risks"], ["growth"]]).collect()) == 2
