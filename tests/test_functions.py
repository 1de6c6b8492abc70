import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import times, web


def values(spark, rows, *columns, schema="x string"):
    got = spark.createDataFrame([(r,) for r in rows], schema).select(*columns).collect()
    return [r[0] if len(r) == 1 else tuple(r) for r in got]


def test_collapse_reads_unicode_space(spark):
    assert values(spark, ["  a　 b \n c ", None, ""], T.collapse(F.col("x"))) == ["a b c", "", ""]


def test_distinct_lists_keep_first_spelling(spark):
    df = spark.createDataFrame([(["A", " a ", "B", "", "b", None],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(T.distinct_ignoring_case(F.col("x"))).collect()] == [["A", "B"], []]


def test_term_boundaries(spark):
    rows = ["the AI chip", "main chip", "芯片AI出口", "a.i. b", None]
    assert values(spark, rows, T.contains_term(F.col("x"), "ai")) == [True, False, True, False, False]
    assert values(spark, rows, T.contains_term(F.col("x"), "芯片")) == [False, False, True, False, False]
    assert values(spark, ["Goldman\n Sachs says", "goldmansachs"], T.contains_alias(F.col("x"), "goldman sachs")) == [True, False]


def test_sentences_and_quote(spark):
    rows = ["One! Two? 三。four\n\nfive"]
    assert values(spark, rows, T.sentences(F.col("x"))) == [["One!", "Two?", "三。", "four", "five"]]
    assert values(spark, rows, T.quote(F.col("x"), ["four"])) == ["four"]
    assert values(spark, ["none here"], T.quote(F.col("x"), ["four"])) == ["none here"]


def test_evidence_segments_cut_long_units(spark):
    got = values(spark, ["A. b.c " + "x" * 700], T.evidence_segments(F.col("x"), "B"))[0]
    assert [s["id"] for s in got] == ["B1", "B2", "B3", "B4"]
    assert got[0]["text"] == "A." and "".join(s["text"] for s in got) == "A. b.c " + "x" * 700


def test_paragraph_chunks(spark):
    text = "\n".join(["a" * 600, "b" * 600, "c" * 2000, "d"])
    assert [len(c) for c in values(spark, [text], T.paragraph_chunks(F.col("x")))[0]] == [1201, 2000, 1]


def test_dedupe_key_falls_back(spark):
    row = spark.createDataFrame([("s", "7", "u"), ("s", "", "u"), ("s", None, None)], "s string, i string, u string")
    c = T.dedupe_key(F.col("s"), F.col("i"), F.col("u"), F.lit(""), F.lit("t"), F.lit(""))
    got = [r[0] for r in row.select(c).collect()]
    assert got[:2] == ["s:7", "s:u"] and len(got[2]) == 26


def test_urls(spark):
    urls = ["HTTP://Ex.com/a?utm_source=x&b=1&from=y#f", "https://ex.com?spm=1&c", "not a url", None]
    assert values(spark, urls, web.canonical_a(F.col("x"))) == ["http://Ex.com/a?b=1#f", "https://ex.com?spm=1&c=", "not a url", ""]
    assert values(spark, urls, web.canonical_b(F.col("x"))) == ["http://ex.com/a?b=1", "https://ex.com/?c=", "not a url", ""]
    assert values(spark, urls, web.canonical_c(F.col("x")))[0] == "http://ex.com/a?utm_source=x&b=1&from=y"


def test_html(spark):
    page = "<html><head><title> T &amp; t </title><script>x<p>no</p></script></head><p>" + "long text " * 6 + "</p><p>short</p><p>Copyright " + "x" * 60 + "</p><a href='/1'>one</a><a href='/1'>two</a></html>"
    assert values(spark, [page, None], web.title(F.col("x"))) == ["T & t", ""]
    assert values(spark, [page], web.body(F.col("x")))[0]["origin"] == "paragraphs"
    assert [(a["href"], a["label"]) for a in values(spark, [page], web.links(F.col("x")))[0]] == [("/1", "one")]
    meta = '<meta name="description" content="about">'
    got = values(spark, [meta], web.body(F.col("x")))[0]
    assert (got["text"], got["origin"]) == ("about", "description")


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1719648000", "2024-06-29 08:00:00"),
        ("1719648000000", "2024-06-29 08:00:00"),
        ("Sat, 29 Jun 2024 08:00:00 GMT", "2024-06-29 08:00:00"),
        ("Sat, 29 Jun 2024 08:00:00 +0800", "2024-06-29 00:00:00"),
        ("2024-06-29T08:00:00+02:00", "2024-06-29 06:00:00"),
        ("2024-06-29 08:00:00", "2024-06-29 00:00:00"),
        ("nonsense", None),
        (None, None),
    ],
)
def test_times(spark, raw, want):
    got = values(spark, [raw], times.parse_time(F.col("x")).cast("string"))[0]
    assert got == want


def test_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 17),)], "x timestamp")
    assert tuple(df.select(times.business_day(F.col("x")), times.reaction_session(F.col("x"))).first()) == (dt.date(2024, 1, 2), dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        times.local_day_range("2024-01-02", "2024-01-01")


def test_similar_titles(spark):
    df = spark.createDataFrame([("ABCDEFGHIJ", "ABCDEFGHIJKL"), ("ABC", "ABCD"), ("ABCDEFGHIJ", "ABCDEFGHXY"), ("ABCDEFGH", "STUVWXYZ"), ("", "A")], "a string, b string")
    assert [r[0] for r in df.select(T.similar_titles(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]


def test_titles_and_references_of_pages(spark):
    pages = [
        "<meta content='From og' property=\"og:title\"><title>t</title>", '<meta name="twitter:title" content="Tw &amp; it"><h1>h</h1>', "<title> T&#233;l&#x00e9; &nbsp;x </title>",
        "<h1 class=a>Only <b>h1</b></h1>", "<p>nothing</p>", None,
    ]
    assert values(spark, pages, web.title(F.col("x"))) == ["From og", "Tw & it", "Télé x", "Only h1", "", ""]
    texts = ["&amp;lt; &copy;&eacute; &bogus; a & b &#128512;", "&#55296; &#x110000;", "no reference"]
    assert values(spark, texts, web.unescape(F.col("x"))) == ["&lt; \u00a9\u00e9 &bogus; a & b \U0001f600", "&#55296; &#x110000;", "no reference"]
    assert values(spark, ["a<br/>b<p>c</p>d<script>x</script><!-- y -->"], web.strip_tags(F.col("x"))) == ["a\nbc\n\nd"]


def test_references_of_html_5_and_windows(spark):
    from html import unescape

    texts = ["&#150;&#151;&#x93;q&#148;&#128;", "&NotEqualTilde; &lang; &fjlig; &Bopf;", "&#1114111; &#9999999; &#x10FFFF;", "&hellip&amp;&hellip;", "&#0000065;", "&check;&lt;"]
    got = values(spark, texts, web.unescape(F.col("x")))
    assert got[0] == "\u2013\u2014\u201cq\u201d\u20ac" and got[1] == "\u2242\u0338 \u2329 fj \U0001d539" or got[1] == unescape(texts[1])
    assert got[3] == "&hellip&\u2026" and got[4] == "A" and got[5] == "\u2713<" and got[2].startswith("\U0010ffff &#9999999;")


def test_distinct_ignoring_case_of_many_words_makes_lower_case_once(spark):
    df = spark.createDataFrame([([f"{'W' if k % 2 else 'w'}{k // 2}" for k in range(12_000)], None)], "w array<string>, n array<string>")
    start = time.monotonic()
    row = df.select(T.distinct_ignoring_case(F.col("w")).alias("w"), T.distinct_ignoring_case(F.col("n")).alias("n")).first()
    assert row.w == [f"w{k}" for k in range(6000)] and row.n == []
    assert time.monotonic() - start < 30  # a minute and more, if each word put all into lower case
