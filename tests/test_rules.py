"""Small rules on nulls, empty texts and the cases that their queries do not reach."""

from pyspark.sql import functions as F

from quillstream.functions import rules as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_nulls_and_empty_texts_have_a_result(spark):
    none = F.lit(None).cast("string")
    names = F.lit(None).cast("array<string>")
    row = spark.range(1).select(
        U.article_id(none).alias("article"), U.relevance(none, "600000", ("A",), (), ()).alias("relevance"), U.announcement_like(none, ("A",), ("B",)).alias("announcement"),
        U.generated(none).alias("generated"), U.post_link_kind(none).alias("kind"), U.stream_error(none, F.lit(None).cast("int")).alias("error"), U.article_url((none,), none, "a", "b").alias("url"),
        U.context_line((("x", names),)).alias("line"), U.post_item(none, none, none, none, none, names).alias("post"), U.shortened(none, 10).alias("card"),
    ).first()
    assert (row.article, row.kind, row.url, row.line, row.card) == ("", "", "", "", "")
    assert tuple(row.relevance) == (False, "needs_llm_relevance") and tuple(row.error) == ("stream_error", False)
    assert row.announcement is False and row.generated is False and row.post is None


def test_disclosure_without_id_and_number_is_known_by_its_words(spark):
    key = lambda title: one(spark, U.disclosure_identity(F.lit(" "), F.lit("https://a.example/x9.pdf"), F.lit("a"), F.lit(title), F.lit("t")))
    assert key("The  Report") == key("the report ") != key("the reports")
    assert key("x").startswith("disclosure:") and len(key("x")) == len("disclosure:") + 32


def test_an_excluding_word_counts_only_without_a_direct_mention(spark):
    told = lambda title: one(spark, U.relevance(F.lit(title), "600000", ("Ａ Co",), ("chips",), ("spam",)))["reason"]
    assert told("spam about 600000") == "direct_mention" and told("spam chips") == "excluded_keyword" and told("new chips") == "business_keyword"


def test_a_link_that_fails_says_so_and_long_texts_are_cut(spark):
    link = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in (("url", "u"), ("title", None), ("description", "d"), ("text", "t" * 50), ("status", None), ("error", "gone"))])
    assert one(spark, U.link_summary(F.array(link), per_link=10)) == "链接 1: u\n描述：d\n正文摘录：ttttttt...\n抓取状态：unknown；gone"
    assert len(one(spark, U.link_summary(F.array(link, link), total=30))) == 30


def test_quoted_texts_follow_a_post_once(spark):
    post = one(spark, U.post_item(F.lit("https://x.com/a/status/12?s=1"), F.lit(""), F.lit(" own  text "), F.lit("@@me"), F.lit(None).cast("string"), F.array(F.lit("q"), F.lit(" q "), F.lit(""))))
    assert tuple(post) == ("12", "@me", "own text\n\n引用推文：q", "own text\n\n引用推文：q")


def test_card_marks_are_escaped(spark):
    assert one(spark, U.card_escape(F.lit("a*b_c\\d"))) == "a\\*b\\_c\\\\d"


def test_an_exception_stops_a_transmission(spark):
    tell = lambda text: one(spark, U.transmission(F.lit(text), F.lit("easing"), ("gold",), ("cuts.{0,20}boost",), (("move", r"\bfell\b"),)))
    assert tell("Cuts may boost Gold").matched and not tell("cuts boost gold; it fell").matched
    assert tell("cuts boost gold; it fell").exceptions == ["move"] and not tell("cuts boost tin").matched
