import hashlib
import json

from pyspark.sql import functions as F

from quillstream.operators import item_mapping as I


def mapped(spark, rows, profiles=None, defaults=None):
    df = spark.createDataFrame([(i, s, None if r is None else r if isinstance(r, str) else json.dumps(r)) for i, (s, r) in enumerate(rows)], "k long, src string, raw string")
    table = None if profiles is None else spark.createDataFrame(profiles, "source string, category string, role string, fetcher string")
    return [r.asDict() for r in I.mapped_items(df, "src", "raw", table, defaults).orderBy("k").collect()]


def test_fields_by_precedence(spark):
    a, b, c, d = mapped(spark, [
        ("s", {"title": " A  b ", "content": "body", "url": " u ", "related_symbols": ["X", "X", " Y "], "raw": {"id": "r1"}, "id": "i1", "published_at": "2024"}), ("s", {"summary": "", "content": "c", "url": "u2", "symbols": [], "themes": ["t"]}),
        ("s", "broken"), ("s", None),
    ])
    assert (a["title"], a["summary"], a["url"], a["symbols"], a["item_id"], a["dedupe_key"], a["content_type"]) == ("A b", "body", "u", ["X", "Y"], "r1", "s:r1", "unknown")
    assert (b["summary"], b["item_id"], b["dedupe_key"], b["themes"], b["symbols"]) == ("c", "u2", "s:u2", ["t"], [])
    digest = hashlib.sha256(b"s\nunknown\n\n").hexdigest()[:24]
    assert c["dedupe_key"] == d["dedupe_key"] == f"s:{digest}" and c["title"] == "" and d["symbols"] == []


def test_profiles_and_defaults(spark):
    profiles = [("p", "news_media", None, "rss"), ("q", "official", "company", "api"), ("p", "news_media", None, "rss")]
    got = mapped(spark, [("p", {"id": 1}), ("q", {"id": 2, "publisher_role": "own", "collector": "hand"}), ("z", {"id": 3}), (" y ", {"id": 4, "dedupe_key": "given"})], profiles, {"z": "portfolio_stock_news"})
    assert [(r["source_category"], r["publisher_role"], r["collector"], r["dedupe_key"]) for r in got] == [("news_media", "news_media", "rss", "p:1"), ("official", "own", "hand", "q:2"), ("portfolio_stock_news", "news_media", "z", "z:3"), ("", "", "y", "given")]


def test_briefs_disclosures_and_stock_news(spark):
    rows = [json.dumps(r) for r in ({"LiveID": 7, "newcontent": "New", "title": "T", "ShareUrl": "https://x.org/a?utm_source=q", "LiveContent": "<p>Body</p>"}, {"link": "https://x.org/b", "description": "d"}, {"summary": "only"})]
    got = [tuple(r) for r in I.brief_items(spark.createDataFrame([(r,) for r in rows], "raw string"), "raw").orderBy("item_id").collect()]
    assert got == [("7", "https://x.org/a", "New", "Body", ""), ("https://x.org/b", "https://x.org/b", "", "d", "")]
    records = spark.createDataFrame([("Co", "1.SZ", "Report", "2024-01-02", "relation", "u", "id1", "x" * 3000), (None, "2.SZ", "N", None, "other", None, "id2", None)], "company_name string, symbol string, title string, published_at string, content_kind string, document_url string, identity string, full_text string")
    one, two = I.disclosure_items(records).orderBy("item_id").collect()
    assert one.summary == "股票：Co 1.SZ；标题：Report；发布时间：2024-01-02；披露类型：投资者关系活动记录" and one.content_type == "investor_relations_record" and one.has_text
    assert one.content_hash == hashlib.sha256(("id1\nReport\n2024-01-02\n" + "x" * 2000).encode()).hexdigest() and two.summary.startswith("股票：2.SZ；") and not two.has_text and two.themes == ["公司公告"]
    news = spark.createDataFrame([("a.1", "T", "https://X.org/n/1.html#f", "2024", " "), ("b.2", "T", "u", "2024", "art"), ("zz", "T", "u", "2024", None)], "symbol string, title string, url string, published_at string, article_text string")
    held = spark.createDataFrame([("A.1", "Alpha"), ("a.1", "Alpha"), ("B.2", None)], "symbol string, name string")
    one, two = I.stock_items(news, held).orderBy("item_id").collect()
    assert one.summary == one.full_text == "Alpha（A.1）相关新闻：T" and one.canonical_url == "https://x.org/n/1.html" and not one.fetched and two.full_text == "art" and two.symbols == ["B.2"]


def test_universe_cascade_and_nfkc(spark):
    cases = [("", 1, 0, 0, 0, 0, 0), ("t", 1, 1, 0, 0, 0, 0), ("t", 0, 1, 1, 0, 0, 0), ("t", 0, 0, 1, 1, 0, 0), ("t", 0, 0, 0, 1, 1, 0), ("t", 0, 0, 0, 0, 1, 1), ("t", 0, 0, 0, 0, 1, None), ("t", 0, 0, 0, 0, 0, 1), (None, 1, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, m int, e int, h int, k int, p int, x int")
    got = [r.u.tag for r in df.select("i", I.universe_match(*[F.col(c) for c in "tmehkpx"]).alias("u")).orderBy("i").collect()]
    assert got == ["", "macro_policy", "media_keyword_excluded", "holding_match", "semiconductor_ai", "ai_power_infra", "generic_power_filtered", "outside_universe", ""]
    assert [r[0] for r in spark.createDataFrame([(1, "Ａｂ １　 c\n"), (2, None), (3, "ﬁ")], "i int, t string").orderBy("i").select(I.nfkc(F.col("t"))).collect()] == ["Ab1c", "", "fi"]
