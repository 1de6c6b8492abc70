from pyspark.sql import functions as F

from quillstream.sources import feeds

RSS = """<rss><channel><item><title>A &amp;amp; b</title><link>http://x/1</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description><![CDATA[<p>Body</p>]]></description></item>
<item><title>No id</title></item><item><description>nothing</description></item></channel></rss>"""
ATOM = """<feed><entry><id>e1</id><title>T</title><link rel="alternate" href="http://x/2"/><updated>2024-01-02T00:00:00Z</updated><summary>S</summary></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", None)], "src string, text string")
    got = {r.source_item_id: r for r in feeds.feed_items(df, keep=["src"]).collect()}
    assert set(got) == {"g1", "No id", "e1"}
    assert (got["g1"].summary, got["g1"].url, str(got["g1"].published_ts)) == ("Body", "http://x/1", "2024-01-01 10:00:00")
    assert (got["e1"].url, got["e1"].src) == ("http://x/2", "a")


def test_sitemap_links_and_json(spark):
    xml = "<urlset><url><loc>u1</loc><lastmod>2024-01-01T00:00:00Z</lastmod></url><url><loc>u1</loc></url><url><n:loc>u2</n:loc></url></urlset>"
    df = spark.createDataFrame([(xml,)], "text string")
    assert sorted(r.url for r in feeds.sitemap_items(df).collect()) == ["u1", "u2"]
    pages = spark.createDataFrame([("<a href='/a'>A</a> <a class=x href=\"/b\">B</a>",)], "html string")
    assert [(r.href, r.label) for r in feeds.link_items(pages).orderBy("place").collect()] == [("/a", "A"), ("/b", "B")]
    docs = spark.createDataFrame([('[{"id": 1}]',), ('{"data": {"list": [{"id": 2}, {"id": 3}]}}',), ("{}",), ("broken",), (None,)], "text string")
    assert sorted(r.id for r in feeds.json_items(docs, "struct<id:int>").collect()) == [1, 2, 3]


def test_small_sources(spark):
    row = spark.createDataFrame([('<script id="S">{"a": {"b": 7}}</script>',)], "h string")
    assert row.select(feeds.embedded_json(F.col("h"), "S", "$.a.b")).first()[0] == "7"
    assert row.select(feeds.page_state(F.lit("Access Denied"))).first()[0] == "waf"
    assert len(row.select(feeds.signed_query({"b": "2", "a": "1"})).first()[0]) == 32
