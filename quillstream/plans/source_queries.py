"""Scans and small text rules over documents that Spark makes of the tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import times, web
from quillstream.operators import versions
from quillstream.plans.event_queries import _events
from quillstream.session import table
from quillstream.sources import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    "feed_entries",
    """WITH p AS (SELECT page_id AS k, url FROM pages), e AS (SELECT k, 0 AS n, 'g' || k AS id, 'A & ' || k AS title, 'http://x/' || k AS url, 'Body ' || k AS summary, TIMESTAMP '2024-01-01 10:00:00' + INTERVAL (k % 50) MINUTE AS t FROM p WHERE k % 2 = 0
        UNION ALL SELECT k, 1, 'http://y/' || k, 'B', 'http://y/' || k, '', NULL FROM p WHERE k % 2 = 0 UNION ALL SELECT k, 0, 'e' || k, 'T ' || k, 'http://z/' || k, 'S', TIMESTAMP '2024-01-02 00:00:00' + INTERVAL (k % 50) SECOND FROM p WHERE k % 2 = 1)
    SELECT k AS page_id, id AS source_item_id, title, url, summary, epoch_us(t)::BIGINT AS published FROM e""",
)
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of two formats: RSS with two entries and one without any id, and Atom."""
    k = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1704103200) + (k % 50) * 60)
    rss = _text(
        "<rss><channel><item><title>A &amp; ", k, "</title><link>http://x/", k, '</link><guid isPermaLink="false">g', k, "</guid><pubDate>", F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), " GMT</pubDate><description><![CDATA[<p>Body ", k, "</p>]]></description></item>",
        "<item><title>B</title><link>http://y/", k, "</link></item><item><description>nothing</description></item></channel></rss>",
    )
    atom = _text('<feed xmlns="a"><entry><id>e', k, "</id><title>T  ", k, '</title><link rel="alternate" href="http://z/', k, '"/><updated>2024-01-02T00:00:', F.lpad((k % 50).cast("string"), 2, "0"), "Z</updated><summary>S</summary></entry></feed>")
    docs = table(spark, sf_dir, "pages").select("page_id", F.when(k % 2 == 0, rss).otherwise(atom).alias("text"))
    found = feeds.feed_items(docs, keep=["page_id"])
    return found.select("page_id", "source_item_id", "title", "url", "summary", F.unix_micros("published_ts").alias("published"))


@query(
    "sitemap_entries",
    """SELECT page_id, url, 'N ' || page_id AS title, epoch_us(TIMESTAMP '2024-03-01 00:00:00' + INTERVAL (page_id % 28) DAY - INTERVAL 8 HOUR)::BIGINT AS published FROM pages UNION ALL SELECT page_id, 'http://twice/' || page_id, 'first', NULL FROM pages""",
)
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps with namespaces, news fields, and an address that is told twice."""
    k = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd")
    doc = _text(
        '<urlset xmlns="x"><url><loc> ', F.col("url"), " </loc><n:news><n:publication_date>", day, "</n:publication_date><n:title>N  ", k, "</n:title></n:news></url>",
        "<url><loc>http://twice/", k, "</loc><title>first</title></url><url><loc>http://twice/", k, "</loc><title>second</title></url><url><lastmod>2024-01-01</lastmod></url></urlset>",
    )
    found = feeds.sitemap_items(table(spark, sf_dir, "pages").select("page_id", doc.alias("text")), keep=["page_id"])
    return found.select("page_id", "url", "title", F.unix_micros("published_ts").alias("published"))


@query(
    "json_list_items",
    """SELECT user_id, event_id AS id, event_type AS kind FROM events WHERE user_id % 4 < 3""",
)
def json_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as a JSON list, alone, under ``data`` and under ``data.list``; broken ones give nothing."""
    listed = F.to_json(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))))
    docs = _events(spark, sf_dir).groupBy("user_id").agg(listed.alias("l"))
    shape = F.col("user_id") % 4
    text = F.when(shape == 0, F.col("l")).when(shape == 1, _text('{"data": ', F.col("l"), "}")).when(shape == 2, _text('{"code": 0, "data": {"list": ', F.col("l"), "}}")).otherwise(F.expr("left(l, length(l) - 1)"))
    return feeds.json_items(docs.select("user_id", text.alias("text")), "struct<id:bigint,kind:string>", keep=["user_id"])


@query(
    "embedded_page_json",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'v' || page_id END AS value, page_id % 2 = 0 AS has_links FROM pages""",
)
def embedded_page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    script = F.when(k % 3 == 0, "").otherwise(_text('<script type="x" id="__DATA__">{"props": {"page": {"name": "v', k, '"}}}</script>'))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(script, F.when(k % 2 == 0, F.col("html")).otherwise("")).alias("h"))
    return rows.select("page_id", feeds.embedded_json(F.col("h"), "__DATA__", "$.props.page.name").alias("value"), (F.size(web.links(F.col("h"))) > 0).alias("has_links"))


@query(
    "parsed_times",
    """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 3 THEN epoch_us(date_trunc('second', ts) - INTERVAL 8 HOUR) WHEN 4 THEN epoch_us(date_trunc('day', ts) - INTERVAL 8 HOUR) WHEN 1 THEN epoch_us(date_trunc('millisecond', ts)) ELSE epoch_us(date_trunc('second', ts)) END::BIGINT AS micros FROM events""",
)
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, milliseconds, mail dates, local ISO times and days, and what is no time."""
    ts, k = F.col("ts"), F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.floor(F.unix_micros(ts) / 1_000_000).cast("string")).when(k == 1, F.floor(F.unix_micros(ts) / 1000).cast("string")).when(k == 2, _text(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), " +0000"))
        .when(k == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 4, F.date_format(ts, " yyyy-MM-dd ")).otherwise("soon")
    )
    return _events(spark, sf_dir).select("event_id", F.unix_micros(times.parse_time(raw)).alias("micros"))


@query(
    "distinct_word_lists",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(left(coalesce(text, ''), 400)), '[\s\p{Z}]+', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS exact, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ' ') AS folded, CASE WHEN lower(l[1]) IN ('the', 'la', 'das') THEN lower(l[1]) ELSE 'other' END AS first_word FROM w""",
)
def distinct_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a text's first 400 characters, each once as written, each once whatever its case, and the first of three known ones."""
    words = F.split(T.collapse(F.substring(T.text_of(F.col("text")), 1, 400)), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.array_join(T.distinct_texts(F.col("w")), " ").alias("exact"), F.array_join(T.distinct_ignoring_case(F.col("w")), " ").alias("folded"), T.one_of(F.get("w", F.lit(0)), ("the", "la", "das"), "other").alias("first_word"))


@query(
    "alias_matches",
    r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '(^|[^a-z0-9])of\s+the([^a-z0-9]|$)') AS spaced, regexp_matches(t, '(^|[^a-z0-9])2\.0([^a-z0-9]|$)') AS number, contains(t, 'é') AS accented, contains(t, 'thion') OR contains(t, 'queand') OR contains(t, 'é la') AS any_of FROM d""",
)
def alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.contains_alias(x, "Of The").alias("spaced"), T.contains_alias(x, "2.0").alias("number"), T.contains_alias(x, "É").alias("accented"), T.contains_any(x, ("Thion", "queand", "é la")).alias("any_of")
    )


@query(
    "paragraph_chunks",
    r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n+'), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS l FROM documents),
    s AS (SELECT doc_id, l, 0 AS i, 0 AS n, 0 AS open FROM p UNION ALL
        SELECT doc_id, l, i + 1, n + (CASE WHEN open = 0 OR open + 1 + length(l[i + 1]) > 1300 THEN 1 ELSE 0 END), CASE WHEN open = 0 OR open + 1 + length(l[i + 1]) > 1300 THEN length(l[i + 1]) ELSE open + 1 + length(l[i + 1]) END FROM s WHERE i < len(l))
    SELECT doc_id, n::INT AS n_chunks, open::INT AS last_chars FROM s WHERE i = len(l)""",
)
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts packed into chunks of at most 1,300 characters, and the length of the last one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.paragraph_chunks(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("c").alias("n_chunks"), F.coalesce(F.length(F.try_element_at("c", F.lit(-1))), F.lit(0)).alias("last_chars"))


@query("first_rows", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.keep_first(_events(spark, sf_dir), ["user_id", "event_type"], [F.desc("value"), "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "block_text",
    r"""SELECT page_id, 'Top ' || page_id || E'\nleft & right\none\ntwo\nend' AS body FROM pages""",
)
def block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup with scripts, blocks and breaks as lines; the page's own markup stands in an unseen element."""
    own = F.regexp_replace("html", "(?i)noscript", "x")
    doc = _text("<h1> Top  ", F.col("page_id"), "</h1><noscript>", own, "</noscript><style>p{}</style><div>left &amp; <b>right</b></div><ul><li>one</li><li>two<br></li></ul><p>end</p>")
    return table(spark, sf_dir, "pages").select("page_id", web.clean_lines(web.strip_tags(doc, blocks=True)).alias("body"))
