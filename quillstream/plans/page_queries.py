"""Items of pages and spans of texts, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import records as R
from quillstream.session import table
from quillstream.sources import details as D
from quillstream.sources import pages as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query(
    "page_list_rows",
    r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1) AS rows, regexp_extract_all(html, '(?is)<li><a href="([^"]*)">', 1) AS hrefs FROM pages)
    SELECT page_id, len(rows)::INT AS n_rows, len(hrefs)::INT AS n_links, array_to_string(hrefs, '|') AS hrefs, array_to_string(list_transform(rows, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), '|') AS texts FROM r WHERE len(rows) > 0""",
)
def page_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.list_rows(table(spark, sf_dir, "pages"), ["page_id"]).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "text", "links"))).alias("r"))
    links = F.flatten(F.transform("r", lambda x: F.transform(x["links"], lambda a: a["href"])))
    return rows.select("page_id", F.size("r").alias("n_rows"), F.size(links).alias("n_links"), F.array_join(links, "|").alias("hrefs"), F.array_join(F.transform("r", lambda x: x["text"]), "|").alias("texts"))


@query(
    "page_dated_items",
    r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<li><a href="[^"]*">([^<]*)</a>', 1)) AS title, unnest(range(len(regexp_extract_all(html, '(?is)<li><a href="([^"]*)">', 1)))) AS k FROM pages),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id, trim(href, '/') ORDER BY k) AS n FROM a WHERE contains(href, 'e') AND title <> '')
    SELECT page_id, trim(href, '/') AS item_id, regexp_extract(url, '^https?://[^/?#]*') || href AS url, title, '2024-01-1' || page_id % 10 AS published FROM f WHERE n = 1""",
)
def page_dated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as one dated row around its own lists, which are nested in it."""
    html = F.concat(F.lit("<ul><li>2024-01-1"), (F.col("page_id") % 10).cast("string"), F.lit(" <ul>"), "html", F.lit("</ul></li></ul>"))
    return P.dated_list_items(table(spark, sf_dir, "pages").withColumn("html", html), ["page_id"], F.col("url"), "e")


@query(
    "page_anchor_items",
    r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a href="[^"]*">([^<]*)</a>', 1)) AS title, unnest(range(len(regexp_extract_all(html, '(?is)<a href="[^"]*">[^<]*</a>')))) AS k, regexp_extract(html, '(?is)<html lang="(..)"', 1) AS lang FROM pages),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id, trim(href, '/') ORDER BY k) AS n FROM a WHERE NOT contains(href, '.') AND length(title) >= 4 AND regexp_matches(href || ' ' || title, 't|r'))
    SELECT page_id, trim(href, '/') AS item_id, regexp_extract(url, '^https?://[^/?#]*') || href AS url, title, lang AS summary, '' AS published FROM f WHERE n = 1""",
)
def page_anchor_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = P.AnchorRule(r"^/[^.]*$", summaries=(r'(?is)<html lang="(..)"',), date=r"(20\d\d-\d\d-\d\d never)", before=1 << 30, after=0, least_title=4, must=r"/[^/]*[tr][^/]*$| .*[tr]")
    return P.anchor_items(table(spark, sf_dir, "pages"), ["page_id"], F.col("url"), rule)


@query(
    "jsonld_articles",
    r"""WITH p AS (SELECT page_id AS k, url FROM pages WHERE page_id % 6 <> 5)
    SELECT k AS page_id, CASE k % 6 WHEN 0 THEN 's/' || k ELSE trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') END AS item_id, CASE k % 6 WHEN 0 THEN 'https://x.org/s/' || k ELSE url END AS url,
        CASE k % 6 WHEN 0 THEN 'Direct ' || k WHEN 1 THEN 'Graph ' || k WHEN 2 THEN 'Entity ' || k WHEN 3 THEN 'Page ' || k ELSE 'Og ' || k END AS title, CASE k % 6 WHEN 0 THEN '2024-01-02' WHEN 4 THEN '2024-05-06' ELSE '' END AS published,
        CASE k % 6 WHEN 0 THEN 'Ann' ELSE '' END AS author, CASE k % 6 WHEN 0 THEN 'Pub' WHEN 1 THEN 'House' ELSE '' END AS publisher, CASE k % 6 WHEN 1 THEN 'Source' ELSE '' END AS based_on, CASE k % 6 WHEN 1 THEN 'https://s.org' ELSE '' END AS based_on_url FROM p""",
)
def jsonld_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their own bodies and JSON-LD of five shapes: direct, in a graph's list, after broken JSON in an entity, in a page's list, without a headline; and none."""
    k = F.col("page_id").cast("string")
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</script>"))
    shapes = [
        script('{"@type": "NewsArticle", "headline": "Direct ', k, '", "url": "https://x.org/s/', k, '", "datePublished": "2024-01-02", "author": {"name": " Ann "}, "publisher": "Pub"}'),
        script('{"@graph": [{"@type": "Organization"}, [{"@type": ["Thing", "Article"], "headline": "Graph ', k, '", "publisher": {"name": "House"}, "isBasedOn": {"name": "Source", "@id": "https://s.org"}}]]}'),
        F.concat(script('{"broken'), script('{"@type": "WebPage", "mainEntity": {"@type": "BlogPosting", "headline": "Entity ', k, '"}}')),
        script('[{"mainEntityOfPage": [{"@type": "article", "headline": "Page ', k, '"}]}, {"@type": "Article", "headline": "late"}]'),
        F.concat(script('{"@type": "Article", "headline": " "}'), F.lit('<meta property="og:title" content="Og '), k, F.lit('"><meta property="article:published_time" content="2024-05-06">')),
        F.lit(""),
    ]
    chosen = F.element_at(F.array(*shapes), (F.col("page_id") % 6 + 1).cast("int"))
    html = F.concat(chosen, F.regexp_replace("html", r"(?is)<title>.*?</title>", ""))
    found = P.jsonld_articles(table(spark, sf_dir, "pages").withColumn("html", html), ["page_id"])
    return found.select("page_id", "item_id", "url", "title", "published", "author", "publisher", "based_on", "based_on_url")


_SPANS = (r"[a-z]+ing", r"the [a-z]+ing", r"[a-z]+ing the", r"\d+(?:\.\d+)?", r"[a-z]+ \d+\.\d+")
_FOUND = ", ".join(f"{{'m': regexp_extract_all(t, '{p}'), 'g': regexp_split_to_array(t, '{p}')}}" for p in _SPANS)


@query(
    "quantified_spans",
    rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, unnest([{_FOUND}]) AS f FROM d),
    e AS (SELECT doc_id, f, unnest(range(1, len(f.m) + 1)) AS k FROM f), m AS (SELECT doc_id, f.m[k] AS v, (coalesce(list_sum(list_transform(f.g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f.m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, -length(v), v) AS n FROM m), r AS (SELECT *, coalesce(max(a + length(v)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM o),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM r WHERE a + length(v) > reach)
    SELECT doc_id, string_agg(v, '|' ORDER BY n) AS spans FROM s WHERE place <= 8 GROUP BY doc_id""",
)
def quantified_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", R.quantified_spans(F.col("text"), _SPANS).alias("s"))
    return rows.where(F.size("s") > 0).select("doc_id", F.array_join("s", "|").alias("spans"))


DETAIL = D.DetailRule(title_suffix=r"\s*[-|]\s*Site\s*$", body_start=r"""<div\b[^>]*\bid\s*=\s*["']artibody["'][^>]*>""", body_ends=("<!-- end -->",), dropped_starts=("Editor:",), dropped_words=("our APP",), cut_at=("Risk notice",))


@query(
    "page_details",
    r"""WITH p AS (SELECT page_id AS k, url, 'Paragraph ' || page_id || ' of a text that is long enough' AS one FROM pages)
    SELECT k AS page_id, 'Page ' || k AS title, CASE k % 4 WHEN 0 THEN '2024-01-02T00:00:00Z' WHEN 1 THEN '2024-02-03' WHEN 2 THEN '2024-01-02T03:04:05Z' ELSE '' END AS published, CASE WHEN k % 3 = 0 THEN 'Ann & Co' ELSE '' END AS author,
        CASE k % 5 WHEN 0 THEN one || E'\n\n' || one || ' too.' WHEN 1 THEN one || ' in a region' WHEN 2 THEN one || ' in an article, the longest element of the page' ELSE 'About ' || k END AS body, CASE k % 5 WHEN 0 THEN 'paragraphs' WHEN 1 THEN 'region' WHEN 2 THEN 'element' ELSE 'description' END AS origin FROM p""",
)
def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with heads and bodies of several shapes before their own markup, which is cut off by the end mark or left without elements."""
    k = F.col("page_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    one = text("Paragraph ", k, " of a text that is long enough")
    head = text('<meta property="og:title" content="Page ', k, ' - Site"><meta name="description" content="About ', k, '">')
    when = F.when(k % 4 == 0, '<meta content="2024-01-02T00:00:00Z" property="article:published_time">').when(k % 4 == 1, "<time class=x datetime='2024-02-03'>").when(k % 4 == 2, '{"display_time": 1704164645}').otherwise("")
    author = F.when(k % 3 == 0, '<meta name="author" content="Ann &amp; Co">').otherwise("")
    paragraphs = text("<div id='artibody' class=a><p>Editor: x</p><p>", one, "</p><script>'<p>no</p>'</script><p>get our APP</p><p>", one, " too. Risk notice and more</p><!-- end -->")
    region = text('<div class=a id="artibody">', one, " in a region<!-- end -->")
    article = text("<article><p>", one, " in an article, the longest element of the page</p></article>")
    own = F.regexp_replace("html", r"(?is)<(/?)(article|main|div|meta|time)\b", "<$1x-$2")
    body = F.when(k % 5 == 0, F.concat(paragraphs, own)).when(k % 5 == 1, F.concat(region, own)).when(k % 5 == 2, F.concat(article, own)).otherwise(own)
    found = D.details(table(spark, sf_dir, "pages").withColumn("html", F.concat(head, when, author, body)), DETAIL)
    return found.select("page_id", "detail.title", "detail.published", "detail.author", "detail.body", "detail.origin")
