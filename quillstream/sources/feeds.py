"""Scans: feeds, link lists, sitemaps and JSON arrays as DataFrames of one document a row.

A document is a row (id and text), however it was fetched; parsing is JVM-side (xpath, regular
expressions, from_json), so a scan is a narrow pass and an explode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import times, web
from quillstream.functions.text import collapse, first_non_empty, text_of

#: Names under which a JSON document may hold its list, in order.
LIST_NAMES = ("data", "list", "items", "result")


def _tag(block: Column, names: Sequence[str]) -> Column:
    """The first value of the tags named; namespaces, attributes and CDATA do not matter."""
    found = []
    for name in names:
        raw = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1)
        found.append(F.nullif(F.trim(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit("")))
    return F.coalesce(*found, F.lit(""))


def _blocks(text: Column, names: Sequence[str]) -> Column:
    choice = "|".join(names)
    return F.regexp_extract_all(text_of(text), F.lit(rf"(?is)<(?:\w+:)?({choice})(?:\s[^>]*)?>.*?</(?:\w+:)?\1>"), 0)


def feed_items(documents: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """RSS, RDF or Atom entries: (source_item_id, title, url, summary, published_raw, published_ts) after ``keep``.

    The id is the entry's own, else its link, else its title; entries without any are dropped.
    """
    rows = documents.select(*keep, F.posexplode(_blocks(F.col(text), ("item", "entry"))).alias("place", "b"))
    b = F.col("b")
    link = first_non_empty(_tag(b, ("link",)), F.regexp_extract(b, r"""(?is)<link[^>]*href=["']([^"']*)["']""", 1))
    title = collapse(web.unescape(_tag(b, ("title",))))
    published = _tag(b, ("pubDate", "published", "updated", "date"))
    made = rows.select(
        *keep, "place", first_non_empty(_tag(b, ("id", "guid")), link, title).alias("source_item_id"), title.alias("title"), link.alias("url"),
        web.strip_tags(web.unescape(_tag(b, ("description", "summary", "encoded")))).alias("summary"), published.alias("published_raw"), times.parse_time(published).alias("published_ts"),
    )
    return made.where("source_item_id <> ''")


def sitemap_items(documents: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Sitemap entries: (url, published_raw, published_ts, title) after ``keep``; of equal urls of a document the first."""
    rows = documents.select(*keep, F.posexplode(_blocks(F.col(text), ("url",))).alias("place", "b"))
    b = F.col("b")
    published = _tag(b, ("publication_date", "lastmod"))
    made = rows.select(*keep, "place", _tag(b, ("loc",)).alias("url"), collapse(_tag(b, ("title",))).alias("title"), published.alias("published_raw"), times.parse_time(published).alias("published_ts"))
    firsts = made.where("url <> ''").groupBy(*keep, "url").agg(F.min_by(F.struct("place", "title", "published_raw", "published_ts"), "place").alias("r"))
    return firsts.select(*keep, "url", "r.place", "r.title", "r.published_raw", "r.published_ts")


def within_hours(items: DataFrame, at: str, now: Column, hours: int = 72) -> DataFrame:
    """Items published at most ``hours`` before ``now``; items without a time are kept apart by the caller."""
    return items.where(F.col(at) >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def link_items(documents: DataFrame, html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """Anchors of pages: (href, label, place) after ``keep``, of equal hrefs the first."""
    rows = documents.select(*keep, F.posexplode(web.links(F.col(html))).alias("place", "a"))
    return rows.select(*keep, "place", "a.href", "a.label")


def json_items(documents: DataFrame, element: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Elements of a JSON array, or of the first list under data, list, items or result, as ``element`` structs."""
    raw = F.trim(text_of(F.col(text)))
    paths = [F.when(raw.startswith("["), raw)]
    for name in LIST_NAMES:
        inner = F.get_json_object(raw, f"$.{name}")
        paths.append(F.when(inner.startswith("["), inner))
        paths += [F.when(inner.startswith("{") & F.get_json_object(inner, f"$.{n}").startswith("["), F.get_json_object(inner, f"$.{n}")) for n in LIST_NAMES]
    listed = F.from_json(F.coalesce(*paths), f"array<{element}>")
    return documents.select(*keep, F.explode(listed).alias("r")).select(*keep, "r.*")


def embedded_json(html: Column, script_id: str, path: str) -> Column:
    """A value inside the JSON of a script element of a page."""
    raw = F.regexp_extract(text_of(html), rf"""(?is)<script[^>]+id=["']{script_id}["'][^>]*>(.*?)</script>""", 1)
    return F.get_json_object(raw, path)


def signed_query(params: dict[str, str]) -> Column:
    """MD5 of the SHA-1 of the sorted query, as signed list services want it."""
    return F.md5(F.sha1(F.lit("&".join(f"{k}={params[k]}" for k in sorted(params)))))


def page_state(html: Column) -> Column:
    """waf, login, empty or ok: what a fetched page is."""
    low = F.lower(text_of(html))
    return (
        F.when(low.rlike("captcha|access denied|verify you are human"), "waf").when(low.rlike("please log ?in|sign in to continue"), "login")
        .when(F.length(web.strip_tags(html, blocks=True)) < 20, "empty").otherwise("ok")
    )
