"""Detail pages: title, time, author and body of an article's own page, by precedence.

All are column functions of the markup. Defined results: null pages have empty fields; a field without a source is
empty; a body is cut at the rule's marks and lengths, and is the description where it is too short.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import times, web
from quillstream.functions.text import collapse, first_non_empty, strip, text_of

_UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


@dataclass(frozen=True)
class DetailRule:
    """How a site writes its pages: what its titles end in, names of its times, where a body begins and ends, and what of it is no text."""

    title_suffix: str = ""
    time_names: tuple[str, ...] = ("article:published_time", "og:published_time")
    author_names: tuple[str, ...] = ("author", "article:author")
    epoch_name: str = "display_time"
    body_start: str = ""
    body_ends: tuple[str, ...] = ()
    dropped_starts: tuple[str, ...] = ()
    dropped_words: tuple[str, ...] = ()
    cut_at: tuple[str, ...] = ()
    least_body: int = 20
    most_body: int = 40_000


def title(html: Column, rule: DetailRule) -> Column:
    found = web.title(html)
    return strip(F.regexp_replace(found, rule.title_suffix, "")) if rule.title_suffix else found


def published(html: Column, rule: DetailRule) -> Column:
    """The first of a meta tag, a ``time`` element, and seconds since 1970 under the epoch's name, as it is written (the last as ISO time)."""
    page = text_of(html)
    element = F.regexp_extract(page, r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']*)["']""", 1)
    epoch = F.nullif(F.regexp_extract(page, rf'"{re.escape(rule.epoch_name)}"\s*:\s*(\d{{10}})', 1), F.lit(""))
    return first_non_empty(strip(web.meta(page, rule.time_names)), strip(element), F.date_format(F.timestamp_seconds(epoch.cast("long")), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def region(html: Column, rule: DetailRule) -> Column:
    """The markup between the rule's start and the first of its end marks after it; empty without a start."""
    page = text_of(html)
    rest = F.regexp_extract(page, rf"(?is){rule.body_start}(.*)$", 1) if rule.body_start else F.lit("")
    for mark in rule.body_ends:
        rest = F.substring_index(rest, mark, 1)
    return rest


def best_body(html: Column) -> Column:
    """The longest text of an article, main or div element; of equally long ones the first in this order."""
    page = F.regexp_replace(text_of(html), _UNSEEN, "")
    inside = lambda tag: F.regexp_extract_all(page, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    texts = F.transform(F.concat(inside("article"), inside("main"), inside("div")), lambda h: collapse(web.strip_tags(h)))
    return F.aggregate(texts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def body(html: Column, rule: DetailRule) -> Column:
    """(text, origin): the region's paragraphs, else its text, else the best element, else the description."""
    inner = F.regexp_replace(region(html, rule), _UNSEEN, "")
    found = F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: collapse(web.strip_tags(p)))

    def kept(p: Column) -> Column:
        out = p != ""
        for s in rule.dropped_starts:
            out = out & ~p.startswith(s)
        for w in rule.dropped_words:
            out = out & ~p.contains(w)
        return out

    joined = F.array_join(F.filter(found, kept), "\n\n")

    def cut(text: Column) -> Column:
        for mark in rule.cut_at:
            text = F.substring_index(text, mark, 1)
        return F.substring(strip(text), 1, rule.most_body)

    about = web.description(html)
    told = [("paragraphs", cut(joined)), ("region", cut(collapse(web.strip_tags(inner)))), ("element", cut(best_body(html)))]
    text = F.coalesce(*[F.when(F.length(t) >= rule.least_body, t) for _, t in told], about)
    origin = F.coalesce(*[F.when(F.length(t) >= rule.least_body, F.lit(n)) for n, t in told], F.when(about != "", "description"), F.lit("none"))
    return F.struct(text.alias("text"), origin.alias("origin"))


def details(pages: DataFrame, rule: DetailRule, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with a struct ``detail``: title, published, published_ts, author, description, url, body, origin, ok (a title and a body)."""
    h = F.col(html)
    when, made = published(h, rule), body(h, rule)
    rows = pages.withColumn("_body", made).withColumn("_title", title(h, rule))
    address = first_non_empty(web.meta(h, ("og:url",)), F.col(url))
    ok = (F.col("_title") != "") & (F.col("_body.text") != "")
    fields = F.struct(
        F.col("_title").alias("title"), when.alias("published"), times.parse_time(when).alias("published_ts"), strip(web.unescape(web.meta(h, rule.author_names))).alias("author"), web.description(h).alias("description"),
        web.canonical_c(address).alias("url"), F.col("_body.text").alias("body"), F.col("_body.origin").alias("origin"), ok.alias("ok"),
    )
    return rows.withColumn("detail", fields).drop("_body", "_title")


def enriched(items: DataFrame, seen: DataFrame, fetched: DataFrame, key: str, rule: DetailRule) -> DataFrame:
    """``items`` with the detail of their page, fetched for unseen ones only: ``summary``, ``full_text``, ``published_at`` and ``detail_status``.

    ``fetched`` has (key, url, html, error); status is ``seen`` (nothing is fetched), ``failed`` with an error or an unusable page, where the item keeps what
    it had, ``missing`` without a page, and ``ok``. Of several pages of a key the first by address counts.
    """
    one = fetched.groupBy(key).agg(F.min_by(F.struct("url", "html", "error"), F.struct("url")).alias("_f")).select(F.col(key).alias("_key"), F.col("_f.url").alias("_url"), F.col("_f.html").alias("_html"), F.col("_f.error").alias("_error"))
    told = details(one.where("_error IS NULL"), rule, "_html", "_url").select("_key", "detail").unionByName(one.where("_error IS NOT NULL").select("_key"), allowMissingColumns=True)
    known = seen.select(F.col(key).alias("_seen")).distinct()
    fresh = items.join(known, F.col(key) == F.col("_seen"), "left").join(told, F.col(key) == F.col("_key"), "left")
    status = F.when(F.col("_seen").isNotNull(), "seen").when(F.col("_key").isNull(), "missing").when(F.coalesce(F.col("detail.ok"), F.lit(False)), "ok").otherwise("failed")
    marked = fresh.withColumn("detail_status", status)
    taken = lambda c, value: F.when(F.col("detail_status") == "ok", value).otherwise(F.col(c)) if c in items.columns else F.when(F.col("detail_status") == "ok", value)
    changed = {"title": F.col("detail.title"), "summary": F.substring("detail.body", 1, 600), "full_text": F.col("detail.body"), "published_at": first_non_empty(F.col("detail.published"), F.col("published_at") if "published_at" in items.columns else F.lit(""))}
    return marked.withColumns({c: taken(c, v) for c, v in changed.items()}).drop("_seen", "_key", "detail")
