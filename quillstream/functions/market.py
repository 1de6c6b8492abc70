"""Column builders for market items: symbols, identities, keyword buckets, freshness and intraday moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: First digits of six-digit codes and the exchange that lists them.
EXCHANGES = {"SH": ("6", "9"), "SZ": ("0", "1", "2", "3"), "BJ": ("4", "8")}
#: Words of a rise, and of a fall.
UP = ("直线拉升", "涨势扩大", "封涨停", "涨停", "涨超", "大涨", "拉升", "上涨", "走强")
DOWN = ("直线跳水", "跌势扩大", "封跌停", "跌停", "跌超", "大跌", "跳水", "下跌", "走弱")
#: The pattern of a concept, minutes of the look-back of a move, offset of the market's day.
CONCEPT = r"(?:A股)?([A-Za-z0-9一-鿿]{1,16})概念(?:股)?"
MOVE_MINUTES, MARKET_HOURS = 45, 8


def symbol(value: Column) -> Column:
    """A listed code in one form: 600000.SH from six digits, HK0700 from HK700 or 00700.HK; other texts in capitals as they are."""
    raw = F.upper(F.regexp_replace(T.text_of(value), r"(?U)\s+", ""))
    hk = F.regexp_extract(raw, r"^HK(\d{1,5})$", 1)
    dotted = F.regexp_extract(raw, r"^0?(\d{4,5})\.HK$", 1)
    padded = lambda c: F.concat(F.lit("HK"), F.when(F.length(c) < 4, F.lpad(c, 4, "0")).otherwise(c))
    out = F.when(hk != "", padded(hk)).when(dotted != "", padded(dotted))
    for exchange, digits in EXCHANGES.items():
        out = out.when(raw.rlike(r"^\d{6}$") & F.left(raw, F.lit(1)).isin(*digits), F.concat(raw, F.lit(f".{exchange}")))
    return out.otherwise(raw)


def leading_label(title: Column) -> Column:
    """The text of a leading 【label】, trimmed; empty without one."""
    return T.strip(F.regexp_extract(T.text_of(title), r"^\s*【([^】]+)】", 1))


def source_item_id(raw_id: Column, url: Column, dedupe_key: Column) -> Column:
    """The raw id, else the URL, else what follows the first colon of the de-duplication key."""
    rest = F.regexp_extract(T.text_of(dedupe_key), r"(?s)^[^:]*:(.*)$", 1)
    return F.coalesce(T.non_empty(raw_id), T.non_empty(url), rest)


def content_key(source: Column, canonical_url: Column, published: Column, title: Column) -> Column:
    """24 hex digits of source and URL, or without a URL of source, time and title."""
    with_url = T.content_hash(source, canonical_url)
    return F.substring(F.when(T.text_of(canonical_url) != "", with_url).otherwise(T.content_hash(source, published, title)), 1, 24)


def input_scope(full_text: Column, summary: Column) -> Column:
    return F.when(T.strip(T.text_of(full_text)) != "", "full_text").when(T.strip(T.text_of(summary)) != "", "summary").otherwise("title_only")


def keyword_bucket(title: Column, text: Column, excluded: Sequence[str], topics: Sequence[str], title_only: Sequence[str]) -> Column:
    """(matched, blocked, keyword): the first excluding word blocks; else the first topic, which may have to be in the title."""
    low_title, low = T.lowered(title), T.lowered(text)
    narrow = {t.casefold() for t in title_only}
    first = lambda terms, places: F.coalesce(*[F.when(T.term_in(p, t), F.lit(t)) for t, p in zip(terms, places, strict=True)], F.lit(None).cast("string"))
    out_word = first(excluded, [low] * len(excluded))
    topic = first(topics, [low_title if t.casefold() in narrow else low for t in topics])
    return F.struct(
        (out_word.isNull() & topic.isNotNull()).alias("matched"), out_word.isNotNull().alias("blocked"), F.coalesce(out_word, topic, F.lit("")).alias("keyword")
    )


def impulse(text: Column, easing: Sequence[str], tightening: Sequence[str]) -> Column:
    """easing or tightening, empty if a text has words of both or of neither."""
    eases, tightens = T.contains_any(text, easing), T.contains_any(text, tightening)
    return F.when(eases & ~tightens, "easing").when(tightens & ~eases, "tightening").otherwise("")


#: Fixed value: a word of prices with a per cent figure within 20 characters.
PRICE_REACTION = r"(股价|收盘|大跌|大涨|下跌|上涨|跌幅|涨幅|蒸发|市值).{0,20}(\d+(?:\.\d+)?%)"


def freshness(published: Column, text: Column, stale_days: int = 3) -> Column:
    """(status, earliest, latest, days, reacted): dates written in a text that lie before its day of publishing; ``reacted`` where it then tells a price move in per cent.

    Dates with a year are taken as they are, those without get the year of publishing; dates that no
    calendar has are left out.
    """
    day, body = F.to_date(published), T.text_of(text)
    pieces = lambda pattern, k: F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(k)), lambda x: x.cast("int"))
    date = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d))
    full = r"(20\d{2})年(\d{1,2})月(\d{1,2})日"
    short = r"(?<!\d)(\d{1,2})月(\d{1,2})日"
    dated = F.zip_with(pieces(full, 1), F.zip_with(pieces(full, 2), pieces(full, 3), lambda m, d: F.struct(m.alias("m"), d.alias("d"))), lambda y, p: date(y, p["m"], p["d"]))
    undated = F.zip_with(pieces(short, 1), pieces(short, 2), lambda m, d: date(F.year(day), m, d))
    earlier = F.filter(F.concat(dated, undated), lambda d: d < day)
    latest = F.array_max(earlier)
    days = F.datediff(day, latest)
    status = F.when(day.isNull() | (body == ""), "unknown").when(F.size(earlier) == 0, "same_day_or_unknown").when(days >= stale_days, "stale_or_rehash").otherwise("possibly_stale")
    reacted = (F.size(earlier) > 0) & body.rlike(PRICE_REACTION)
    return F.struct(status.alias("status"), F.array_min(earlier).alias("earliest"), latest.alias("latest"), days.alias("days"), F.coalesce(reacted, F.lit(False)).alias("reacted"))


def cleaned_target(name: Column) -> Column:
    """A target as keys have it: lower case, Latin letters, digits, Chinese characters and dots."""
    return F.regexp_replace(F.lower(T.strip(T.text_of(name))), r"[^a-z0-9一-鿿.]", "")


def move_target(hits: Column, evidence: Column, rules: Sequence[str]) -> Column:
    """The target of an intraday move: the first of the hits' (rule_id, related_targets of name and code) of one of ``rules`` with a name or else a code,
    else the first subject of the evidence (rule_family, matched_subjects) of a holding; empty without any."""
    pick = lambda t: T.first_non_empty(T.strip(T.text_of(t["name"])), T.text_of(t["code"]))
    wanted = F.filter(F.coalesce(hits, F.array()), lambda h: F.coalesce(h["rule_id"].isin(*rules), F.lit(False)))
    named = F.flatten(F.transform(wanted, lambda h: F.transform(F.coalesce(h["related_targets"], F.array()), lambda t: cleaned_target(pick(t)))))
    held = F.filter(F.coalesce(evidence, F.array()), lambda e: F.coalesce(e["rule_family"] == "holding", F.lit(False)))
    subjects = F.flatten(F.transform(held, lambda e: F.transform(F.coalesce(e["matched_subjects"], F.array()), lambda x: cleaned_target(x))))
    return F.coalesce(F.get(F.filter(F.concat(named, subjects), lambda x: x != ""), F.lit(0)), F.lit(""))


def market_move_key(published: Column, text: Column, target: Column) -> Column:
    """The identity of an intraday move, null unless day, one direction, a literal concept and a target are all there.

    ``published`` is a timestamp in a session of UTC; the market's day is eight hours ahead.
    """
    body = T.text_of(text)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: body.contains(w))
    up, down = any_of(UP), any_of(DOWN)
    day = F.date_format(published + F.expr(f"INTERVAL {MARKET_HOURS} HOURS"), "yyyy-MM-dd")
    concept = F.lower(F.regexp_extract(body, CONCEPT, 1))
    who = cleaned_target(target)
    direction = F.when(up & ~down, "up").when(down & ~up, "down")
    return F.when((concept != "") & (who != "") & direction.isNotNull() & day.isNotNull(), F.concat_ws(":", F.lit("market_move"), day, direction, concept, who))
