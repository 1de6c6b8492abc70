"""Column builders of small rules: identities of records, relevance to a holding, themes, policy impulses, errors and prompts of links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import web

#: Hosts of posts, the forms of an article's id, a note that a text was generated (without white space, in capitals).
POST_HOSTS = ("x.com", "www.x.com", "twitter.com", "www.twitter.com")
ARTICLE_ID = (r"doc-i([a-z0-9]+)\.shtml", r"detail-i([a-z0-9]+)\.d\.html")
GENERATED = r"内容由A[IＩ]生成|本文由A[IＩ]生成|A[IＩ]生成内容|智能生成内容"
#: Fixed value: a title that begins with a company's name and a colon.
COMPANY_COLON = r"^([一-鿿A-Za-z0-9Ａ-Ｚａ-ｚ（）()·]+)[：:]"
#: Kinds of a stream's errors in their order, with the status codes and words that tell them, and whether to warn at once.
STREAM_ERRORS = (
    ("too_many_connections", (429,), ("toomanyconnections", "maximum allowed connection limit"), True),
    ("auth", (401, 403), ("http 401", "http 403"), True),
    ("proxy_refused", (), ("connection refused", "errno 61", "errno 111"), False),
    ("network_unreachable", (), ("network is unreachable", "errno 101"), False),
    ("timeout", (), ("timed out", "timeout"), False),
    ("x_api_unavailable", (500, 502, 503, 504), ("http 503", "service unavailable"), False),
    ("connection_reset", (), ("connection reset",), False),
)


def _holds(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds any of the words as they are; false without words."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def article_id(value: Column) -> Column:
    """The id in an article's address, or what follows ``comos:``; other texts trimmed."""
    raw = T.strip(T.text_of(value))
    raw = F.when(raw.startswith("comos:"), F.substr(raw, F.lit(7))).otherwise(raw)
    found = [F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")) for pattern in ARTICLE_ID]
    return F.coalesce(*found, raw)


def disclosure_identity(official_id: Column, url: Column, symbol: Column, title: Column, published: Column) -> Column:
    """``announcement:`` and the official id, else the number of the PDF, else a hash of symbol, title and time."""
    number = F.regexp_extract(T.text_of(url), r"(?i)/(\d+)\.pdf(?:\?|$)", 1)
    seed = F.concat_ws("\n", F.upper(T.text_of(symbol)), F.lower(T.collapse(title)), T.text_of(published))
    known = F.coalesce(F.nullif(T.strip(T.text_of(official_id)), F.lit("")), F.nullif(number, F.lit("")))
    return F.coalesce(F.concat(F.lit("announcement:"), known), F.concat(F.lit("disclosure:"), F.substring(F.sha2(seed, 256), 1, 32)))


def compact(value: Column) -> Column:
    """A text for comparison of names: without white space, in capitals."""
    return F.upper(F.regexp_replace(F.replace(T.text_of(value), F.lit("Ａ"), F.lit("A")), r"(?U)\s+", ""))


def relevance(title: Column, code: str, names: Sequence[str], keywords: Sequence[str], excluded: Sequence[str]) -> Column:
    """(relevant, reason) of a title for a holding: its code or name, else an excluding word, else a word of its business."""
    flat = compact(title)
    tidy = lambda words: ["".join(w.split()).upper() for w in words if w.strip()]
    reason = (
        F.when(_holds(flat, tidy([code, *names])), "direct_mention").when(_holds(flat, tidy(excluded)), "excluded_keyword").when(_holds(flat, tidy(keywords)), "business_keyword").otherwise("needs_llm_relevance")
    )
    return F.struct(reason.isin("direct_mention", "business_keyword").alias("relevant"), reason.alias("reason"))


def announcement_like(title: Column, names: Sequence[str], keywords: Sequence[str]) -> Column:
    """Whether a title begins with the holding's name and a colon, or has a word of announcements."""
    tokens = ["".join(n.split()).upper() for n in names if n.strip()]
    flat, trimmed = compact(title), T.strip(T.text_of(title))
    named = F.lit(False)
    for token in tokens:
        named = named | flat.startswith(token + "：") | flat.startswith(token + ":")
    prefix = compact(F.regexp_extract(trimmed, COMPANY_COLON, 1))
    return (trimmed != "") & (named | prefix.isin(*tokens) | _holds(trimmed, keywords))


def generated(text: Column) -> Column:
    """Whether a text, without its tags, says that it was generated."""
    plain = web.unescape(F.regexp_replace(T.text_of(text), r"<[^>]+>", ""))
    return F.upper(F.regexp_replace(plain, r"(?U)\s+", "")).rlike(GENERATED)


def post_link_kind(url: Column) -> Column:
    """x_photo or x_status for the address of a post or its photo, empty for others."""
    raw = T.strip(T.text_of(url))
    host = F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    kind = F.when(path.rlike(r"/status/\d+/photo/\d+$"), "x_photo").when(path.rlike(r"/status/\d+$"), "x_status").otherwise("")
    return F.when(host.isin(*POST_HOSTS), kind).otherwise("")


def stream_error(error: Column, status: Column, phase: str = "stream") -> Column:
    """(kind, immediate) of an error's text and status code, the first kind that fits."""
    low = T.lowered(error)
    fits = [(F.coalesce(status.isin(*codes), F.lit(False)) if codes else F.lit(False)) | _holds(low, words) for _, codes, words, _ in STREAM_ERRORS]
    kind = F.coalesce(*[F.when(fit, F.lit(known[0])) for fit, known in zip(fits, STREAM_ERRORS, strict=True)], F.lit(f"{phase}_error"))
    return F.struct(kind.alias("kind"), kind.isin(*[k for k, _, _, now in STREAM_ERRORS if now]).alias("immediate"))


def article_url(addresses: Sequence[Column], article: Column, before: str, after: str) -> Column:
    """The first address that is not empty, else one made of the article's id, else empty."""
    tidy = lambda c: F.nullif(T.strip(T.text_of(c)), F.lit(""))
    return F.coalesce(*[tidy(c) for c in addresses], F.concat(F.lit(before), tidy(article), F.lit(after)), F.lit(""))


def context_line(groups: Sequence[tuple[str, Column]], most: int = 8) -> Column:
    """One line of labelled lists of names, ``most`` each; lists without names are left out."""
    parts = []
    for label, names in groups:
        kept = F.slice(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), 1, most)
        parts.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}："), F.array_join(kept, "、"))))
    return F.concat_ws("；", *parts)


def themes(text: Column, catalogue: Mapping[str, Sequence[str]], unless: tuple[str, str, Sequence[str]] | None = None) -> Column:
    """Names of the themes that a text has a word of, in catalogue order.

    ``unless`` is (other, theme, words): beside the theme ``other``, ``theme`` counts only with one of ``words``.
    """

    def any_word(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | T.contains_word_bounded(text, word)
        return out

    found = {name: any_word(words) for name, words in catalogue.items()}
    if unless:
        other, theme, words = unless
        found[theme] = found[theme] & (~found[other] | any_word(words))
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in found.items()]))


def transmission(text: Column, impulse: Column, assets: Sequence[str], relations: Sequence[str], exceptions: Sequence[tuple[str, str]], most: int = 500) -> Column:
    """(matched, assets, quote, exceptions): a plain explanation of how a policy moves assets.

    It needs an impulse, an asset and a relation (the first pattern that is found gives the quote), and none
    of the exceptions, which are (name, pattern) in their order; patterns are as in ``operators.content``.
    """
    body = T.text_of(text)
    low = F.lower(body)
    named = F.slice(F.array_compact(F.array(*[F.when(low.contains(a.casefold()), F.lit(a)) for a in dict.fromkeys(assets)])), 1, 8)
    quote = F.coalesce(*[F.nullif(F.regexp_extract(body, f"(?iud){p}", 0), F.lit("")) for p in relations], F.lit(""))
    met = F.array_compact(F.array(*[F.when(body.rlike(f"(?iud){p}"), F.lit(name)) for name, p in exceptions]))
    matched = (impulse != "") & (F.size(named) > 0) & (quote != "") & (F.size(met) == 0)
    return F.struct(matched.alias("matched"), named.alias("assets"), F.substring(quote, 1, most).alias("quote"), met.alias("exceptions"))


def _cut(column: Column, most: int) -> Column:
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most - 3), F.lit("..."))).otherwise(column)


def link_summary(links: Column, per_link: int = 2200, total: int = 9000) -> Column:
    """What is known of each link, an array of (url, title, description, text, status, error), as one text of at most ``total`` characters."""
    tidy = lambda c: T.strip(T.text_of(c))

    def section(link: Column, place: Column) -> Column:
        lines = [("标题：", tidy(link["title"])), ("描述：", tidy(link["description"])), ("正文摘录：", _cut(tidy(link["text"]), per_link))]
        status, error = T.text_of(link["status"]), tidy(link["error"])
        state = F.concat(F.lit("抓取状态："), F.when(status == "", "unknown").otherwise(status), F.lit("；"), F.when(error == "", "无正文").otherwise(error))
        return F.concat_ws(
            "\n", F.concat(F.lit("链接 "), (place + 1).cast("string"), F.lit(": "), T.text_of(link["url"])), *[F.when(v != "", F.concat(F.lit(label), v)) for label, v in lines],
            F.when((status != "ok") | (error != ""), state),
        )

    return _cut(F.array_join(F.transform(links, section), "\n\n"), total)


def shortened(value: Column, most: int) -> Column:
    """A text for a card: white space collapsed, at most ``most`` characters."""
    return _cut(T.collapse(value), most)


def card_escape(value: Column) -> Column:
    """A text for a card's markup: backslashes, asterisks and underscores are escaped."""
    return F.regexp_replace(T.text_of(value), r"([\\*_])", r"\\$1")


def post_item(url: Column, post_id: Column, text: Column, user: Column, name: Column, quoted: Column, most: int = 280) -> Column:
    """(id, author, summary, full_text) of a post, null without id, address or text; texts that it quotes follow its own, each once."""
    address, own = T.strip(T.text_of(url)), T.collapse(text)
    number = F.coalesce(F.nullif(T.strip(T.text_of(post_id)), F.lit("")), F.regexp_extract(address, r"/status/(\d+)", 1))
    others = F.array_distinct(F.filter(F.transform(F.coalesce(quoted, F.array().cast("array<string>")), T.collapse), lambda x: x != ""))
    full = F.when(F.size(others) > 0, F.concat(own, F.lit("\n\n引用推文："), F.array_join(others, "；"))).otherwise(own)
    handle = F.regexp_replace(T.collapse(user), "^@+", "")
    author = F.when(handle != "", F.concat(F.lit("@"), handle)).otherwise(F.coalesce(F.nullif(T.collapse(name), F.lit("")), F.lit("X")))
    whole = F.struct(number.alias("id"), author.alias("author"), F.substring(full, 1, most).alias("summary"), full.alias("full_text"))
    return F.when((number != "") & (address != "") & (own != ""), whole)
