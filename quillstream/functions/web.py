"""Column builders for URLs and HTML."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import collapse, strip, text_of

# Query parameters that the three URL forms leave out.
TRACKING_A = ("utm_source", "utm_medium", "utm_campaign", "from")
TRACKING_B = ("from", "source", "cre", "mod", "loc", "r", "sec", "sudaref", "display", "retcode")
TRACKING_B_PREFIXES = ("utm_", "spm")
# Paragraphs with these beginnings or words are not article text.
BOILERPLATE_STARTS = ("copyright", "related", "for more information")
BOILERPLATE_WORD = "cookie"

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def _query(url: Column, dropped: Column) -> Column:
    """``?`` and the parameters that stay, or nothing; parameters without ``=`` get one."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~dropped_key(p, dropped))
    joined = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def dropped_key(pair: Column, dropped) -> Column:
    return dropped(F.substring_index(pair, "=", 1))


def _fragment(url: Column) -> Column:
    return F.when(_part(url, 5) == "", "").otherwise(F.concat(F.lit("#"), _part(url, 5)))


def canonical_a(url: Column) -> Column:
    """Without four tracking parameters; all else, the fragment too, as it is."""
    u = text_of(url)
    whole = F.concat(F.lower(_part(u, 1)), F.lit("://"), _part(u, 2), _part(u, 3), _query(u, lambda k: k.isin(*TRACKING_A)), _fragment(u))
    return F.when(u.rlike(_URL), whole).otherwise(u)


def canonical_b(url: Column) -> Column:
    """Lower-case scheme and host, a path, no tracking parameters, no fragment."""
    u = strip(text_of(url))

    def tracking(key: Column) -> Column:
        low = F.lower(key)
        out = low.isin(*TRACKING_B)
        for prefix in TRACKING_B_PREFIXES:
            out = out | low.startswith(prefix)
        return out

    path = F.when(_part(u, 3) == "", "/").otherwise(_part(u, 3))
    whole = F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), path, _query(u, tracking))
    return F.when(u.rlike(_URL) & (_part(u, 2) != ""), whole).otherwise(u)


def canonical_c(url: Column) -> Column:
    """Lower-case scheme and host, a path, the query as it is, no fragment; for http and https."""
    u = strip(text_of(url))
    path = F.when(_part(u, 3) == "", "/").otherwise(_part(u, 3))
    query = F.when(_part(u, 4) == "", "").otherwise(F.concat(F.lit("?"), _part(u, 4)))
    return F.when(F.lower(_part(u, 1)).isin("http", "https"), F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), path, query)).otherwise(u)


def host(url: Column) -> Column:
    return F.lower(_part(text_of(url), 2))


def path_id(url: Column) -> Column:
    """The path without slashes at its ends."""
    return F.regexp_replace(_part(text_of(url), 3), "^/+|/+$", "")


def last_segment(url: Column) -> Column:
    return F.regexp_extract(path_id(url), "([^/]*)$", 1)


def number_in_path(url: Column) -> Column:
    """The last number of four digits or more in the path, or nothing."""
    return F.regexp_extract(_part(text_of(url), 3), r"(\d{4,})(?:\D*)$", 1)


def unescape(column: Column) -> Column:
    """Character references decoded once: the named ones of HTML and decimal or hexadecimal numbers; others stay as they are.

    Numbers from 128 to 159 mean the characters that Windows-1252 has there, where it has one.
    """
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    common = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
    names = table(sorted(common.items()))
    # Rarer names are looked up only where the common ones do not have it.
    rarer = table(sorted((name[:-1], text) for name, text in html5.items() if name.endswith(";") and name[:-1] not in common))
    western = table([(F.lit(b).cast("bigint"), text) for b in range(0x80, 0xA0) if (text := bytes([b]).decode("cp1252", "ignore"))])
    character = lambda number: F.coalesce(F.when(number.between(0x80, 0x9F), F.try_element_at(western, number)), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9)).cast("bigint")
        exists = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        found = F.when(name == "", F.lit(None)).when(exists, character(number)).when(~exists, F.lit(None)).otherwise(F.coalesce(F.try_element_at(names, name), F.try_element_at(rarer, name)))
        rest = F.substr(part, F.length(name) + 2)
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), part)))

    return F.when(column.contains("&"), F.array_join(F.transform(F.split(column, "&"), piece), "")).otherwise(column)


#: Elements whose content is no text, and what the tags that break lines become.
UNSEEN, BREAKS = ("script", "style"), {"br": "\n", "/p": "\n\n"}
BLOCK_UNSEEN = (*UNSEEN, "noscript")
BLOCK_BREAKS = {"br": "\n", **{f"/{tag}": "\n" for tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")}}


def strip_tags(html: Column, blocks: bool = False) -> Column:
    """Text of a fragment: unseen elements go, then every tag that breaks no line, then those that do become line ends."""
    unseen, breaks = (BLOCK_UNSEEN, BLOCK_BREAKS) if blocks else (UNSEEN, BREAKS)
    out = F.regexp_replace(text_of(html), "(?is)" + "|".join(f"<{tag}.*?</{tag}>" for tag in unseen), "")
    out = F.regexp_replace(out, rf"(?is)<(?!(?:{'|'.join(breaks)})\s*/?>)[^>]+>", "")
    for mark in sorted(set(breaks.values())):
        tags = "|".join(tag for tag, m in breaks.items() if m == mark)
        out = F.regexp_replace(out, rf"(?i)<(?:{tags})\s*/?>", mark)
    out = unescape(out)
    return strip(F.regexp_replace(out, r"[ \t\f]+", " ") if blocks else out)


def clean_lines(column: Column) -> Column:
    """Lines with collapsed white space, none empty."""
    lines = F.split(F.replace(text_of(column), F.lit("\r"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, collapse), lambda x: x != ""), "\n")


def meta(html: Column, names: Sequence[str]) -> Column:
    """The first content of a meta tag with one of the names, in the order of ``names``; attributes in any order."""
    tags = F.regexp_extract_all(text_of(html), F.lit(r"(?is)<meta\b[^>]*>"), 0)
    key = lambda t: F.lower(F.regexp_extract(t, r"""(?is)\b(?:name|property)\s*=\s*["']([^"']*)["']""", 1))
    value = lambda t: F.concat(*[F.regexp_extract(t, rf"(?is)\bcontent\s*=\s*{q}([^{q}]*){q}", 1) for q in ('"', "'")])
    known = F.filter(F.transform(tags, lambda t: F.struct(key(t).alias("key"), value(t).alias("value"))), lambda m: strip(m["value"]) != "")
    first = lambda n: F.get(F.filter(known, lambda m: m["key"] == n), 0)["value"]
    return F.coalesce(*[first(n) for n in names], F.lit(""))


def title(html: Column) -> Column:
    """og:title, else twitter:title, else <title>, else the first <h1>."""
    h = text_of(html)
    inside = lambda tag: F.regexp_extract(h, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    found = [F.nullif(collapse(strip_tags(x)), F.lit("")) for x in (meta(h, ("og:title", "twitter:title")), inside("title"), inside("h1"))]
    return F.coalesce(*found, F.lit(""))


def description(html: Column) -> Column:
    return strip(unescape(meta(html, ("description", "og:description", "twitter:description"))))


#: Fixed value: what of a page counts as a paragraph; other readings of unclosed tags would give other bodies.
PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"


def paragraphs(html: Column, least: int = 40) -> Column:
    """Texts of <p> elements longer than ``least`` characters that are not boilerplate."""

    def kept(p: Column) -> Column:
        low = F.lower(p)
        begins = F.lit(False)
        for start in BOILERPLATE_STARTS:
            begins = begins | low.startswith(start)
        return (F.length(p) > least) & ~begins & ~low.contains(BOILERPLATE_WORD)

    return F.filter(F.transform(F.regexp_extract_all(text_of(html), F.lit(PARAGRAPH), 1), lambda p: strip_tags(p)), kept)


def body(html: Column) -> Column:
    """Paragraphs, or else the description, with what it was taken from."""
    joined = F.array_join(paragraphs(html), "\n\n")
    about = description(html)
    return F.struct(
        F.when(joined != "", joined).otherwise(about).alias("text"),
        F.when(joined != "", "paragraphs").when(about != "", "description").otherwise("none").alias("origin"),
    )


def links(html: Column) -> Column:
    """(href, label) of every anchor, in order; of equal hrefs the first."""
    found = F.regexp_extract_all(text_of(html), F.lit(r"""(?is)<a\s[^>]*?href=["'](?:[^"']*)["'][^>]*>(?:.*?)</a>"""), 0)
    pairs = F.transform(
        found,
        lambda a: F.struct(F.regexp_extract(a, r"""(?is)href=["']([^"']*)["']""", 1).alias("href"), collapse(strip_tags(F.regexp_extract(a, r"(?is)>(.*)</a>", 1))).alias("label")),
    )
    hrefs = F.transform(pairs, lambda p: p["href"])
    return F.filter(pairs, lambda p, i: F.array_position(hrefs, p["href"]) == i + 1)


def longest(candidates: Sequence[Column]) -> Column:
    """The longest text; of equally long ones the first."""
    listed = F.array(*[text_of(c) for c in candidates])
    return F.aggregate(listed, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
