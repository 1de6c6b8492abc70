"""Column builders for normalising, cutting and matching text. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends that close a sentence wherever they stand.
SENTENCE_END = "[。！？!?；;]"
QUOTE_CHARS = 300
#: Characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def strip(column: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.btrim(column, F.lit(WHITE_SPACE))


def collapse(column: Column) -> Column:
    """White space runs become one blank, ends are trimmed; null becomes the empty text."""
    return F.trim(F.regexp_replace(text_of(column), r"(?U)\s+", " "))


def non_empty(column: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(text_of(column), F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in columns], F.lit(""))


def distinct_texts(column: Column) -> Column:
    """Trimmed non-empty elements in first-seen order; null gives an empty array."""
    cleaned = F.filter(F.transform(column, lambda x: collapse(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def once(parts: Column, made) -> Column:
    """``made`` of an array that is computed once, whatever a lambda in it reads; null gives null."""
    return F.get(F.transform(F.array(parts), made), F.lit(0))


def distinct_ignoring_case(column: Column) -> Column:
    """Elements in first-seen order, compared in lower case; the first spelling stays."""
    both = lambda texts: F.struct(texts.alias("texts"), F.transform(texts, F.lower).alias("low"))
    first = lambda x: F.transform(F.array_distinct(x["low"]), lambda t: F.get(x["texts"], (F.array_position(x["low"], t) - 1).cast("int")))
    return once(once(distinct_texts(column), both), first)


def one_of(column: Column, allowed: Sequence[str], default: str) -> Column:
    value = F.lower(collapse(column))
    return F.when(value.isin(*allowed), value).otherwise(default)


def rule_text(*parts: Column) -> Column:
    """Non-empty parts, each on its own line."""
    return F.array_join(F.filter(F.array(*[text_of(p) for p in parts]), lambda x: x != ""), "\n")


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the trimmed, non-empty parts, one a line."""
    return F.sha2(F.array_join(F.filter(F.array(*[strip(text_of(p)) for p in parts]), lambda x: x != ""), "\n"), 256)


def dedupe_key(source: Column, item_id: Column, url: Column, content_type: Column, title: Column, published: Column) -> Column:
    """source:id, else source:url, else source and 24 hex digits of the rest."""
    rest = F.substring(F.sha2(F.concat_ws("\n", *[text_of(c) for c in (source, content_type, title, published)]), 256), 1, 24)
    return F.concat(text_of(source), F.lit(":"), F.coalesce(non_empty(item_id), non_empty(url), rest))


def sentences(column: Column) -> Column:
    """Sentences by closing marks and line ends, trimmed, none empty."""
    # White space beside a cut goes with it, so only the ends of the whole text are left to trim.
    cut = F.split(strip(text_of(column)), rf"(?U)\s*\n\s*|(?<={SENTENCE_END})\s*")
    return F.filter(cut, lambda x: x != "")


def evidence_units(column: Column) -> Column:
    """Units that end at 。！？!? or a line end, or at a full stop before white space or the end; they keep their end."""
    return F.filter(F.split(text_of(column), r"(?<=[。！？!?\n])|(?<=(?<!\.)\.)(?=(?U)\s|$)"), lambda x: x != "")


def evidence_segments(column: Column, prefix: str, most: int = QUOTE_CHARS) -> Column:
    """Units in chunks of ``most`` characters, as (id, text) with ids prefix1, prefix2, ..."""
    chunks = F.flatten(
        F.transform(evidence_units(column), lambda u: F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / most).cast("int")), lambda k: F.substr(u, k * most + 1, F.lit(most))))
    )
    return F.transform(chunks, lambda x, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("id"), x.alias("text")))


_ASCII_TERM = r"[a-z0-9_.+-]+"


def lowered(column: Column) -> Column:
    return F.lower(text_of(column))


def term_in(low: Column, term: str) -> Column:
    """contains_term on a text that is in lower case already."""
    return any_in(low, [term])


def any_in(low: Column, terms: Sequence[str]) -> Column:
    """Whether a text in lower case has any of the terms: one pattern for all that need boundaries, plain searches for the others."""
    wanted = list(dict.fromkeys(t.casefold().strip() for t in terms))
    bounded = [t for t in wanted if re.fullmatch(_ASCII_TERM, t)]
    out, near = F.lit(False), F.lit(False)
    for term in wanted:
        if term in bounded:
            near = near | low.contains(term)
        elif term:
            out = out | low.contains(term)
    if bounded:  # a plain search is far cheaper, and most texts lack most terms
        out = out | (near & low.rlike(rf"(?<![a-z0-9])(?:{'|'.join(rf'\Q{t}\E' for t in bounded)})(?![a-z0-9])"))
    return out


def contains_term(text: Column, term: str) -> Column:
    """Case-insensitive match; a term of ASCII letters, digits and _.+- needs a boundary of other ASCII on both sides."""
    return term_in(lowered(text), term)


def contains_short_bounded(text: Column, term: str, most: int = 4) -> Column:
    """Like contains_term, but only terms of at most ``most`` letters, digits, dots and blanks need boundaries."""
    wanted = term.casefold().strip()
    if not re.fullmatch(rf"[a-z0-9. ]{{1,{most}}}", wanted):
        return lowered(text).contains(wanted) if wanted else F.lit(False)
    return lowered(text).rlike(rf"(?<![a-z0-9])\Q{wanted}\E(?![a-z0-9])")


def contains_word_bounded(text: Column, term: str) -> Column:
    """Like contains_term, but only terms of letters and digits alone need boundaries."""
    wanted = term.casefold().strip()
    if not re.fullmatch(r"[a-z0-9]+", wanted):
        return lowered(text).contains(wanted) if wanted else F.lit(False)
    return lowered(text).rlike(rf"(?<![a-z0-9])\Q{wanted}\E(?![a-z0-9])")


def contains_alias(text: Column, alias: str) -> Column:
    """Like contains_term, but any alias with a letter or digit needs boundaries, and blanks match any white space."""
    wanted = alias.casefold().strip()
    if not re.search(r"[a-z0-9]", wanted):
        return F.lower(text_of(text)).contains(wanted) if wanted else F.lit(False)
    body = r"\s+".join(rf"\Q{part}\E" for part in wanted.split())
    return F.lower(text_of(text)).rlike(rf"(?<![a-z0-9]){body}(?![a-z0-9])")


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Plain case-insensitive containment of any term."""
    lowered = F.lower(text_of(text))
    return F.exists(F.array(*[F.lit(t.casefold()) for t in terms]), lambda t: lowered.contains(t)) if terms else F.lit(False)


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that match, in the order of ``terms``."""
    found = [F.when(contains_term(text, t), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def matches_any(text: Column, terms: Sequence[str]) -> Column:
    return any_in(lowered(text), terms)


def quote_of(parts: Column, low_parts: Column, text: Column, holds, most: int = QUOTE_CHARS) -> Column:
    """The first of ``parts`` whose lower-case form ``holds`` is true of, or else the text, at most ``most`` characters."""
    at = F.array_position(F.transform(low_parts, lambda s: F.coalesce(holds(s), F.lit(False))), True).cast("int")
    return F.substring(F.coalesce(F.get(parts, at - 1), text_of(text)), 1, most)


def quote(text: Column, terms: Sequence[str], most: int = QUOTE_CHARS) -> Column:
    """The first sentence with any term, or else the text, at most ``most`` characters."""
    return quote_of(sentences(text), sentences(lowered(text)), text, lambda s: any_in(s, terms), most)


def term_id(term: str) -> Column:
    return F.concat(F.lit("term:"), F.substring(F.sha2(F.lit(term.casefold()), 256), 1, 12))


def paragraph_chunks(column: Column, most: int = 1300) -> Column:
    """Paragraphs packed into chunks of at most ``most`` characters; a longer paragraph stands alone."""
    parts = F.filter(F.transform(F.split(text_of(column), r"\n+"), strip), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        fits = (state["open"] == "") | (F.length(state["open"]) + 1 + F.length(part) <= most)
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit("\n"), part))
        return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), F.when(fits, joined).otherwise(part).alias("open"))

    return F.aggregate(parts, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def bigrams(column: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character is itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - 1, F.lit(1))), lambda i: F.substr(column, i, F.lit(2)))
    return F.when(F.length(column) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


#: Words that titles of one event differ by.
TITLE_NOISE = ("相关", "产品", "销售", "已经", "已有", "距高位", "提示", "公司", "股价", "上涨", "下跌", "两天", "三天", "连续", "明显", "趋势", "存在", "风险")


def title_core(column: Column, noise: Sequence[str] = (), abbreviations: bool = True) -> Column:
    """A title in capitals for near-duplicate comparison: no numbers, no noise words, letters and digits only.

    Without ``abbreviations`` runs of two or more Latin letters go as well.
    """
    value = F.regexp_replace(F.upper(text_of(column)), r"\d+(?:\.\d+)?%?", "")
    if not abbreviations:
        value = F.regexp_replace(value, r"[A-Z]{2,}", "")
    for word in noise:
        value = F.replace(value, F.lit(word.upper()), F.lit(""))
    return F.regexp_replace(value, r"[^\p{L}\p{N}]+", "")


def similar_titles(left: Column, right: Column, least_contained: int = 8, overlap: float = 0.65, jaccard: float = 0.45) -> Column:
    """One core contains the other (of 8 characters at least), or enough bigrams are shared."""
    a, b = bigrams(left), bigrams(right)
    shared = F.size(F.array_intersect(a, b))
    contained = left.contains(right) | right.contains(left)
    close = (shared / F.least(F.size(a), F.size(b)) >= overlap) & (shared / F.size(F.array_union(a, b)) >= jaccard)
    return F.when((left == "") | (right == ""), False).when(contained, F.least(F.length(left), F.length(right)) >= least_contained).otherwise(close)
