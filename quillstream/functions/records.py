"""Column builders that read records: titles of reports, author lists, noisy JSON, relevant lines, attributed sentences."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: Words of a research action, the first that a title holds wins.
RESEARCH_ACTIONS = (
    ("做多", "long"), ("做空", "short"), ("买入", "buy"), ("buy", "buy"), ("卖出", "sell"), ("sell", "sell"), ("超配", "overweight"), ("overweight", "overweight"),
    ("低配", "underweight"), ("underweight", "underweight"), ("上调", "upgrade"), ("raise pt", "upgrade"), ("下调", "downgrade"), ("lower pt", "downgrade"),
    ("首次覆盖", "initiate"), ("initiating", "initiate"), ("initiate", "initiate"),
)
#: Fixed value: a target price after its label.
TARGET_PRICE = r"(?i)(?:目标价|target price|PT|tp)[^0-9€$￥¥]{0,16}([€$￥¥]?\s*\d+(?:\.\d+)?)"


_JSON_MARKS, _FENCED = re.compile(r'[{}"\\]'), re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)


def report_title(title: Column) -> Column:
    """(institution, report_date, pages, target_price, research_action) of a report's title; ``unknown`` where it does not say."""
    text = T.text_of(title)
    low = F.lower(text)
    told = lambda c: F.when(c != "", c).otherwise("unknown")
    institution = F.when(text.contains("-"), T.strip(F.split(text, "-")[0])).otherwise("")
    date = F.regexp_replace(F.regexp_extract(text, r"20\d{6}", 0), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    action = F.coalesce(*[F.when(low.contains(needle), label) for needle, label in RESEARCH_ACTIONS], F.lit("unknown"))
    return F.struct(
        told(institution).alias("institution"), told(date).alias("report_date"), F.regexp_extract(text, r"【(\d+)页】", 1).alias("pages"),
        told(F.replace(F.regexp_extract(text, TARGET_PRICE, 1), F.lit(" "), F.lit(""))).alias("target_price"), action.alias("research_action"),
    )


def author_targets(value: Column) -> Column:
    """(code, name) of a list like ``code@@name##code@@name``: trimmed, without empty codes, each code once."""
    parts = F.transform(F.split(T.text_of(value), "##"), lambda p: F.struct(F.trim(F.split(p, "@@")[0]).alias("code"), F.trim(F.coalesce(F.get(F.split(p, "@@"), 1), F.lit(""))).alias("name")))
    kept = F.filter(parts, lambda p: p["code"] != "")
    codes = F.transform(kept, lambda p: p["code"])
    return F.filter(kept, lambda p, i: F.array_position(codes, p["code"]) == i + 1)


def balanced_object(text: str) -> str | None:
    """From the first brace of a text to the one that closes it; braces within JSON strings do not count."""
    start, depth, quoted, skip = text.find("{"), 0, False, -1
    if start < 0:
        return None
    for m in _JSON_MARKS.finditer(text, start):
        mark = m.group()
        if m.start() == skip:
            continue
        if quoted:
            if mark == "\\":
                skip = m.end()  # what it escapes
            elif mark == '"':
                quoted = False
        elif mark == '"':
            quoted = True
        elif mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return None


def find_object(text: str | None) -> str | None:
    """The first of these that is a JSON object: the text, a fenced block, the balanced object from the first brace, first to last brace."""
    if not text:
        return None
    fenced = _FENCED.search(text)
    end = text.rfind("}") + 1
    for part in (text, fenced and fenced.group(1), balanced_object(text), text[text.find("{") : end] if "{" in text else None):
        if not part:
            continue
        try:
            if isinstance(json.loads(part), dict):
                return part.strip()
        except ValueError:
            continue
    return None


def json_object(value: Column) -> Column:
    """The JSON object in a noisy text, as it is written there; null if none parses as a whole.

    Texts that may hold an object go to Python in Arrow batches, as no built-in function counts braces outside strings.
    """

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(find_object)

    return F.when(value.contains("{"), found(value))


def relevant_lines(text: Column, terms: Sequence[str], most: int = 6) -> Column:
    """The first ``most`` lines with a term, trimmed, told once whatever their case."""
    lines = F.filter(F.transform(F.split(T.text_of(text), r"\n"), T.strip), lambda x: (x != "") & T.any_in(F.lower(x), terms))
    low = F.transform(lines, F.lower)
    return F.slice(F.filter(lines, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def attributed_sentences(text: Column, aliases: Sequence[str], verbs: Sequence[str], criticism: Sequence[str]) -> Column:
    """Places (from 0) of sentences that name an institution with a verb of saying and no criticism."""
    parts = F.transform(T.sentences(text), F.lower)
    holds = F.transform(parts, lambda s: T.any_in(s, aliases) & T.any_in(s, verbs) & ~T.any_in(s, criticism))
    return F.filter(F.transform(holds, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())


def places(text: Column, pattern: str) -> Column:
    """(value, at) of the matches of a pattern that do not overlap; ``at`` counts characters from 0."""
    # What a lambda reads is bound by ``once``, else it is made anew for each match; and a fold copies its state at each step, so
    # places are summed from those of every 16th match and not gathered in a fold.
    block = 16
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def sized(p: Column) -> Column:
        sizes = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["found"])), p["found"], lambda g, m: F.length(g) + F.length(m))
        return F.struct(p["found"].alias("found"), F.transform(p["gaps"], F.length).alias("gaps"), sizes.alias("sizes"))

    def summed(p: Column) -> Column:
        count = F.floor(F.size(p["sizes"]) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count), lambda b: total(F.slice(p["sizes"], b * block + 1, F.lit(block))))
        return F.struct(p["found"].alias("found"), p["gaps"].alias("gaps"), p["sizes"].alias("sizes"), sums.alias("sums"))

    def begun(p: Column) -> Column:
        starts = F.transform(p["sums"], lambda x, b: total(F.slice(p["sums"], F.lit(1), b)))
        return F.struct(p["found"].alias("found"), p["gaps"].alias("gaps"), p["sizes"].alias("sizes"), starts.alias("starts"))

    def placed(p: Column) -> Column:
        before = lambda k: F.get(p["starts"], F.floor(k / block).cast("int")) + total(F.slice(p["sizes"], k - k % block + 1, k % block))
        return F.transform(p["found"], lambda m, k: F.struct(m.alias("value"), (before(k) + F.get(p["gaps"], k)).alias("at")))

    return T.once(T.once(T.once(T.once(parts, sized), summed), begun), placed)


def quantified_spans(text: Column, patterns: Sequence[str], most: int = 8) -> Column:
    """The first ``most`` matches of any pattern that no other match contains, by place; of equal ones one.

    In the order of place, longest first, a match lies in an earlier one exactly if it ends no later than the furthest end so far.
    """
    held = T.text_of(text)
    found = F.filter(F.flatten(F.array(*[places(held, p) for p in patterns])), lambda m: m["value"] != "")
    ranked = F.array_sort(F.transform(found, lambda m: F.struct(m["at"].alias("at"), (-F.length(m["value"])).alias("size"), m["value"].alias("value"))))
    start = F.struct(F.lit(0).alias("reach"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, m: Column) -> Column:
        end = (m["at"] - m["size"]).cast("int")
        new = (end > state["reach"]) & (F.size(state["kept"]) < most)  # later ones are not told
        return F.struct(F.greatest(state["reach"], end).alias("reach"), F.when(new, F.array_append(state["kept"], m["value"])).otherwise(state["kept"]).alias("kept"))

    return F.slice(F.aggregate(ranked, start, step)["kept"], 1, most)


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether a text has a quote, white space folded in both; an empty quote is in none."""
    wanted = T.collapse(quote)
    return (wanted != "") & T.collapse(text).contains(wanted)


def valid_claims(text: Column, claims: Column, topics: Sequence[str], events: Sequence[str], patterns: Sequence[str], most: int = 10) -> Column:
    """Of an array of (topic, event_type, evidence_quote) the first ``most`` of an allowed topic and event whose quote the text has, with their quantified spans."""
    told = lambda c, f: F.trim(T.text_of(c[f]))
    kept = F.filter(F.coalesce(claims, F.array().cast("array<struct<topic:string,event_type:string,evidence_quote:string>>")), lambda c: told(c, "topic").isin(*topics) & told(c, "event_type").isin(*events) & holds_quote(text, c["evidence_quote"]))
    return F.transform(
        F.slice(kept, 1, most),
        lambda c: F.struct(told(c, "topic").alias("topic"), told(c, "event_type").alias("event_type"), told(c, "evidence_quote").alias("evidence_quote"), quantified_spans(told(c, "evidence_quote"), patterns).alias("quantified_evidence")),
    )


def valid_attribution(text: Column, attribution: Column, quote: Column, aliases: Sequence[str], speaker: Column, speakers: Sequence[str], criticism: Sequence[str]) -> Column:
    """Whether an extraction says explicitly who said it: its quote is in the text, without criticism, and names the institution or its known speaker."""
    said = T.text_of(quote)
    alias = F.lit(False)
    for a in aliases:
        alias = alias | T.contains_alias(said, a)
    known = F.lower(F.trim(T.text_of(speaker))).isin(*[s.casefold() for s in speakers]) & holds_quote(said, speaker) if speakers else F.lit(False)
    return (F.trim(T.text_of(attribution)) == "explicit") & holds_quote(text, quote) & ~T.contains_any(said, criticism) & (alias | known)


def display_time(value: Column, zone_hours: int = 8) -> Column:
    """A timestamp of a session of UTC as ``2024-01-02 03:04 (UTC+8; 2024-01-01 19:04 UTC)``."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return F.concat(shown(value + F.expr(f"INTERVAL {zone_hours} HOURS")), F.lit(f" (UTC+{zone_hours}; "), shown(value), F.lit(" UTC)"))
