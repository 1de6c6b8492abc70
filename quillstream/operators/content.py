"""What a text says of data releases, policy and reports: features, exceptions, and the identities that follow from rules.

All of it are column functions of one item's text, so a table is read once without a shuffle. Term lists and patterns
are the caller's small configuration; patterns are in the syntax that both Java and RE2 read, and compared without case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators.macro_events import any_of

#: Characters of a window and of evidence, assets that are told, minutes and days of look-backs.
WINDOW, EVIDENCE, ASSETS, FACT_MINUTES, REPORT_DAYS = 1000, 500, 8, 90 * 1440, 7
_NEVER = r"[^\s\S]"
#: Patterns are read as RE2 reads them: letters beyond ASCII have a case too, and only a line feed ends a line.
ANY_CASE = "(?iud)"


@dataclass(frozen=True)
class ContentConfig:
    primary: tuple[str, ...]
    #: Indicators that count only where the context is there.
    scoped: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    surprise: tuple[str, ...] = ()
    expected: tuple[str, ...] = ()
    large_move: tuple[str, ...] = ()
    preview: tuple[str, ...] = ()
    reaction: tuple[str, ...] = ()
    #: Words that tell of a reaction by themselves.
    explicit_reaction: tuple[str, ...] = ()
    released: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    official_events: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns is found, whatever the case."""
    return text.rlike(ANY_CASE + ("|".join(f"(?:{p})" for p in patterns) if patterns else _NEVER))


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a text holds, each once, in their order."""
    low = F.lower(text)
    told = [F.when(low.contains(t.lower()), F.lit(t)) for t in dict.fromkeys(terms) if t]
    return F.array_compact(F.array(*told)) if told else F.array().cast("array<string>")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(T.text_of(text), r"(?<=[。！？!?；;])|[\r\n]+"), T.strip), lambda s: s != "")


def first_window(parts: Column, holds) -> Column:
    """The first sentence that ``holds`` and the one after it; empty if none does."""
    at = F.array_position(F.transform(parts, lambda s: F.coalesce(holds(s), F.lit(False))), True).cast("int")
    return F.when(at > 0, F.substring(F.array_join(F.slice(parts, at, F.lit(2)), " "), 1, WINDOW)).otherwise("")


def features(items: DataFrame, config: ContentConfig, parts: Sequence[str] = ("title", "summary", "full_text")) -> DataFrame:
    """``items`` with a struct ``content`` of features: indicators, context, surprise, expectation, reaction, release, event, tier and tags.

    Surprise and expectation count as evidence only in a sentence with an indicator, and a reaction only in that sentence or the next.
    An item whose data are ignored ones alone is of tier ``ignored``; one with an indicator or event is ``primary``; others have none.
    """
    text = T.strip(F.array_join(F.filter(F.array(*[T.strip(T.text_of(F.col(p))) for p in parts]), lambda x: x != ""), "\n"))
    rows = items.withColumn("_text", text).withColumn("_parts", sentences(F.col("_text")))
    body, has = F.col("_text"), lambda terms, c: T.contains_any(c, terms)
    context = has(config.context, F.concat(body, F.lit(" ")))
    primary = found_terms(body, config.primary)
    scoped = F.when(context, found_terms(body, config.scoped)).otherwise(F.array().cast("array<string>"))
    indicators = F.array_distinct(F.concat(primary, scoped))
    rows = rows.withColumns({"_context": context, "_terms": F.concat(primary, scoped), "_ind": indicators})
    named = lambda s: F.exists("_ind", lambda t: F.lower(s).contains(F.lower(t)))
    rows = rows.withColumn("_surprise", first_window(F.col("_parts"), lambda s: named(s) & matches(s, config.surprise)))
    rows = rows.withColumn("_expected", first_window(F.col("_parts"), lambda s: named(s) & matches(s, config.expected)))
    reaction, large, surprise = has(config.reaction, body), matches(body, config.large_move), matches(body, config.surprise)
    there = lambda c: F.col(c) != ""
    local = there("_surprise") & ((has(config.reaction, F.col("_surprise")) & matches(F.col("_surprise"), config.large_move)) | has(config.explicit_reaction, F.col("_surprise")))
    preview = matches(body, config.preview)
    release = (F.size("_ind") > 0) & ~preview & (there("_surprise") | there("_expected") | has(config.released, body))
    event = has(config.events, body) & (has(config.official_events, body) | (F.col("_context") & (reaction | large | surprise)))
    is_primary = F.size("_terms") > 0
    ignored = has(config.ignored, body) & ~(has(config.primary, body) | has(config.scoped, body) | has(config.events, body) | reaction)
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (("primary_data", is_primary), ("fed_event", event), ("market_reaction", reaction), ("large_move", large), ("surprise", surprise))]))
    tier = F.when(ignored, "ignored").when(is_primary | event, "primary").otherwise("")
    none = F.array().cast("array<string>")
    told = {
        "primary": is_primary, "primary_terms": F.col("_terms"), "context": F.col("_context"), "market_reaction": reaction, "large_move": large, "surprise": surprise, "attributable_surprise": there("_surprise"),
        "expected": there("_expected"), "preview": preview, "direct_release": release, "attributable_reaction": local, "surprise_evidence": F.substring("_surprise", 1, EVIDENCE), "expected_evidence": F.substring("_expected", 1, EVIDENCE),
        "event": event, "tier": tier, "tags": F.when(tier == "primary", tags).otherwise(none),
    }
    return rows.withColumn("content", F.struct(*[c.alias(n) for n, c in told.items()])).drop("_text", "_parts", "_context", "_terms", "_ind", "_surprise", "_expected")


@dataclass(frozen=True)
class TransmissionConfig:
    impulses: dict[str, tuple[str, ...]]
    assets: tuple[str, ...]
    relationships: tuple[str, ...]
    #: Flags in order: patterns that each make an explanation more than a generic one.
    exceptions: dict[str, tuple[str, ...]] = field(default_factory=dict)


def unexpected_relationship(contrast: Sequence[str], moves: Sequence[str], reach: int = 36) -> str:
    """A pattern of a word of contrast with a word of movement within ``reach`` characters after it."""
    return rf"{any_of(contrast)}.{{0,{reach}}}{any_of(moves)}"


def transmission(text: Column, config: TransmissionConfig) -> Column:
    """(matched, impulse, assets, evidence_quote, exceptions): a policy impulse, assets and a phrase that joins them, and no exception.

    Two impulses in one text are none.
    """
    body = T.text_of(text)
    flags = [(label, T.contains_any(body, terms)) for label, terms in config.impulses.items()]
    number = sum((c.cast("int") for _, c in flags[1:]), flags[0][1].cast("int"))
    impulse = F.when(number == 1, F.coalesce(*[F.when(c, F.lit(label)) for label, c in flags])).otherwise("")
    relation = F.coalesce(*[F.nullif(F.regexp_extract(body, f"{ANY_CASE}{p}", 0), F.lit("")) for p in config.relationships], F.lit(""))
    told = F.array_compact(F.array(*[F.when(matches(body, patterns), F.lit(name)) for name, patterns in config.exceptions.items()])) if config.exceptions else F.array().cast("array<string>")
    assets = found_terms(body, config.assets)
    matched = (impulse != "") & (F.size(assets) > 0) & (relation != "") & (F.size(told) == 0)
    return F.struct(matched.alias("matched"), impulse.alias("impulse"), F.slice(assets, 1, ASSETS).alias("assets"), F.substring(relation, 1, EVIDENCE).alias("evidence_quote"), told.alias("exceptions"))


@dataclass(frozen=True)
class FactRule:
    """A fixed fact: its key, what a text must hold (every group: a term of it, or a pattern), and what it may not."""

    key: str
    needs: tuple[tuple[str, ...], ...]
    patterns: tuple[tuple[str, ...], ...] = ()
    lacks: tuple[str, ...] = ()
    lacks_patterns: tuple[str, ...] = ()
    #: Groups of terms that together make it another fact.
    unless: tuple[tuple[str, ...], ...] = ()


def industry_fact(text: Column, rules: Sequence[FactRule]) -> Column:
    """The key ``industry_fact:…`` of the first rule that a text meets; null if it meets none."""
    body = T.text_of(text)

    def holds(rule: FactRule) -> Column:
        out = body != ""
        for group in rule.needs:
            out = out & T.contains_any(body, group)
        for group in rule.patterns:
            out = out & matches(body, group)
        out = out & ~T.contains_any(body, rule.lacks) & ~matches(body, rule.lacks_patterns)
        other = F.lit(bool(rule.unless))
        for group in rule.unless:
            other = other & T.contains_any(body, group)
        return out & ~other

    return F.coalesce(*[F.when(holds(r), F.lit(f"industry_fact:{r.key}")) for r in rules], F.lit(None).cast("string"))


@dataclass(frozen=True)
class ReportConfig:
    institutions: dict[str, tuple[str, ...]]
    #: Patterns of a subject, the first group is its name; and names that are none.
    subjects: tuple[str, ...]
    coverage: tuple[str, ...]
    revision: tuple[str, ...]
    ratings: dict[str, tuple[str, ...]] = field(default_factory=dict)
    legal_forms: tuple[str, ...] = ()
    no_subjects: tuple[str, ...] = ()


#: A target price after or before its label, with the currency around it, and what currencies are written as.
_CURRENCY, _NUMBER = r"(人民币|港元|美元|CNY|RMB|HKD|USD|￥|¥|\$)?", r"(\d{1,6}(?:,\d{3})*(?:\.\d+)?)"
TARGETS = (
    rf"(?i)(?:目标价|target\s+price|\bTP\b)\s*(?:定为|为|至|到|of|at|to|:|：)?\s*{_CURRENCY}\s*{_NUMBER}\s*(元人民币|人民币|元|港元|美元)?",
    rf"(?i){_CURRENCY}\s*{_NUMBER}\s*(元人民币|人民币|元|港元|美元)?\s*(?:的)?(?:目标价|target\s+price)",
)
CURRENCIES = {"CNY": ("人民币", "CNY", "RMB", "￥", "¥", "元", "元人民币"), "HKD": ("港元", "HKD"), "USD": ("美元", "USD", "$")}


def target_price(text: Column) -> Column:
    """(currency, price) of the first target price; ``UNKNOWN`` where no currency is written; null without one. The price has no commas and no zeros at its end."""
    body = T.text_of(text)
    told = []
    for pattern in TARGETS:
        before, number, after = (F.regexp_extract(body, pattern, k) for k in (1, 2, 3))
        written = F.upper(F.when(before != "", before).otherwise(after))
        currency = F.coalesce(*[F.when(written.isin(*[n.upper() for n in names]), F.lit(code)) for code, names in CURRENCIES.items()], F.lit("UNKNOWN"))
        plain = F.regexp_replace(number, ",", "")
        price = F.regexp_replace(F.regexp_replace(F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain), r"^0+(?=\d)", ""), r"^$", "0")
        told.append(F.when(number != "", F.struct(currency.alias("currency"), price.alias("price"))))
    return F.coalesce(*told)


def report_identity(title: Column, body: Column, config: ReportConfig) -> Column:
    """(dedup_key, institution, subject, action, rating, currency, price) of a text that is a report's first coverage or target price, else null.

    The text must name exactly one institution and, by one pattern, subjects of which the longest holds the others; a revision of an earlier price is no such report.
    """
    text = F.concat_ws(" ", T.text_of(title), T.text_of(body))
    named = F.array_compact(F.array(*[F.when(_any_alias(text, aliases), F.lit(name)) for name, aliases in config.institutions.items()]))
    found = F.coalesce(*[_subjects(text, p, config) for p in config.subjects])
    longest = F.element_at(F.array_sort(F.transform(found, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), -1)["s"]
    subject = F.when(F.forall(found, lambda s: F.lower(longest).contains(F.lower(s))), longest)
    price = F.coalesce(target_price(title), target_price(body))
    covers, revises = T.contains_any(text, config.coverage), T.contains_any(text, config.revision)
    action = F.when(covers, "coverage_start").when(price.isNotNull(), "target_valuation")
    rating = F.coalesce(*[F.when(_any_alias(text, aliases), F.lit(name)) for name, aliases in config.ratings.items()], F.lit(""))
    key = F.concat(F.lit("investment_bank_report:"), named[0], F.lit(":"), F.substring(F.sha2(F.lower(subject), 256), 1, 16), F.lit(":target:"), price["currency"], F.lit(":"), price["price"])
    good = (F.size(named) == 1) & subject.isNotNull() & price.isNotNull() & (price["currency"] != "UNKNOWN") & action.isNotNull() & ~revises
    return F.when(good, F.struct(key.alias("dedup_key"), F.get(named, F.lit(0)).alias("institution"), subject.alias("subject"), action.alias("action"), rating.alias("rating"), price["currency"].alias("currency"), price["price"].alias("price")))


def _any_alias(text: Column, aliases: Sequence[str]) -> Column:
    out = F.lit(False)
    for alias in aliases:
        out = out | T.contains_alias(text, alias)
    return out


def _subjects(text: Column, pattern: str, config: ReportConfig) -> Column:
    """The distinct cleaned subjects of a pattern; null where it finds none."""
    def clean(s: Column) -> Column:
        name = F.btrim(T.collapse(s), F.lit(" ：:，,。；;()（）[]【】\"'"))
        name = F.regexp_replace(name, r"[（(][0-9A-Za-z.]+[)）]", "")
        return T.collapse(F.regexp_replace(name, f"{any_of(config.legal_forms)}$", "") if config.legal_forms else name)

    raw = F.transform(F.regexp_extract_all(text, F.lit(f"{ANY_CASE}{pattern}"), F.lit(1)), clean)
    kept = F.array_distinct(F.filter(raw, lambda s: (F.length(s) >= 2) & ~F.lower(s).isin(*[n.lower() for n in config.no_subjects or ("",)])))
    return F.when(F.size(kept) > 0, kept)
