"""Deterministic range admission: which rule families a text belongs to, with the evidence for each.

Term lists are small configuration and become literals of the plan, so an item is judged in one narrow
pass: no join, no explode, no shuffle. The lower-case text and the sentences are made once an item, one
pattern tests a whole list of terms, and quotes are sought only for families that hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: Order in which families are reported.
FAMILIES = ("holding", "macro_data", "fed_policy", "semiconductor_ai", "trade_policy")
EVIDENCE = "struct<rule_family:string,reason_code:string,evidence_quote:string,matched_term_ids:array<string>,matched_subjects:array<string>,relation:string>"


@dataclass(frozen=True)
class Holding:
    symbol: str
    names: tuple[str, ...]
    related: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


@dataclass(frozen=True)
class Corridor:
    """Two sides of a trade relation; joint terms name both at once."""

    name: str
    one_side: tuple[str, ...]
    other_side: tuple[str, ...]
    joint: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.joint and not (self.one_side and self.other_side):
            raise ValueError(f"corridor {self.name} needs joint terms or both sides")

    def terms(self) -> tuple[str, ...]:
        return (*self.joint, *self.one_side, *self.other_side)

    def holds(self, low: Column) -> Column:
        """Whether a text in lower case names both sides."""
        return T.any_in(low, self.joint) | (T.any_in(low, self.one_side) & T.any_in(low, self.other_side))


@dataclass(frozen=True)
class Prepared:
    """Columns of an item's rule text: as it is, in lower case, its sentences and those in lower case."""

    text: Column
    low: Column
    parts: Column
    low_parts: Column
    trade: Column | None = None  # the lower-case sentences with a corridor and a trade action, one a line

    @staticmethod
    def of(text: Column) -> "Prepared":
        return Prepared(text, T.lowered(text), T.sentences(text), F.transform(T.sentences(text), F.lower))


@dataclass(frozen=True)
class RuleConfig:
    version: str
    topics: tuple[str, ...] = ()
    title_topics: tuple[str, ...] = ()
    indicators: tuple[str, ...] = ()
    contexts: tuple[str, ...] = ()
    policy_terms: tuple[str, ...] = ()
    corridors: tuple[Corridor, ...] = ()
    trade_actions: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    holdings: tuple[Holding, ...] = ()
    holding_only_sources: tuple[str, ...] = ()
    official_sources: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        topics = {t.casefold() for t in self.topics}
        stray = [t for t in self.title_topics if t.casefold() not in topics]
        if stray:
            raise ValueError(f"title topics that are no topics: {stray}")


def evidence(family: str, reason: str, text: Prepared | Column, terms: Sequence[str], subjects: Sequence[str] = (), relation: str = "", within: Column | None = None, holds=None) -> Column:
    """Evidence struct: a quote, and ids of the terms that match.

    The quote is the first sentence with a term, or that ``holds`` is true of; terms are sought in ``within``
    (in lower case) or in the text.
    """
    seen = text if isinstance(text, Prepared) else Prepared.of(text)
    place = seen.low if within is None else within
    found = F.array_compact(F.array(*[F.when(T.term_in(place, t), T.term_id(t)) for t in dict.fromkeys(terms)]))
    subject_list = F.array(*[F.lit(s) for s in subjects]) if subjects else F.array()
    quote = T.quote_of(seen.parts, seen.low_parts, seen.text, holds or (lambda s: T.any_in(s, terms)))
    return F.struct(
        F.lit(family).alias("rule_family"), F.lit(reason).alias("reason_code"), quote.alias("evidence_quote"),
        found.alias("matched_term_ids"), subject_list.cast("array<string>").alias("matched_subjects"), F.lit(relation).alias("relation"),
    )


def holding_evidence(seen: Prepared, holding: Holding, own: Column | None = None) -> list[tuple[Column, Column]]:
    """(condition, evidence) of a direct mention, and of related terms unless an excluding one is there.

    The evidence of a direct mention has the names; only where no name occurs it has the symbol, which the text or
    the item's ``own`` symbols may tell.
    """
    subjects = holding.names[:1]
    named, by_symbol = T.any_in(seen.low, holding.names), T.term_in(seen.low, holding.symbol)
    direct = lambda terms, within=None: evidence("holding", "holding_direct_identity", seen, terms, subjects, "direct", within)
    out = [(named, direct(holding.names)), (~named & by_symbol, direct((holding.symbol,)))]
    if own is not None:
        told = F.coalesce(F.array_contains(own, holding.symbol), F.lit(False))
        out.append((~named & ~by_symbol & told, direct((holding.symbol,), F.lit(holding.symbol.casefold()))))
    if holding.related:
        related = T.any_in(seen.low, holding.related) & ~T.any_in(seen.low, holding.excluded)
        out.append((related, evidence("holding", "holding_related_keyword", seen, holding.related, subjects, "configured_related")))
    return out


def trade_sentence(config: RuleConfig):
    """Tells of a sentence in lower case whether it has a corridor and a trade action."""

    def local(sentence: Column) -> Column:
        corridor = F.lit(False)
        for c in config.corridors:
            corridor = corridor | c.holds(sentence)
        return corridor & T.any_in(sentence, config.trade_actions)

    return local


def trade_sentences(seen: Prepared, config: RuleConfig) -> Column:
    """The trade sentences, one a line. The whole text must hold what a sentence holds, and is searched faster."""
    local = trade_sentence(config)
    return F.when(local(seen.low), F.array_join(F.filter(seen.low_parts, local), "\n")).otherwise("")


def trade_evidence(seen: Prepared, config: RuleConfig, official: Column) -> list[tuple[Column, Column]]:
    """Trade evidence of official sources, and of texts with a corridor and an action in one sentence.

    The former has the trade actions of the text, without any the corridors' terms, without those a fixed
    one; the latter has the terms of its trade sentences and quotes the first of them.
    """
    local = trade_sentence(config)
    corridor_terms = tuple(dict.fromkeys(t for c in config.corridors for t in c.terms()))
    acted = T.any_in(seen.low, config.trade_actions)
    corridor = F.lit(False)
    for c in config.corridors:
        corridor = corridor | c.holds(seen.low)
    direct = lambda terms: evidence("trade_policy", "trade_policy_direct_scope", seen, terms)
    surface = evidence("trade_policy", "trade_policy_direct_scope", seen, ("direct_trade_surface",), within=F.lit("direct_trade_surface"))
    sentences = trade_sentences(seen, config) if seen.trade is None else seen.trade
    scoped = evidence("trade_policy", "trade_policy_scope", seen, (*corridor_terms, *config.trade_actions), within=sentences, holds=local)
    return [
        (official & acted, direct(config.trade_actions)),
        (official & ~acted & corridor, direct(corridor_terms)),
        (official & ~acted & ~corridor, surface),
        (~official & (sentences != ""), scoped),
    ]


def family_conditions(low_title: Column, seen: Prepared, source: Column, config: RuleConfig, own: Column | None = None) -> list[tuple[Column, Column]]:
    title_only = {t.casefold() for t in config.title_topics}
    whole = [t for t in config.topics if t.casefold() not in title_only]
    topic = T.any_in(low_title, config.title_topics) | T.any_in(seen.low, whole)
    official = source.isin(*config.official_sources) if config.official_sources else F.lit(False)
    out: list[tuple[Column, Column]] = []
    for holding in config.holdings:
        out += holding_evidence(seen, holding, own)
    if config.indicators and config.contexts:
        both = T.any_in(seen.low, config.indicators) & T.any_in(seen.low, config.contexts)
        out.append((both, evidence("macro_data", "macro_data_scope", seen, (*config.indicators, *config.contexts))))
    if config.policy_terms:
        out.append((T.any_in(seen.low, config.policy_terms), evidence("fed_policy", "fed_policy_scope", seen, config.policy_terms)))
    if config.topics:
        out.append((topic, evidence("semiconductor_ai", "semiconductor_ai_scope", seen, config.topics)))
    if config.corridors:
        out += trade_evidence(seen, config, official)
    return out


def admit(items: DataFrame, config: RuleConfig, title: str = "title", text: str = "rule_text", source: str = "source", symbols: str | None = None) -> DataFrame:
    """``items`` with a struct ``admission``: status, reason_code, matched_families, evidence, config_version.

    ``symbols`` names an array of an item's own symbols, which make a direct mention as well. A null or empty text is excluded as ``empty_rule_text``; a global exclusion word excludes all but direct
    holdings; holding-only sources keep holding evidence alone.
    """
    body, origin = T.text_of(F.col(text)), T.text_of(F.col(source))
    made = {"_low": T.lowered(F.col(text)), "_low_title": T.lowered(F.col(title)), "_parts": T.sentences(body)}
    prepared = items.withColumns(made).withColumn("_low_parts", F.transform("_parts", F.lower))
    seen = Prepared(body, *[F.col(c) for c in ("_low", "_parts", "_low_parts")])
    if config.corridors:
        prepared, seen = prepared.withColumn("_trade", trade_sentences(seen, config)), replace(seen, trade=F.col("_trade"))
    found = [F.when(condition, value) for condition, value in family_conditions(F.col("_low_title"), seen, origin, config, None if symbols is None else F.col(symbols))]
    listed = F.array_compact(F.array(*found)).cast(f"array<{EVIDENCE}>") if found else F.array().cast(f"array<{EVIDENCE}>")
    rows = prepared.withColumn("_evidence", listed)
    boundary = origin.isin(*config.holding_only_sources) if config.holding_only_sources else F.lit(False)
    direct = F.exists("_evidence", lambda e: e["reason_code"] == "holding_direct_identity")
    excluded = T.any_in(seen.low, config.excluded) & ~direct
    kept = F.when(boundary, F.filter("_evidence", lambda e: e["rule_family"] == "holding")).otherwise(F.col("_evidence"))
    status = (
        F.when(body == "", "empty_rule_text").when(excluded, "global_exclude").when(F.size("_evidence") == 0, "out_of_scope")
        .when(F.size(kept) == 0, "holding_scope_required_for_source").when(boundary, "holding_scope_match").otherwise("content_scope_match")
    )
    admitted = status.isin("content_scope_match", "holding_scope_match")
    named = F.transform(kept, lambda e: e["rule_family"])
    families = F.array_compact(F.array(*[F.when(F.array_contains(named, f), F.lit(f)) for f in FAMILIES]))
    nothing = F.array().cast(f"array<{EVIDENCE}>")
    why = F.when(status == "global_exclude", F.array(evidence("global", "global_exclude", seen, config.excluded)).cast(f"array<{EVIDENCE}>")) if config.excluded else F.when(F.lit(False), nothing)
    return rows.withColumn(
        "admission",
        F.struct(
            F.when(admitted, "admitted").otherwise("excluded").alias("status"), status.alias("reason_code"),
            F.when(admitted, families).otherwise(F.array().cast("array<string>")).alias("matched_families"),
            F.when(admitted, kept).otherwise(F.coalesce(why, nothing)).alias("evidence"), F.lit(config.version).alias("config_version"),
        ),
    ).drop("_evidence", "_low_parts", "_trade", *made)


def sentence_window(items: DataFrame, key: str, text: str, anchors: Sequence[str], stops: Sequence[str], signals: Sequence[Sequence[str]], ahead: int = 6, least: int = 2, also: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(key, index, n_signals, quote): of each text the first anchor sentence whose window has ``least`` of the signals.

    An anchor sentence has a term of ``anchors`` and one of each group of ``also`` (a bank and a role). A window is the sentence and up to ``ahead`` more, cut before the first with a stop term. Every sentence is
    tested once, and a window holds ``ahead`` + 1 rows, however long the text.
    """
    cut = items.select(key, F.posexplode(T.sentences(F.col(text))).alias("index", "sentence"))
    x = F.col("sentence")
    flags = [T.matches_any(x, group).cast("int").alias(f"g{k}") for k, group in enumerate(signals)]
    anchor = T.matches_any(x, anchors)
    for group in also:
        anchor = anchor & T.matches_any(x, group)
    tested = cut.select(key, "index", "sentence", anchor.alias("anchor"), T.matches_any(x, stops).alias("stop"), *flags)
    forward = Window.partitionBy(key).orderBy("index").rowsBetween(0, ahead)
    held = F.struct("sentence", "stop", *[f"g{k}" for k in range(len(signals))])
    windows = tested.withColumn("m", F.collect_list(held).over(forward)).where("anchor").select(key, "index", "m")
    stop_at = F.array_position(F.transform(F.slice("m", 2, ahead), lambda m: m["stop"]), True)
    windows = windows.withColumn("stop_at", stop_at)
    windows = windows.withColumn("m", F.when(F.col("stop_at") > 0, F.slice("m", F.lit(1), F.col("stop_at").cast("int"))).otherwise(F.col("m")))
    total = sum((F.array_max(F.transform("m", _field(f"g{k}"))) for k in range(1, len(signals))), F.array_max(F.transform("m", _field("g0"))))
    quote = F.substring(F.array_join(F.transform("m", _field("sentence")), " "), 1, T.QUOTE_CHARS)
    judged = windows.select(key, "index", total.alias("n_signals"), quote.alias("quote")).where(F.col("n_signals") >= least)
    best = judged.groupBy(key).agg(F.min_by(F.struct("index", "n_signals", "quote"), "index").alias("w"))
    return best.select(key, F.col("w")["index"].alias("index"), "w.n_signals", "w.quote")


def _field(name: str):
    return lambda m: m[name]
