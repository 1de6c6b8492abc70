"""Identities of macro-data events: which indicator, of which month, in which phase, each text is about.

A text is cut into claims, each a row. The mentions of indicators and months in a claim have places, and an
indicator takes the nearest month that stands before it in the claim, at most 48 characters back: an as-of join
over the characters of a text, as one window over both kinds of mentions. The closest pair tells the fact of
a claim; of an item's claims the first with a published value is preferred. Phases: ``market_reaction`` to a release,
``fed_policy_market_reaction`` to a policy impulse, ``preview``, ``release``.

Defined results: null fields are empty texts; items without a phase, with a correction, or with a statement of the
speaker have no identity; a time that is null gives no reaction and no year to infer; ties of distance
go to the earlier indicator. Repeated ids are judged together by the caller's key, so keys should be unique.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.records import places
from quillstream.session import checkpointed

#: Characters that a month may stand before its indicator, days of the look-backs, and sessions before a reaction that it is also known by.
MONTH_REACH, LOOK_BACK_DAYS, IMPULSE_DAYS, ALIAS_SESSIONS, QUOTE = 48, 90, 14, 3, 500
#: Names of months, by number.
MONTHS = ("january|jan", "february|feb", "march|mar", "april|apr", "may", "june|jun", "july|jul", "august|aug", "september|sept|sep", "october|oct", "november|nov", "december|dec")
#: A month and its year in Chinese (no day after it) and in English.
CHINESE_MONTH = r"(?:(20\d{2})年)?(1[0-2]|[1-9])月(?!\s*[0-3]?\d日)"
ENGLISH_MONTH = rf"(?i)\b({'|'.join(MONTHS)})\b(?:\s+(20\d{{2}}))?"
#: Fixed value: what parts claims.
CLAIM_END = r"(?:(?i:<br\s*/?>)|[。！？!?；;]|\n)+"


@dataclass(frozen=True)
class MacroConfig:
    country: str
    country_terms: tuple[str, ...]
    indicators: dict[str, tuple[str, ...]]
    market_terms: tuple[str, ...]
    direction_terms: tuple[str, ...]
    preview_terms: tuple[str, ...] = ()
    surprise_terms: tuple[str, ...] = ()
    correction_terms: tuple[str, ...] = ()
    #: Indicators that are counts: verbs of change tell their values, rates of change those of the others.
    counted: tuple[str, ...] = ()
    rate_terms: tuple[str, ...] = ()
    change_terms: tuple[str, ...] = ()
    forecast_terms: tuple[str, ...] = ()
    #: Words after an indicator, within 24 characters, that tell of a release.
    released_terms: tuple[str, ...] = ()
    speaker_terms: tuple[str, ...] = ()
    speech_verbs: tuple[str, ...] = ()
    impulses: dict[str, tuple[str, ...]] = field(default_factory=dict)
    zone_hours: int = 8
    day_starts: int = 6


def any_of(terms: Sequence[str]) -> str:
    """A pattern of any of the terms, longest first; of none of them if there are none."""
    return "(?:" + "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t))) + ")" if terms else r"(?:[^\s\S])"


def claims(items: DataFrame, key: str, parts: Sequence[str], at: str) -> DataFrame:
    """(key, at, text, place, claim): the claims of each item's texts, white space folded, with the whole text beside them."""
    text = F.array_join(F.transform(F.array(*[T.text_of(F.col(p)) for p in parts]), T.strip), " ")
    cut = F.filter(F.transform(F.split("text", CLAIM_END), T.collapse), lambda c: c != "")
    return items.select(key, F.col(at).cast("timestamp").alias("at"), text.alias("text")).select(key, "at", "text", F.posexplode_outer(cut).alias("place", "claim"))


def has_value(claim: Column, config: MacroConfig) -> Column:
    """Whether a claim tells a published value of an indicator: a rate or change with a number near it, and no forecast within."""
    of = lambda counts: any_of([t for label, ts in config.indicators.items() for t in ts if (label in config.counted) == counts])
    indicator, count, number = of(False), of(True), r"[-+]?\d+(?:\.\d+)?\s*[%％]?"
    rate, change, forecast = any_of(config.rate_terms), any_of(config.change_terms), any_of(config.forecast_terms)
    shapes = [rf"(?i){indicator}.{{0,32}}{rate}.{{0,16}}{number}", rf"(?i){rate}.{{0,16}}{number}.{{0,32}}{indicator}", rf"(?i){count}.{{0,28}}{change}.{{0,12}}{number}"]
    out = F.lit(False)
    for shape in shapes:
        found = F.regexp_extract(claim, shape, 0)
        out = out | ((found != "") & ~found.rlike(rf"(?i){forecast}"))
    return out


def _month(value: Column) -> tuple[Column, Column]:
    """Year (or null) and month of a mention."""
    low = F.lower(value)
    names = F.coalesce(*[F.when(low.rlike(rf"^(?:{m})\b"), k) for k, m in enumerate(MONTHS, 1)], F.regexp_extract(value, r"(1[0-2]|[1-9])月", 1).cast("int"))
    return F.nullif(F.regexp_extract(value, r"20\d{2}", 0), F.lit("")).cast("int"), names


def _period(year: Column, month: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def release_facts(cut: DataFrame, key: str, config: MacroConfig) -> DataFrame:
    """(key, place, indicator, period, actual, claim): the fact of each claim of the country that tells an indicator and its month."""
    nothing = F.lit(None).cast("string")

    def seen(pattern: str, claim: Column, label: str | None) -> Column:
        value = lambda m: (F.lit(label).alias("indicator"), nothing.alias("month")) if label else (nothing.alias("indicator"), m["value"].alias("month"))
        return F.transform(places(claim, pattern), lambda m: F.struct(m["at"].alias("at"), *value(m)))

    named = [seen(any_of([t.lower() for t in terms]), F.lower("claim"), label) for label, terms in config.indicators.items()]
    months = [seen(p, F.col("claim"), None) for p in (CHINESE_MONTH, ENGLISH_MONTH)]
    kept = cut.where(T.contains_any(F.col("claim"), config.country_terms)).withColumn("mentions", F.concat(*named, *months))
    rows = kept.select(key, "at", "place", "claim", F.explode("mentions").alias("m")).select(key, "at", "place", "claim", F.col("m.at").alias("spot"), "m.indicator", "m.month")
    # The nearest month at or before each mention: at one place a month goes first.
    before = Window.partitionBy(key, "place").orderBy("spot", F.col("indicator").isNotNull(), "indicator").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.last(F.when(F.col("month").isNotNull(), F.struct("spot", "month")), ignorenulls=True).over(before)
    paired = rows.withColumn("near", nearest).where("indicator IS NOT NULL AND spot - near.spot <= " + str(MONTH_REACH))
    best = paired.groupBy(key, "place").agg(F.min_by(F.struct("indicator", F.col("near.month").alias("month"), "claim", "at"), F.struct(F.col("spot") - F.col("near.spot"), F.col("spot"), F.col("indicator"))).alias("f"))
    facts = best.select(key, "place", "f.*")
    year, month = _month(F.col("month"))
    local = F.col("at")
    inferred = F.year(local) - F.when(month > F.month(local) + 1, 1).otherwise(0)
    return facts.select(key, "place", "indicator", _period(F.coalesce(year, inferred), month).alias("period"), has_value(F.col("claim"), config).alias("actual"), "claim").where("period IS NOT NULL")


def preferred(facts: DataFrame, key: str) -> DataFrame:
    """Of each item's facts the first that is actual, or else the first."""
    order = F.struct((~F.col("actual")).cast("int"), F.col("place"))
    return facts.groupBy(key).agg(F.min_by(F.struct(*[c for c in facts.columns if c != key]), order).alias("f")).select(key, "f.*")


def session_of(at: Column, config: MacroConfig) -> Column:
    """The trading day of a time: local, and that of the day before until the day starts."""
    return F.date_format(at + F.expr(f"INTERVAL {config.zone_hours - config.day_starts} HOURS"), "yyyy-MM-dd")


def identities(items: DataFrame, config: MacroConfig, key: str = "id", parts: Sequence[str] = ("title", "summary", "full_text"), at: str = "published_at", exceptions: str | None = None) -> DataFrame:
    """(key, phase, indicator, period, session, dedup_key, aliases, minutes, quote) of items with a macro-data identity.

    ``exceptions`` names a boolean column of items that are kept apart whatever they say.
    """
    cut = checkpointed(claims(items, key, parts, at))
    low = lambda c, terms: T.contains_any(c, terms)
    reacts = lambda c: low(c, config.market_terms) & low(c, config.direction_terms)
    impulse = F.coalesce(*[F.when(low(F.col("claim"), terms), F.lit(label)) for label, terms in config.impulses.items()], F.lit(None).cast("string"))
    told = F.when(impulse.isNotNull() & reacts(F.col("claim")), F.struct("place", impulse.alias("impulse")))
    speaker, verbs = any_of(config.speaker_terms), any_of(config.speech_verbs)
    speech = F.col("claim").rlike(rf"(?i){speaker}\s*[:：]|{speaker}.{{0,24}}{verbs}|{verbs}.{{0,18}}{speaker}")
    named = any_of([t for ts in config.indicators.values() for t in ts])
    firsts = [F.when(F.instr(F.lower("claim"), t.lower()) > 0, F.struct(F.instr(F.lower("claim"), t.lower()).alias("spot"), F.lit(label).alias("label"))) for label, ts in config.indicators.items() for t in ts]
    first = F.array_min(F.array_compact(F.array(*firsts)))["label"]
    context = F.when(low(F.col("claim"), config.country_terms) & first.isNotNull(), F.struct("place", first.alias("indicator"), "claim"))
    whole = cut.groupBy(key).agg(
        F.first("text").alias("text"), F.first("at").alias("at"), F.min(told).alias("impulse"), F.coalesce(F.bool_or(speech), F.lit(False)).alias("speech"), F.min(context).alias("context"),
    )
    fact = preferred(release_facts(cut, key, config), key).select(F.col(key).alias("_fact"), F.struct("indicator", "period", "actual", "claim").alias("fact"))
    rows = whole.join(fact, F.col(key) == F.col("_fact"), "left").where(~low(F.col("text"), config.correction_terms) & ~F.col("speech"))
    if exceptions:
        rows = rows.join(items.where(F.col(exceptions)).select(F.col(key).alias("_apart")), F.col(key) == F.col("_apart"), "left_anti")
    released = F.coalesce(F.col("fact.actual"), F.lit(False)) | low(F.col("text"), config.surprise_terms) | F.col("text").rlike(rf"(?i){named}.{{0,24}}{any_of(config.released_terms)}")
    session = session_of(F.col("at"), config)
    before = F.add_months(F.trunc(F.to_date("at"), "month"), -1)
    guess = F.struct(F.col("context.indicator").alias("indicator"), F.date_format(before, "yyyy-MM").alias("period"), F.lit(False).alias("actual"), F.col("context.claim").alias("claim"))
    rows = rows.withColumn("reaction", reacts(F.col("text"))).withColumn("on_release", F.col("reaction") & released)
    rows = rows.withColumn("fact", F.when(F.col("on_release"), F.coalesce("fact", F.when(F.col("context").isNotNull(), guess))).otherwise(F.col("fact")))
    phase = (
        F.when(F.col("on_release"), F.when(F.col("fact").isNotNull() & F.col("at").isNotNull(), "market_reaction"))
        .when(F.col("reaction") & F.col("impulse").isNotNull(), F.when(F.col("at").isNotNull(), "fed_policy_market_reaction"))
        .when(F.col("fact.actual"), "release").when(F.col("fact").isNotNull(), "preview")
    )
    rows = rows.withColumn("phase", phase).where("phase IS NOT NULL")
    policy = F.col("phase") == "fed_policy_market_reaction"
    reacted = F.col("phase").isin("market_reaction", "fed_policy_market_reaction")
    label = F.when(policy, "FED_POLICY").otherwise(F.col("fact.indicator"))
    suffix = F.when(policy, F.col("impulse.impulse")).otherwise(F.col("fact.period"))
    alias = lambda k: F.concat(F.lit(f"macro:market_reaction:{config.country}:"), label, F.lit(":"), F.date_format(F.date_sub(F.to_date("session"), k), "yyyy-MM-dd"))
    rows = rows.withColumn("session", F.when(reacted, session))
    return rows.select(
        key, "phase", label.alias("indicator"), F.when(~policy, F.col("fact.period")).alias("period"), "session",
        F.concat(F.lit("macro:"), "phase", F.lit(f":{config.country}:"), label, F.lit(":"), suffix).alias("dedup_key"),
        F.when(F.col("phase") == "market_reaction", F.array(*[alias(k) for k in range(ALIAS_SESSIONS)])).otherwise(F.array().cast("array<string>")).alias("aliases"),
        (F.when(policy, IMPULSE_DAYS).otherwise(LOOK_BACK_DAYS) * 1440).cast("long").alias("minutes"),
        F.substring(F.when(policy, F.col("text")).otherwise(F.col("fact.claim")), 1, QUOTE).alias("quote"),
    )
