"""Identities of company events: every defensible (company, event, period, scope, stage) that a text tells.

A text is cut into claims, claims are crossed with the companies that they name, and each pair is read once: as
earnings, or else as the first family of events whose words the claim has. A pair becomes a key that hashes its scope
(counterparties, objects, or else amounts), and an item may have several; they go to the reservations as one set of facts.

Companies of a claim are, in this order: the item's own targets that the claim names; names before a listing
code in brackets; what stands before the last colon; and names before a word of action. Names are cleaned of
brackets, codes, share classes, legal forms and trailing objects, mapped to their canonical spelling, and refused if they are
no names.

Defined results: null fields are empty texts; claims that are equal but for case count once; a claim without a
company, a family or a reference has no row; without a published time only texts with a full date or year have a
reference. Equal keys of one item are told once, by the first claim.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators.macro_events import any_of
from quillstream.session import checkpointed

#: The rule's name, its look-backs in days, and how many amounts, objects, counterparties and aliases count.
RULE, LOOK_BACK_DAYS, SHORT_DAYS, ANCHORS, OBJECTS, PARTIES, QUOTE = "company_event_dedup", 90, 30, 8, 6, 4, 700
#: A company before its listing code, and amounts.
CODED = r"(?i)([一-鿿A-Za-z][一-鿿A-Za-z0-9·・.&\- ]{1,30}?)\s*[（(](\d{6}\.(?:SZ|SH|BJ))"
AMOUNT = r"(?i)(?<![A-Za-z0-9])(?:\d+(?:\.\d+)?(?:万|萬|亿|億|千)?(?:元|美元|港元|欧元|歐元)|\d+(?:\.\d+)?%)"
#: Words of reporting periods, the first that a claim has counts.
PERIODS = (
    ("H1", "上半年|半年度|h1|first half"), ("H2", "下半年|h2|second half"), ("Q1", "一季度|第一季度|q1|first quarter"), ("Q2", "二季度|第二季度|q2|second quarter"),
    ("Q3", "三季度|第三季度|q3|third quarter"), ("Q4", "四季度|第四季度|q4|fourth quarter"), ("FY", "全年|年度|full year|fy"),
)


@dataclass(frozen=True)
class CompanyConfig:
    #: Families of events in order, with their words.
    families: dict[str, tuple[str, ...]]
    metric_terms: tuple[str, ...] = ()
    forecast_terms: tuple[str, ...] = ()
    result_terms: tuple[str, ...] = ()
    #: Stages in order, with their words; ``revision`` first, as it hashes what the claim says.
    correction_terms: tuple[str, ...] = ()
    stages: dict[str, tuple[str, ...]] = field(default_factory=dict)
    proposed_terms: tuple[str, ...] = ()
    #: Of some families the stage if a word is there, and else.
    turns: dict[str, tuple[tuple[str, ...], str, str]] = field(default_factory=dict)
    action_terms: tuple[str, ...] = ()
    object_terms: tuple[str, ...] = ()
    party_patterns: tuple[str, ...] = ()
    legal_forms: tuple[str, ...] = ()
    trailing: tuple[str, ...] = ()
    leading: tuple[str, ...] = ()
    canonical: dict[str, str] = field(default_factory=dict)
    no_names: tuple[str, ...] = ()
    no_parts: tuple[str, ...] = ()
    #: Families without a scope, and families with the short look-back.
    broad: tuple[str, ...] = ()
    short: tuple[str, ...] = ()
    #: Families dated by the month that a change begins in.
    monthly: tuple[str, ...] = ()
    zone_hours: int = 8


def claims(items: DataFrame, key: str, parts: Sequence[str], at: str, targets: str | None, zone_hours: int = 8) -> DataFrame:
    """(key, at, targets, place, claim): the claims of each item, markup gone, white space folded, equal ones once; ``at`` is local."""
    body = F.array_join(F.filter(F.array(*[T.text_of(F.col(p)) for p in parts]), lambda x: x != ""), "\n")
    plain = F.regexp_replace(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    cut = F.filter(F.transform(F.split(plain, r"[。！？!?；;\n]+"), lambda c: F.btrim(T.collapse(c), F.lit(" -—–"))), lambda c: c != "")
    once = F.filter("_cut", lambda c, i: F.array_position("_low", F.lower(c)) == i + 1)
    own = F.array().cast("array<struct<name:string,code:string>>") if targets is None else F.coalesce(F.col(targets), F.array()).cast("array<struct<name:string,code:string>>")
    local = F.col(at).cast("timestamp") + F.expr(f"INTERVAL {zone_hours} HOURS")
    # What several expressions read is a column of its own, so that it is made once.
    rows = items.select(key, local.alias("at"), own.alias("targets"), cut.alias("_cut")).withColumn("_low", F.transform("_cut", lambda c: F.lower(c)))
    return rows.select(key, "at", "targets", F.posexplode(once).alias("place", "claim"))


def company_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]+", "")


def spelled(raw: Column, config: CompanyConfig) -> Column:
    """A name without brackets, leading words, codes, share classes, legal forms and trailing objects."""
    edges = F.lit(" ，,:：-—")
    name = T.strip(F.regexp_replace(T.text_of(raw), r"^[【\[]|[】\]]$", ""))
    if config.leading:
        name = F.regexp_replace(name, rf"^(?:{any_of(config.leading)}|\d+月\d+日)", "")
    name = F.element_at(F.split(F.btrim(name, edges), "——"), -1)
    name = T.strip(F.regexp_replace(name, r"(?i)[（(]\d{6}\.(?:SZ|SH|BJ)[）)].*$", ""))
    name = T.strip(F.regexp_replace(name, r"(?i)[-—](?:UW|U|W)$", ""))
    if config.legal_forms:  # only a form that leaves two characters goes
        name = T.strip(F.regexp_replace(name, rf"(?i)^(.{{2,}}?){any_of(config.legal_forms)}$", "$1"))
    name = F.btrim(F.regexp_replace(name, r"\s+", " "), edges)
    for word in config.trailing:
        name = T.strip(F.regexp_replace(name, rf"^(.{{2,}}){re.escape(word)}$", "$1"))
    return name


def canonical(name: Column, config: CompanyConfig) -> Column:
    """The canonical spelling of a name that is spelled otherwise."""
    key = company_key(name)
    return F.coalesce(*[F.when(key == other, F.lit(own)) for other, own in config.canonical.items()], name)


def is_name(name: Column, config: CompanyConfig) -> Column:
    low = F.lower(name)
    bad = name.isin(*config.no_names) if config.no_names else F.lit(False)
    bad = bad | ~F.length(name).between(2, 32) | name.rlike(r"^\d|与|與") | ~name.rlike(r"[一-鿿A-Za-z]") | (name.rlike(r"[一-鿿]") & (F.length(name) > 14))
    for part in config.no_parts:
        bad = bad | low.contains(part.lower())
    return ~bad


def company_name(raw: Column, config: CompanyConfig) -> Column:
    """A company's name as it is compared; empty where it is no name. For short lists; tables of names go step by step, see ``companies``."""
    name = canonical(spelled(raw, config), config)
    return F.when(is_name(name, config), name).otherwise("")


def named(cut: DataFrame, config: CompanyConfig) -> DataFrame:
    """``cut`` with a row for each name (rank, f) that a claim may have, as it is written."""
    claim, low = F.col("claim"), F.lower("claim")
    own = F.filter("targets", lambda t: ((F.coalesce(t["name"], F.lit("")) != "") & low.contains(F.lower(t["name"]))) | ((F.coalesce(t["code"], F.lit("")) != "") & low.contains(F.lower(t["code"]))))
    found = lambda pattern: F.transform(F.regexp_extract_all(claim, F.lit(pattern), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit("").alias("code")))
    codes = lambda k: F.regexp_extract_all(claim, F.lit(CODED), F.lit(k))
    coded = F.zip_with(codes(1), codes(2), lambda n, c: F.struct(n.alias("name"), F.upper(c).alias("code")))
    parts = F.split(claim, "[：:]")
    headed = F.when(F.size(parts) > 1, F.array(F.struct(F.get(parts, F.size(parts) - 2).alias("name"), F.lit("").alias("code")))).otherwise(F.array().cast("array<struct<name:string,code:string>>"))
    acting = rf"(?i)(?:^|[，,；;。：:])([^，,；;。:：]{{2,36}}?)(?:\s*[（(]\d{{6}}\.(?:SZ|SH|BJ)[）)])?\s*{any_of(config.action_terms)}"
    told = cut.withColumn("found", F.concat(own.cast("array<struct<name:string,code:string>>"), coded, headed, found(acting)))
    # A plain posexplode would first filter by the list, and so search for the names once more for each condition.
    return told.drop("targets").select("*", F.posexplode_outer("found").alias("rank", "f")).drop("found").where("f IS NOT NULL")


def companies(cut: DataFrame, key: str, config: CompanyConfig) -> DataFrame:
    """``cut`` with a row for each company that a claim names: ``company``, ``company_key``, ``code``."""
    rows = named(cut, config)
    # Written once: a condition on names would otherwise be made of the whole chain of patterns, many times over.
    rows = checkpointed(rows.withColumn("_spelled", spelled(F.col("f.name"), config)))
    rows = rows.withColumn("company", canonical(F.col("_spelled"), config)).where(is_name(F.col("company"), config))
    rows = rows.withColumn("company_key", company_key(F.col("company"))).where("company_key <> ''")
    first = F.row_number().over(Window.partitionBy(key, "place", "company_key").orderBy("rank"))
    return rows.withColumn("code", F.coalesce("f.code", F.lit(""))).withColumn("_first", first).where("_first = 1").drop("f", "_spelled", "_first")


def reporting_period(claim: Column, at: Column) -> Column:
    """``2024-Q1`` of the first period that a claim names; the year is that of the publication where it has none."""
    told = []
    for suffix, words in PERIODS:
        pattern = rf"(?i)(?:(20\d{{2}})年)?(?:{words})"
        year = F.coalesce(F.nullif(F.regexp_extract(claim, pattern, 1), F.lit("")), F.year(at).cast("string"))
        told.append(F.when(claim.rlike(pattern) & year.isNotNull(), F.concat(year, F.lit(f"-{suffix}"))))
    return F.coalesce(*told)


def event_date(claim: Column, at: Column) -> Column:
    """The date that a claim tells, in full or in the year of the publication, or else the day of the publication."""
    full, partial = r"(20\d{2})[年/-](1[0-2]|0?[1-9])[月/-](3[01]|[12]\d|0?[1-9])日?", r"(1[0-2]|[1-9])月(3[01]|[12]\d|[1-9])日"
    two = lambda pattern, k: F.lpad(F.regexp_extract(claim, pattern, k), 2, "0")
    whole = F.when(claim.rlike(full), F.concat_ws("-", F.regexp_extract(claim, full, 1), two(full, 2), two(full, 3)))
    near = F.when(claim.rlike(partial) & at.isNotNull(), F.concat_ws("-", F.year(at).cast("string"), two(partial, 1), two(partial, 2)))
    return F.coalesce(whole, near, F.date_format(at, "yyyy-MM-dd"))


def anchors(claim: Column) -> Column:
    """The distinct amounts of a claim, in one spelling, the first eight."""
    one = lambda v: F.lower(F.replace(F.replace(F.replace(v, F.lit(",")), F.lit("萬"), F.lit("万")), F.lit("億"), F.lit("亿")))
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(claim, F.lit(AMOUNT), F.lit(0)), one)), 1, ANCHORS)


def stage_of(claim: Column, family: Column, config: CompanyConfig) -> Column:
    said = F.array_join(anchors(claim), "|")
    revision = F.concat(F.lit("revision-"), F.substring(F.sha2(F.when(said != "", said).otherwise(F.substring(F.lower(T.collapse(claim)), 1, 160)), 256), 1, 10))
    told = [F.when(T.contains_any(claim, config.correction_terms), revision)]
    told += [F.when(T.contains_any(claim, terms), F.lit(name)) for name, terms in config.stages.items()]
    told.append(F.when(family == "earnings", F.when(T.contains_any(claim, config.forecast_terms), "forecast").otherwise("results")))
    told += [F.when(family == name, F.when(T.contains_any(claim, terms), yes).otherwise(no)) for name, (terms, yes, no) in config.turns.items()]
    told.append(F.when(T.contains_any(claim, config.proposed_terms), "proposed"))
    return F.coalesce(*told, F.lit("announced"))


def identities(items: DataFrame, config: CompanyConfig, key: str = "id", parts: Sequence[str] = ("title", "summary", "full_text"), at: str = "published_at", targets: str | None = None) -> DataFrame:
    """(key, place, rank, company, code, family, reference, stage, scope, dedup_key, minutes, quote): the events of each item."""
    cut = claims(items, key, parts, at, targets, config.zone_hours)
    rows = companies(cut, key, config)
    claim, when = F.col("claim"), F.col("at")
    period = reporting_period(claim, when)
    earnings = T.contains_any(claim, config.metric_terms) & (T.contains_any(claim, config.forecast_terms) | T.contains_any(claim, config.result_terms)) & F.col("period").isNotNull()
    family = F.coalesce(F.when(earnings, "earnings"), *[F.when(T.contains_any(claim, terms), F.lit(name)) for name, terms in config.families.items()])
    rows = checkpointed(rows.withColumn("period", period)).withColumn("family", family)
    rows = checkpointed(rows).where("family IS NOT NULL")

    starts = r"(?:(20\d{2})年)?(1[0-2]|[1-9])月(?:起|开始|開始)"
    year = F.coalesce(F.nullif(F.regexp_extract(claim, starts, 1), F.lit("")), F.year(when).cast("string"))
    month = F.when(claim.rlike(starts), F.concat_ws("-", year, F.lpad(F.regexp_extract(claim, starts, 2), 2, "0"))).when(claim.rlike("本月(?:起|开始|開始)"), F.date_format(when, "yyyy-MM"))
    monthly = F.col("family").isin(*config.monthly) if config.monthly else F.lit(False)
    reference = F.when(monthly & month.isNotNull(), month).otherwise(F.coalesce("period", event_date(claim, when)))

    found = lambda p: F.regexp_extract_all(claim, F.lit(p), F.lit(1))
    parties = F.flatten(F.array(*[found(p) for p in config.party_patterns])) if config.party_patterns else F.array().cast("array<string>")
    others = F.filter(F.transform(parties, lambda p: company_key(company_name(p, config))), lambda k: (k != "") & (k != F.col("company_key")))
    objects = F.array_compact(F.array(*[F.when(F.lower(claim).contains(o.lower()), F.lit(o.lower())) for o in config.object_terms])) if config.object_terms else F.array().cast("array<string>")
    broad = F.col("family").isin("earnings", *config.broad)
    named = F.concat(F.slice(F.array_distinct(others), 1, PARTIES), F.slice(objects, 1, OBJECTS))
    scope = F.when(broad, F.array().cast("array<string>")).when(F.size(named) > 0, named).otherwise(F.slice(anchors(claim), 1, 2))
    rows = checkpointed(rows.withColumns({"reference": reference, "scope": scope, "stage": stage_of(claim, F.col("family"), config)}))
    rows = rows.where(F.col("reference").isNotNull() & (broad | (F.size("scope") > 0)))
    hashed = F.when(F.size("scope") > 0, F.substring(F.sha2(F.array_join("scope", "|"), 256), 1, 12)).otherwise("general")
    event = F.concat_ws(":", "company_key", "family", "reference", hashed)
    days = F.when(F.col("family").isin(*config.short), SHORT_DAYS).otherwise(LOOK_BACK_DAYS) if config.short else F.lit(LOOK_BACK_DAYS)
    told = rows.withColumns({"dedup_key": F.concat(F.lit("company_event:"), event, F.lit(":v:"), "stage"), "minutes": (days * 1440).cast("long"), "quote": F.substring(claim, 1, QUOTE)})
    columns = ("place", "rank", "company", "code", "family", "reference", "stage", "scope", "minutes", "quote")
    return told.groupBy(key, "dedup_key").agg(F.min_by(F.struct(*columns), F.struct("place", "rank")).alias("e")).select(key, "e.*", "dedup_key").select(key, *columns[:8], "dedup_key", *columns[8:])
