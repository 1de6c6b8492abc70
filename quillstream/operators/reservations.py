"""Delivery reservations: one delivery a fact within its look-back, with aliases, fact sets, confirmation and release.

A key is looked up whatever the rule that reserved it. Reservations depend on each other through keys, aliases
and items of several keys only, so rows are dealt by connected sets of keys and folded in time order (see
events); the state is the last reservation of each key of one set. A connected set passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.events import folded
from quillstream.operators.graph import components
from quillstream.session import checkpointed

#: Aliases of a hit at most, days that an alias looks back at most, and the bounds and default of a look-back.
MOST_ALIASES, ALIAS_DAYS, MOST_DAYS, DEFAULT_DAYS = 16, 30, 90, 14
MINUTE = 60_000_000
_DAY = 24 * 60
_HIT = "struct<rule:string,key:string,aliases:array<string>,minutes:bigint>"


def look_back_minutes(minutes: Column, days: Column) -> Column:
    """The look-back of a hit: its minutes, or else its days, within one minute and 90 days."""
    by_days = F.least(F.greatest(F.coalesce(F.nullif(days.cast("bigint"), F.lit(0)), F.lit(DEFAULT_DAYS)), F.lit(1)), F.lit(MOST_DAYS)) * _DAY
    return F.least(F.greatest(F.coalesce(minutes.cast("bigint"), by_days), F.lit(1)), F.lit(MOST_DAYS * _DAY))


def hit(rule: Column, key: Column, aliases: Column, minutes: Column) -> Column:
    """One hit of an item: the rule, the key of the fact, other keys it was known by, and the look-back."""
    return F.struct(rule.cast("string").alias("rule"), key.cast("string").alias("key"), F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"), minutes.cast("bigint").alias("minutes"))


def _clean(hits: Column) -> Column:
    """Hits with a rule and a key, the first of each key, with at most 16 aliases, none blank or the key itself."""
    trimmed = F.transform(hits, lambda h: F.struct(F.trim(h["rule"]).alias("rule"), F.trim(h["key"]).alias("key"), h["aliases"].alias("aliases"), h["minutes"].alias("minutes")))
    told = F.filter(trimmed, lambda h: (F.coalesce(h["rule"], F.lit("")) != "") & (F.coalesce(h["key"], F.lit("")) != ""))
    keys = F.transform(told, lambda h: h["key"])
    once = F.filter(told, lambda h, i: F.array_position(keys, h["key"]) == i + 1)
    others = lambda h: F.slice(F.filter(F.coalesce(h["aliases"], F.array().cast("array<string>")), lambda a: (F.trim(a) != "") & (a != h["key"])), 1, MOST_ALIASES)
    return F.transform(once, lambda h: F.struct(h["rule"].alias("rule"), h["key"].alias("key"), others(h).alias("aliases"), F.least(F.greatest(h["minutes"], F.lit(1)), F.lit(MOST_DAYS * _DAY)).alias("minutes")))


def _existing(held: dict, hit: dict, t: int) -> str | None:
    """The key that covers a hit: its own within the look-back, or else the alias that was reserved earliest."""
    span = hit["minutes"] * MINUTE
    own = held.get(hit["key"])
    if own and own[0] >= t - span:
        return hit["key"]
    cut = t - min(span, ALIAS_DAYS * _DAY * MINUTE)
    near = [(held[a][0], a) for a in hit["aliases"] if a in held and held[a][0] >= cut]
    return min(near)[1] if near else None


def _fold(state: tuple[dict, dict], t: int, event: str, hits: list | None, outcome: str | None, later: bool) -> tuple:
    held, waiting = state  # key -> (time, sent, event); event -> keys that it reserved
    if hits is None:  # the outcome of an earlier item
        for key in waiting.pop(event, ()):
            if key in held and outcome == "sent":
                held[key] = (held[key][0], True, held[key][2])
            elif key in held and outcome == "failed" and not held[key][1]:
                del held[key]
        return state, (None, None, None, None)
    new, covered = [], []
    for h in hits:
        found = _existing(held, h, t)
        if found is None:
            new.append(h["key"])
            continue
        covered.append((h["key"], found, held[found][2]))
        if found != h["key"] and held[found][1]:
            held.setdefault(h["key"], (t, True, held[found][2]))
    for key in new:
        held[key] = (t, outcome == "sent" and not later, event)
    if new and later:
        waiting[event] = new
    elif outcome == "failed":
        for key in new:
            del held[key]
    status = ("failed" if outcome == "failed" else "reserved") if new else "duplicate"
    first = covered[0] if covered else (None, None, None)
    return state, (status, ",".join(new), first[1], first[2])


def reserve_sets(items: DataFrame, at: str, event_id: str, hits: str, outcome: str | None = None, settled_at: str | None = None) -> DataFrame:
    """(event_id, status, reserved, matched, first_event) of items with an array of ``hit``.

    An item is a duplicate if every hit of it is covered: its key was reserved within the look-back, or one of its
    aliases was (at most 30 days back). Otherwise all its new keys are reserved together: ``reserved`` lists them. A hit that
    an alias covers gives its own key the alias's reservation from now on, if that was sent and the key has none. ``outcome``
    is ``sent`` (confirms), ``failed`` (releases; the status is then ``failed``) or null (stays reserved); it takes effect at ``settled_at``, before
    items of that time, or at once. ``matched`` and ``first_event`` tell the first covered hit's reservation.
    Items without hits, time or id have no row; equal times go by the id as text; repeated ids are items of their own.
    """
    kind = items.schema[event_id].dataType
    result = F.lit(None).cast("string") if outcome is None else F.col(outcome)
    settled = F.lit(None).cast("timestamp") if settled_at is None else F.col(settled_at).cast("timestamp")
    rows = items.where(F.col(at).isNotNull() & F.col(event_id).isNotNull()).select(
        F.col(event_id).cast("string").alias("_event"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.unix_micros(settled).alias("_s"), result.alias("_outcome"), _clean(F.col(hits).cast(f"array<{_HIT}>")).alias("_hits")
    ).where(F.size("_hits") > 0)
    rows = checkpointed(rows.withColumn("_later", F.coalesce((F.col("_s") > F.col("_t")) & F.col("_outcome").isNotNull(), F.lit(False))))

    # All keys of an item and all their aliases are one set.
    keys = F.flatten(F.transform("_hits", lambda h: F.concat(F.array(h["key"]), h["aliases"])))
    links = rows.select(F.col("_hits")[0]["key"].alias("a"), F.explode(keys).alias("b")).distinct()
    sets = components(links)
    placed = rows.withColumn("_key", F.col("_hits")[0]["key"]).join(sets.withColumnRenamed("node", "_key"), "_key", "left").withColumn("_set", F.coalesce("root", "_key"))
    hits_ = placed.select("_set", "_t", F.lit(1).alias("_kind"), "_event", "_hits", "_outcome", "_later")
    ends = placed.where("_later").select("_set", F.col("_s").alias("_t"), F.lit(0).alias("_kind"), "_event", F.lit(None).cast(f"array<{_HIT}>").alias("_hits"), "_outcome", "_later")
    made = {"status": "string", "reserved": "string", "matched": "string", "first_event": "string"}
    done = folded(hits_.unionByName(ends), ["_set"], ["_t", "_kind", "_event"], ["_t", "_event", "_hits", "_outcome", "_later"], lambda: ({}, {}), _fold, made)
    told = done.where("_kind = 1")
    return told.select(F.col("_event").cast(kind).alias(event_id), "status", F.split(F.nullif("reserved", F.lit("")), ",").alias("reserved"), "matched", F.col("first_event").cast(kind).alias("first_event"))


def reserve(hits: DataFrame, rule: str, at: str, event_id: str, key: str, aliases: str, minutes: Column, outcome: str | None = None, settled_at: str | None = None) -> DataFrame:
    """``hits`` as (event_id, status, matched, first_event): reserved, duplicate or failed, each hit an item of its own (see ``reserve_sets``)."""
    rows = hits.withColumn("_one", F.array(hit(F.col(rule), F.col(key), F.col(aliases), minutes)))
    done = reserve_sets(rows, at, event_id, "_one", outcome, settled_at)
    return done.select(event_id, "status", F.coalesce("matched", F.when(F.col("status") == "reserved", F.get("reserved", F.lit(0)))).alias("matched"), "first_event")


def delivery_status(pushed: Column, existing: Column, duplicate: Column, failed: Column) -> Column:
    """The state of a delivery: existing, skipped, duplicate, failed or sent, the first that holds."""
    return F.when(existing, "existing").when(~pushed, "skipped").when(duplicate, "duplicate").when(failed, "failed").otherwise("sent")
