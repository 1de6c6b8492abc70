"""Read models: overlays, probes across sources, selections, counts with totals, and lists with what they leave out.

Each is a grouping or a join on the caller's columns. Lists are cut by rank within the tasks first, so a group of very
many rows sends few. Nulls: a null key is a key of its own unless said otherwise; a null order goes first; ties
are broken by the columns named last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T


def first_kind(kinds: dict[str, Column], default: str = "none") -> Column:
    """The name of the first kind, in order, whose value is not null (an identity) and not false (a flag)."""
    told = []
    for name, value in kinds.items():
        there = value.isNotNull()
        told.append(F.when(there & (F.lower(value.cast("string")) != "false"), F.lit(name)))
    return F.coalesce(*told, F.lit(default))


def backfilled(stored: DataFrame, details: DataFrame, key: str, column: str, order: Sequence[str], placeholders: Sequence[str] = ("", "-")) -> DataFrame:
    """``stored`` with ``column`` from the last non-empty detail of its key where it is null or a placeholder; else as it is."""
    fresh = details.where(T.strip(T.text_of(F.col(column))) != "").groupBy(F.col(key).alias("_key")).agg(F.max_by(column, F.struct(*order)).alias("_fresh"))
    empty = F.col(column).isNull() | T.strip(T.text_of(F.col(column))).isin(*placeholders)
    joined = stored.join(fresh, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(column, F.when(empty, F.coalesce("_fresh", column)).otherwise(F.col(column))).drop("_key", "_fresh")


def overlaid(profiles: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str], disabled: str = "disabled") -> DataFrame:
    """``profiles`` with the non-null ``columns`` of their overrides and ``disabled``, false without one; overrides without a profile add no row.

    Of several overrides of a key the greatest value of each column counts.
    """
    over = overrides.groupBy(F.col(key).alias("_key")).agg(*[F.max(c).alias(f"_{c}") for c in columns], F.bool_or(disabled).alias("_off"))
    laid = profiles.drop(disabled).join(over, F.col(key) == F.col("_key"), "left")
    return laid.withColumns({**{c: F.coalesce(f"_{c}", c) for c in columns}, disabled: F.coalesce("_off", F.lit(False))}).drop("_key", "_off", *[f"_{c}" for c in columns])


def ordered_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """(keys, out): the distinct values of each key in the order of their first rows; equal places go by the value. Nulls are left out."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_place"))
    listed = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", value))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda e: e[value]).alias(out))


def cross_source(items: DataFrame, item: str, source: str, title: str, url: str | None, at: str, sources: Sequence[str] | None = None, hours: int | None = None) -> DataFrame:
    """(item, duplicate_of, by): the first earlier item of *another* source with the same URL, or else the same title.

    Titles are compared trimmed, URLs as they are; empty ones match nothing. ``sources`` limits who is compared, ``hours`` how far back.
    A key that a source fills with very many rows is met by the first row of each other source alone, unless ``hours`` asks for the nearest.
    """
    rows = items if sources is None else items.where(F.col(source).isin(*sources))
    place = F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(item).alias("i"))
    base = rows.where(F.col(at).isNotNull() & F.col(source).isNotNull()).select(F.col(item).alias("_item"), F.col(source).alias("_source"), place.alias("_place"), F.trim(T.text_of(F.col(title))).alias("_title"), (F.lit("") if url is None else T.text_of(F.col(url))).alias("_url"))

    def matched(column: str, name: str) -> DataFrame:
        keyed = base.where(F.col(column) != "")
        # The last row before of another source: the last of the key, or the last before the run of the own source began.
        order = Window.partitionBy(column).orderBy("_place")
        previous = keyed.withColumn("_before", F.lag(F.struct("_source", "_item", "_place")).over(order))
        change = F.when(F.col("_before").isNotNull() & (F.col("_before._source") != F.col("_source")), F.col("_before"))
        if hours is None:  # the first row of the key, or the first of another source than it
            first = keyed.groupBy(column).agg(F.min(F.struct("_place", "_source", "_item")).alias("a"))
            other = keyed.join(first, column).where(F.col("_source") != F.col("a._source")).groupBy(column).agg(F.min(F.struct("_place", "_source", "_item")).alias("b"))
            both = keyed.join(first, column).join(other, column, "left")
            pick = F.when(F.col("a._source") != F.col("_source"), F.col("a")).otherwise(F.col("b"))
            found = both.withColumn("p", pick).where(F.col("p._place") < F.col("_place"))
        else:
            other = F.last(change, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            found = previous.withColumn("_change", change).withColumn("p", other).where(F.col("p").isNotNull() & (F.col("p._source") != F.col("_source")))
            found = found.where(F.col("_place.t") - F.col("p._place.t") <= hours * 3_600_000_000)
        return found.select("_item", F.col("p._item").alias(name))

    by_url, by_title = matched("_url", "_u"), matched("_title", "_t")
    out = items.select(item).join(by_url.withColumnRenamed("_item", item), item, "left").join(by_title.withColumnRenamed("_item", item), item, "left")
    return out.select(item, F.coalesce("_u", "_t").alias("duplicate_of"), F.when(F.col("_u").isNotNull(), "url").when(F.col("_t").isNotNull(), "title").alias("by"))


def usage(attempts: DataFrame, keys: Sequence[str], failed: Column, tokens: Column) -> DataFrame:
    """(keys, attempts, failed, tokens, status): status is ok, failed if all failed, else partial; null tokens count 0."""
    bad = F.coalesce(failed, F.lit(False))
    made = attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(bad).alias("failed"), F.sum(F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"))
    return made.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("failed") == F.col("attempts"), "failed").otherwise("partial"))


def shown_and_omitted(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, most: int) -> DataFrame:
    """(keys, shown, omitted): the first ``most`` values of each key in order, and how many are left out."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("_n", turn).where(F.col("_n") <= most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda e: e[value]).alias("shown"))
    counts = rows.groupBy(*keys).agg(F.greatest(F.count("*") - most, F.lit(0)).cast("long").alias("omitted"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return counts.join(first.withColumnsRenamed({k: f"_{k}" for k in keys}), same).select(*keys, "shown", "omitted")


def decision_counts(decisions: DataFrame, keys: Sequence[str], at: str, completed: Column, uncertain: Column, failed: Column | None = None) -> DataFrame:
    """(keys, n, completed, uncertain, failed, uncertain_then_completed): whether one was completed after an uncertain one."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    then = F.coalesce(F.min(F.when(yes(uncertain), F.col(at))) < F.max(F.when(yes(completed), F.col(at))), F.lit(False))
    bad = F.lit(False) if failed is None else yes(failed)
    return decisions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(yes(completed)).alias("completed"), F.count_if(yes(uncertain)).alias("uncertain"), F.count_if(bad).alias("failed"), then.alias("uncertain_then_completed"))


def top_issues(sources: DataFrame, source: str, failures: str, updated: str, most: int) -> DataFrame:
    """The ``most`` sources with failures: most failures first, then the latest, then by name. The limit is the feature."""
    return sources.where(F.col(failures) > 0).orderBy(F.desc(failures), F.desc_nulls_last(updated), source).limit(most)


def health_totals(sources: DataFrame, failures: str, alert_from: int = 3, issues: int = 50) -> DataFrame:
    """One row (sources, healthy, degraded, failing, failures, issues, truncated): failing from ``alert_from`` failures on; ``issues`` of at most that many are listed elsewhere."""
    n = F.coalesce(F.col(failures), F.lit(0))
    made = sources.agg(F.count("*").alias("sources"), F.count_if(n == 0).alias("healthy"), F.count_if((n > 0) & (n < alert_from)).alias("degraded"), F.count_if(n >= alert_from).alias("failing"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("failures"))
    bad = F.col("degraded") + F.col("failing")
    return made.select("*", F.least(bad, F.lit(issues)).cast("long").alias("issues"), (bad > issues).alias("truncated"))


def union_as(parts: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    """Tables of different columns as one list; ``kind`` tells whose a row is, absent columns are null."""
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias(kind), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def preferred(rows: DataFrame, keys: Sequence[str], actual: Column, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, columns, is_actual): of each key's rows the first actual one, or else the first; a null flag is not actual."""
    flag = F.coalesce(actual, F.lit(False))
    place = F.struct((~flag).alias("_a"), *order)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), place).alias("_r"), F.bool_or(flag).alias("is_actual")).select(*keys, *[F.col("_r")[c].alias(c) for c in columns], "is_actual")


def first_seen(rows: DataFrame, item: str, source: str, at: str, tie: str) -> DataFrame:
    """(item, first_source, first_seen, n_sources): an item is new once, in whatever source it is seen first."""
    return rows.groupBy(item).agg(F.min_by(source, F.struct(at, tie)).alias("first_source"), F.min(at).alias("first_seen"), F.countDistinct(source).alias("n_sources"))


def preview_selection(items: DataFrame, item: str, source: str, state: str, per_source: int, wanted: Sequence = ()) -> DataFrame:
    """(item, state): new items, those to retry, the first ``per_source`` unpushed ones of each source, and those asked for, each once."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(item))
    waiting = items.where(F.col(state) == "unpushed").withColumn("_n", turn).where(F.col("_n") <= per_source).select(item, state)
    asked = F.col(item).isin(*wanted) if len(wanted) else F.lit(False)
    chosen = items.where(F.col(state).isin("new", "retry") | asked).select(item, state)
    return chosen.unionByName(waiting.where(~asked))


def missing(held: DataFrame, cache: DataFrame, code: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n_symbols, n_missing, first_missing): codes that the cache lacks; repeated codes of the cache count once."""
    known = cache.select(F.col(code).alias("_code")).distinct().withColumn("_known", F.lit(True))
    lacks = F.col("_known").isNull()
    found = held.join(known, F.col(code) == F.col("_code"), "left").groupBy(*keys)
    return found.agg(F.count("*").alias("n_symbols"), F.count_if(lacks).alias("n_missing"), F.min(F.when(lacks, F.col(code))).alias("first_missing"))


def compared(stored: DataFrame, config: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, state): ``equal``, ``differs``, ``only_table`` or ``only_config``, null-safe over ``columns``."""
    a, b = (rows.select(F.col(key).alias(f"_{n}"), F.struct(*columns).alias(n)) for n, rows in (("stored", stored), ("config", config)))
    state = F.when(F.col("config").isNull(), "only_table").when(F.col("stored").isNull(), "only_config").when(F.col("stored").eqNullSafe(F.col("config")), "equal").otherwise("differs")
    return a.join(b, F.col("_stored") == F.col("_config"), "full").select(F.coalesce("_stored", "_config").alias(key), state.alias("state"))


def recent_examples(labels: DataFrame, item: str, label: str, shown: Column, at: str, most: int = 100) -> DataFrame:
    """(item, labels, at): the ``most`` items with the newest feedback and their labels, told by ``shown``. The limit is the feature."""
    last = labels.withColumn("_shown", shown).groupBy(item, label, "_shown").agg(F.max(at).alias(at))
    listed = last.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct(label, "_shown"))), lambda e: e["_shown"]).alias("labels"), F.max(at).alias(at))
    return listed.orderBy(F.desc_nulls_last(at), item).limit(most)


def counts_by_category(profiles: DataFrame, category: str, categories: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """(place, category, n, flags…): counts in the fixed order of ``categories``, also of those without profiles."""
    counts = profiles.groupBy(F.col(category).alias("_category")).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])
    order = profiles.sparkSession.createDataFrame(list(enumerate(categories)), "place int, category string")
    return order.join(counts, F.col("category") == F.col("_category"), "left").drop("_category").na.fill(0, ["n", *flags])


def interval_members(starts: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, start_id: str, mark_id: str) -> DataFrame:
    """(start_id, mark_id last, n): marks of an identity that lie between a start, at it or after, and the identity's next start.

    As the intervals of one identity do not overlap, a mark belongs to the last start before it: one window, no join by range.
    """
    both = starts.select(*keys, at, F.col(start_id).alias("_id"), F.lit(0).alias("_kind")).unionByName(marks.select(*keys, at, F.col(mark_id).alias("_id"), F.lit(1).alias("_kind")))
    start = F.last(F.when(F.col("_kind") == 0, F.col("_id")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "_kind", "_id"))
    inside = both.withColumn("_start", start).where("_kind = 1").groupBy(F.col("_start").alias(start_id)).agg(F.max("_id").alias("last_mark"), F.count("*").alias("n"))
    return starts.select(start_id).join(inside, start_id, "left").select(start_id, "last_mark", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
