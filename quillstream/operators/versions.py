"""Versioned state from append-only history: current rows, merged items, ledgers, lookups.

Everything is one pass of grouping by the item's key, with the order of versions as a column. Where the
latest row is enough it is a maximum by order, which combines before the shuffle; windows are used only
where several rows of a key come back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``; combines on the map side."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``order``."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    low = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(low.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first whole row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: How a column of a merged item follows from its versions.
NEWEST, FILLED, LONGEST, OLDEST = "newest", "filled", "longest", "oldest"


def merge_versions(df: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, str | tuple[str, str]], promote: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per key out of its versions.

    ``newest``: of the last version. ``filled``: the last that is not empty (or not the placeholder in a pair).
    ``longest``: the longest, of equals the last. ``oldest``: of the first version. ``promote`` (column, from, to):
    the first version's value, but ``to`` once a later version has it and the value was ``from``.
    """
    at = F.struct(*order)
    out = []
    for name, rule in rules.items():
        kind, placeholder = rule if isinstance(rule, tuple) else (rule, "")
        c = F.col(name)
        if kind == NEWEST:
            value = F.max_by(c, at)
        elif kind == OLDEST:
            value = F.min_by(c, at)
        elif kind == LONGEST:
            value = F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), *order))
        else:
            usable = F.coalesce(c, F.lit("")) != placeholder
            value = F.coalesce(F.max_by(F.when(usable, c), F.when(usable, at)), F.min_by(c, at))
        out.append(value.alias(name))
    if promote:
        name, low, high = promote
        start = F.min_by(F.col(name), at)
        out.append(F.when((start == low) & F.bool_or(F.col(name) == high), high).otherwise(start).alias(name))
    return df.groupBy(*keys).agg(*out, F.count("*").alias("n_versions"))


def with_current(items: DataFrame, versions: DataFrame, item_key: str, version_key: str, order: Sequence[str], columns: Sequence[str], how: str = "left") -> DataFrame:
    """Items joined with the current (latest) version of each."""
    current = latest(versions, [version_key], order, [version_key, *columns])
    return items.join(current, items[item_key] == current[version_key], how).drop(current[version_key])


def delivery_summary(deliveries: DataFrame, key: str, sent: Column, order: str = "id", at: str = "sent_at", status: str = "status") -> DataFrame:
    """Per item: latest status, latest sent id, last time sent, in one aggregation."""
    return deliveries.groupBy(key).agg(
        F.max_by(status, order).alias("delivery_status"), F.max(F.when(sent, F.col(order))).alias("delivery_id"), F.max(F.when(sent, F.col(at))).alias("delivery_sent_at")
    )


def admit_new(found: DataFrame, ledger: DataFrame, keys: Sequence[str], source: str, retryable: Column) -> DataFrame:
    """New rows, and rows the ledger marks as retryable; ``is_baseline`` where the ledger has never seen the source.

    The first run of a source only sets its baseline.
    """
    known = ledger.select(*keys, retryable.alias("_retry")).distinct()
    sources = ledger.select(F.col(source).alias("_seen")).distinct()
    fresh = found.join(known, list(keys), "left").where(F.col("_retry").isNull() | F.col("_retry")).withColumn("is_retry", F.coalesce("_retry", F.lit(False))).drop("_retry")
    return fresh.join(sources, fresh[source] == sources["_seen"], "left").withColumn("is_baseline", F.col("_seen").isNull()).drop("_seen")


def beyond_watermark(rows: DataFrame, state: DataFrame, channel: str, order: str) -> DataFrame:
    """Rows above the highest order seen of their channel; all rows of a channel without state."""
    return rows.join(state.select(channel, F.col("watermark")), channel, "left").where(F.col("watermark").isNull() | (F.col(order) > F.col("watermark"))).drop("watermark")


def next_watermark(rows: DataFrame, state: DataFrame, channel: str, order: str) -> DataFrame:
    """State after ``rows``: it never falls."""
    return state.select(channel, "watermark").unionByName(rows.groupBy(channel).agg(F.max(order).alias("watermark"))).groupBy(channel).agg(F.max("watermark").alias("watermark"))


def difference(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): added, removed, changed or same, null-safe."""
    a = old.select(F.col(key).alias("_a"), F.struct(*columns).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*columns).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def until_known(pages: DataFrame, listing: Sequence[str], order: str, known: Column) -> DataFrame:
    """Pages of a listing up to and with the first that holds a known id."""
    w = Window.partitionBy(*listing).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("_met", F.coalesce(F.max(known.cast("int")).over(w), F.lit(0))).where("_met = 0").drop("_met")
