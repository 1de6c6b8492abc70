"""Review lifecycle, ledgers, probes and summaries, folded from append-only rows.

State is never updated in place: a review, an admission or a retry is a row, and what is current follows
from one grouping of the rows of an item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admissions_recorded(admissions: DataFrame, key: str, order: Sequence[str], same: Sequence[str], forced: Column) -> DataFrame:
    """``admissions`` with ``recorded``: whether an admission starts a review, as it differs from the one before it or is forced."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*same)).over(w)
    return admissions.withColumn("recorded", before.isNull() | ~F.struct(*same).eqNullSafe(before) | forced)


def reviews(log: DataFrame, key: str, order: Sequence[str], started: Column, completed: Column, failed: Column) -> DataFrame:
    """(key, status, n_reviews, n_completed, n_failed, last_review): an item's status mirrors its last review.

    A start demotes the review before it; completing or failing applies to the review that is current then.
    """
    at = F.struct(*order)
    last_start = F.max(F.when(started, at))
    last_end = F.max(F.when(completed | failed, at))
    ended_well = F.max_by(completed, F.when(completed | failed, at))
    done = log.groupBy(key).agg(
        F.count_if(started).alias("n_reviews"), F.count_if(completed).alias("n_completed"), F.count_if(failed).alias("n_failed"),
        last_start.alias("_start"), last_end.alias("_end"), ended_well.alias("_well"),
    )
    ended = F.col("_start").isNotNull() & (F.col("_end") > F.col("_start"))
    status = F.when(F.col("_start").isNull(), "baseline").when(ended & F.col("_well"), "completed").when(ended, "failed").otherwise("admitted_pending")
    return done.select(key, status.alias("status"), "n_reviews", "n_completed", "n_failed", F.col("_start")[order[-1]].alias("last_review"))


def latest_by_operator(clicks: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row of each key, nulls in keys being a key of their own."""
    top = F.max_by(F.struct(*columns), F.struct(*order))
    return clicks.groupBy(*keys).agg(top.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def discoveries_and_backlog(found: DataFrame, backlog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both tables as one with ``origin``; of a key in both, the discovery stays."""
    rest = backlog.join(found.select(*keys).distinct(), list(keys), "left_anti")
    return found.withColumn("origin", F.lit("found")).unionByName(rest.withColumn("origin", F.lit("backlog")), allowMissingColumns=True)


def probe(items: DataFrame, key: str, ledgers: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(key, match_kind, match_id): the ledger entry of the first kind that an item meets, by equality of one column.

    ``ledgers`` has (kind, table, column, id column) in order; every table is cut to the smallest id of each
    value first, so an item never multiplies.
    """
    out, found = items, []
    for k, (kind, rows, column, id_col) in enumerate(ledgers):
        one = rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias(f"_c{k}")).agg(F.min(id_col).alias(f"_id{k}"))
        out = out.join(one, out[column] == one[f"_c{k}"], "left").drop(f"_c{k}")
        found.append((F.col(f"_id{k}"), kind))
    match = F.coalesce(*[c for c, _ in found])
    kind = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in found], F.lit("new"))
    return out.select(key, kind.alias("match_kind"), match.alias("match_id"))


def probe_titles(items: DataFrame, ledger: DataFrame, key: str, title: str, at: str, entry: str, days: int) -> DataFrame:
    """(key, match_id): the ledger's entry of the same title nearest in time, at most ``days`` away; the earlier of two equally near.

    Entries and items of a title are ordered once: the last entry before an item and the first after it are all that can
    be nearest, so no item meets all entries of its title. Empty titles and null times match nothing.
    """
    a = items.select(F.col(key).alias("_key"), F.trim(F.coalesce(title, F.lit(""))).alias("_title"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).withColumn("_entry", F.lit(None).cast(ledger.schema[entry].dataType)).withColumn("_kind", F.lit(1))
    b = ledger.select(F.col(entry).alias("_entry"), F.trim(F.coalesce(title, F.lit(""))).alias("_title"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).groupBy("_title", "_t").agg(F.min("_entry").alias("_entry")).withColumn("_key", F.lit(None).cast(items.schema[key].dataType)).withColumn("_kind", F.lit(0))
    both = a.unionByName(b).where("_title <> '' AND _t IS NOT NULL")
    seen = F.when(F.col("_kind") == 0, F.struct("_t", "_entry"))
    before = F.last(seen, ignorenulls=True).over(Window.partitionBy("_title").orderBy("_t", "_kind"))
    after = F.last(seen, ignorenulls=True).over(Window.partitionBy("_title").orderBy(F.desc("_t"), "_kind"))
    near = both.withColumn("_b", before).withColumn("_a", after).where("_kind = 1")
    reach = lambda c: F.abs(F.col("_t") - F.col(f"{c}._t"))
    pick = F.when(F.col("_a").isNull() | (reach("_b") <= reach("_a")), F.col("_b")).otherwise(F.col("_a"))
    found = near.select("_key", pick.alias("_p"), "_t").where(F.abs(F.col("_t") - F.col("_p._t")) <= days * 86_400_000_000)
    return items.select(key).join(found.select(F.col("_key").alias(key), F.col("_p._entry").alias("match_id")), key, "left")


def merge_channels(rows: DataFrame, key: str, order: Sequence[str], channel: str, filled: Sequence[str]) -> DataFrame:
    """One row an item: its first row, with empty ``filled`` columns from the first row that has them, and its channels in first-seen order."""
    at = F.struct(*order)
    fills = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c) for c in filled]
    first_seen = rows.groupBy(key, channel).agg(F.min(at).alias("_at"))
    listed = first_seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", channel))), lambda e: e[channel]).alias("channels"))
    return rows.groupBy(key).agg(*fills, F.min(at)[order[-1]].alias("first_row")).join(listed, key)


def retry_queue(rows: DataFrame, source: str, first_seen: str, tie: str, attempts: str, most_attempts: int, per_source: int, expired: Column) -> DataFrame:
    """(… , state): rows that failed: ``failed_terminal`` once expired or out of attempts, else the oldest ``per_source`` of a source are ``retry``, later ones ``waiting``."""
    ended = expired | (F.col(attempts) >= most_attempts)
    turn = F.row_number().over(Window.partitionBy(source, "_ended").orderBy(first_seen, tie))
    state = F.when(F.col("_ended"), "failed_terminal").when(F.col("_turn") <= per_source, "retry").otherwise("waiting")
    return rows.withColumn("_ended", ended).withColumn("_turn", turn).withColumn("state", state).drop("_ended", "_turn")


def newest_kept(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The ``most`` newest rows of each key: a bounded state list."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def import_rows(stored: DataFrame, configured: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns, enabled, change): configured rows are upserted, stored ones that are not configured are disabled.

    A configured column that is null keeps what is stored.
    """
    a = stored.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    both = configured.select(key, *columns).join(a, F.col(key) == F.col("_k"), "full")
    gone, fresh = F.col(key).isNull(), F.col("_k").isNull()
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.col(c), F.col(f"_old_{c}")).eqNullSafe(F.col(f"_old_{c}"))
    change = F.when(gone, "disabled").when(fresh, "added").when(same, "kept").otherwise("changed")
    return both.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(c, f"_old_{c}").alias(c) for c in columns], (~gone).alias("enabled"), change.alias("change"))


def backoff(log: DataFrame, source: str, at: str, seconds: Column) -> DataFrame:
    """(source, skip_until): the latest end of a back-off that the rows of a source ask for; ``seconds`` is null where none is."""
    until = F.unix_micros(F.col(at).cast("timestamp")) + seconds.cast("long") * 1_000_000
    return log.groupBy(source).agg(F.max(until).alias("skip_until"))


def redact(rows: DataFrame, at: str, as_of: Column, columns: Sequence[str], days: int = 30, marker: str = "expired") -> DataFrame:
    """``rows`` with ``columns`` replaced by a marker once they are older than ``days``."""
    old = F.col(at) < as_of - F.expr(f"INTERVAL {days} DAYS")
    return rows.withColumns({c: F.when(old, marker).otherwise(F.col(c)) for c in columns}).withColumn("redacted", F.coalesce(old, F.lit(False)))
