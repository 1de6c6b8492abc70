"""Ordered event operators: look-back suppression, fact sets, failure streaks and alerts, feedback folds.

Look-backs and alerts fold each key's events in order by ``scan``, which splits a key of any length over
many tasks. ``folded`` serves folds whose state is too large for that: rows are dealt by key and sorted in
their partitions and pass through one by one, so the events of one key pass through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstream.operators.scan import Alerts, LookBack, scanned


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], used: Sequence[str], start: Callable, step: Callable, made: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``made``: ``step(state, *used) -> (state, values)`` over each key's rows in order, from ``start()``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # The window deals and sorts; the sort after it costs nothing where that order holds.
    marked = rows.withColumn("_first", F.row_number().over(w) == 1).sortWithinPartitions(*keys, *order)
    read = ["_first", *used]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for first, *values in zip(*(batch.column(c).to_pylist() for c in read), strict=True):
                state, told = step(start() if first else state, *values)
                out.append(told)
            columns = zip(*out, strict=True) if out else [()] * len(made)
            arrays = [pa.array(c, kinds[k]) for c, k in zip(columns, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *made])

    schema = StructType([*marked.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in made.items())).fields])
    return marked.mapInArrow(fold, schema)


def look_back(events: DataFrame, keys: Sequence[str], at: str, event_id: str, minutes: int | Column) -> DataFrame:
    """(keys, event_id, at, duplicate, anchor): an event within the look-back of its key's last *kept* event is a duplicate.

    A suppressed event does not extend the window; the first one beyond it anchors anew. The bound is
    inclusive. Events are ordered by time, then id; a null time is dropped, a null key is a key.
    """
    span = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * 60_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.where(F.col(at).isNotNull()).select(*keys, event_id, at, micros.alias("_t"), span.alias("_span"))

    done = scanned(rows, keys, ["_t", event_id, "_span"], ["_t", "_span"], LookBack(), {"duplicate": "boolean", "_anchor": "bigint"})
    return done.select(*keys, event_id, at, "duplicate", F.timestamp_micros("_anchor").alias("anchor"))


def fact_set_duplicates(facts: DataFrame, item: str, key: str, at: str, minutes: int) -> DataFrame:
    """(item, n_facts, n_covered, duplicate): an item is a duplicate if every fact of it is covered.

    An uncovered fact is always kept, so each fact's history is its own and the folds run per fact.
    """
    one = facts.groupBy(item, key).agg(F.min(at).alias(at))
    marked = look_back(one, [key], at, item, minutes)
    return marked.groupBy(item).agg(F.count("*").alias("n_facts"), F.count_if("duplicate").alias("n_covered"), F.bool_and("duplicate").alias("duplicate"))


def failure_streaks(log: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """``log`` with ``streak``, the failures in a row up to and with each event (0 for a success), and ``before``, those just before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = log.withColumn("_failed", failed).withColumn("_run", run)
    inside = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(F.col("_failed").cast("int")).over(inside)
    counted = marked.withColumn("streak", streak)
    return counted.withColumn("before", F.coalesce(F.lag("streak").over(w), F.lit(0))).drop("_failed", "_run")


def alerts(log: DataFrame, keys: Sequence[str], at: str, event_id: str, failed: Column, threshold: int = 3, cooldown_minutes: int = 60) -> DataFrame:
    """(keys, event_id, at, kind): failure alerts from ``threshold`` failures in a row on, at most one a cooldown, and recoveries.

    A recovery is told if the streak that ended had reached the threshold, an alert was sent before, and
    the cooldown has passed since.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = log.select(*keys, F.col(event_id).cast("bigint").alias(event_id), at, micros.alias("_t"), failed.alias("_f"))
    fold = Alerts(threshold, cooldown_minutes * 60_000_000)
    done = scanned(rows, keys, ["_t", event_id, "_f"], ["_t", "_f"], fold, {"kind": "string"})
    return done.where("kind <> ''").select(*keys, event_id, at, "kind")


LABELS = ("high_value", "duplicate", "invalid")


def feedback_state(clicks: DataFrame, keys: Sequence[str], order: Sequence[str], event_id: str, label: str, reasons: str, at: str | None = None) -> DataFrame:
    """(keys, active_labels, reason_tags, last_id): what the clicks of a key leave active.

    Clicks are told once per event id. A click toggles its label; ``invalid`` with reasons only sets it.
    Reasons stay while ``invalid`` is active and are those of its last click. Clicks older than the last
    one count for nothing, which the order of events expresses already.
    """
    once = clicks.dropDuplicates([event_id])
    tags = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(reasons), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    rows = once.withColumn("_tags", tags).withColumn("_set", F.coalesce((F.col(label) == "invalid") & (F.size("_tags") > 0), F.lit(False)))
    place = F.struct(*order, event_id)
    w = Window.partitionBy(*keys, label).orderBy(*order, event_id).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_n", F.sum((~F.col("_set")).cast("long")).over(w))
    # Active is what the last setting click left, turned by each toggle after it.
    by = counted.groupBy(*keys, F.col(label).alias("_l")).agg(
        F.max("_n").alias("n"), F.max_by("_n", F.when(F.col("_set"), place)).alias("at_set"), F.max_by("_tags", place).alias("tags"), F.max(place).alias("last")
    )
    active = F.when(F.col("at_set").isNull(), F.col("n") % 2 == 1).otherwise((F.col("n") - F.col("at_set")) % 2 == 0)
    is_on = lambda x: F.coalesce(F.bool_or(active & (F.col("_l") == x)), F.lit(False))
    done = by.groupBy(*keys).agg(*[is_on(x).alias(f"_on{k}") for k, x in enumerate(LABELS)], F.max_by("tags", F.when(F.col("_l") == "invalid", F.col("last"))).alias("_tags"), F.max("last").alias("_last"))
    labels = F.array_compact(F.array(*[F.when(F.col(f"_on{k}"), F.lit(x)) for k, x in enumerate(LABELS)]))
    kept = F.when(F.col(f"_on{LABELS.index('invalid')}"), F.col("_tags")).otherwise(F.array().cast("array<string>"))
    return done.select(*keys, labels.alias("active_labels"), kept.alias("reason_tags"), F.col("_last")[event_id].alias("last_id"))


def quality(delivered: DataFrame, group: Column, labels: str, low_sample: int = 5) -> DataFrame:
    """Feedback quality per group: counts, coverage and rates rounded to four places."""
    has = lambda x: F.coalesce(F.array_contains(F.col(labels), x), F.lit(False))
    labelled = F.coalesce(F.size(labels), F.lit(0)) > 0
    counts = delivered.groupBy(F.coalesce(group.cast("string"), F.lit("unknown")).alias("key")).agg(
        F.count("*").alias("delivered"), F.count_if(labelled).alias("labelled"), *[F.count_if(has(x)).alias(x) for x in LABELS]
    )
    rate = lambda x: F.when(F.col("labelled") > 0, F.round(F.col(x) / F.col("labelled"), 4)).otherwise(0.0)
    return counts.select("*", F.round(F.col("labelled") / F.col("delivered"), 4).alias("coverage"), (F.col("labelled") < low_sample).alias("low_sample"), *[rate(x).alias(f"{x}_rate") for x in LABELS])
