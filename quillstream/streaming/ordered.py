"""Folds over a stream in event-time order: rows wait in state until the watermark has passed them.

One processor serves every fold of ``operators.scan`` and those below, so the stream gives what the batch gives
however its rows are shuffled, as long as none comes later than the lateness (Spark drops those). Keys are dealt to groups, whose state is
the folds' states and the rows that wait; timers fold what is due, and clear a state that nothing can meet any more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from quillstream.operators.events import LABELS
from quillstream.operators.scan import Alerts, LookBack

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000


#: Fixed value: groups of keys that share one state, so that a batch costs calls to the store by group and not by key.
GROUPS = 1024


class Ordered(StatefulProcessor):
    """Folds each key's rows in the order of (time, order values); emits the rows with what the fold tells.

    A group of keys is one key of the stream. Its rows wait as one blob a batch, and the folds' states of its keys are one more;
    it has one timer, for the first row that waits or else for the time when no state matters any more.
    """

    def __init__(self, fold, keys: Sequence[int], time: int, order: Sequence[int], used: Sequence[int], names: Sequence[str], keep: int | None):
        self.fold, self.keys, self.time, self.order, self.used, self.names, self.keep = fold, list(keys), time, list(order), list(used), list(names), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms bigint")
        self.states = handle.getValueState("states", "blob binary")
        self.waiting = handle.getListState("waiting", "blob binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r) for r in rows]
        self.waiting.appendValue((pickle.dumps(new),))
        self._wake(-(-min(r[self.time] for r in new) // 1000))
        return iter(())

    def _wake(self, ms: int) -> None:
        """One timer, at the earlier of its time and ``ms``."""
        if self.due.exists():
            before = self.due.get()[0]
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        due, later = {}, []
        for (blob,) in self.waiting.get():
            for r in pickle.loads(blob):
                if r[self.time] <= mark:
                    due.setdefault(tuple(r[k] for k in self.keys), []).append(r)
                else:
                    later.append(r)
        made, out = Row(*self.names), []
        for one, rows in due.items():
            rows.sort(key=lambda r: (r[self.time], *[r[k] for k in self.order]))
            state = states[one][1] if one in states else self.fold.start()
            for r in rows:
                state, told = self.fold.step(state, *[r[k] for k in self.used])
                out.append(made(*r, *told))
            states[one] = (rows[-1][self.time], state)
        if self.keep is not None:
            states = {one: s for one, s in states.items() if s[0] + self.keep >= mark}
        self.waiting.clear()
        if later:
            self.waiting.appendValue((pickle.dumps(later),))
            self._wake(-(-min(r[self.time] for r in later) // 1000))
        if not states:
            self.states.clear()
        else:
            self.states.update((pickle.dumps(states),))
            if self.keep is not None:
                self._wake(-(-(max(s[0] for s in states.values()) + self.keep) // 1000) + 1)
        return iter(out)

    def close(self) -> None:
        pass


def folded(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], used: Sequence[str], fold, made: dict[str, str], lateness: str, keep: int | None = None, groups: int = GROUPS) -> DataFrame:
    """A stream with the columns ``made``: ``fold.step(state, *used)`` over each key's rows by time and ``order``.

    ``keep`` is how long, in microseconds of event time, a state matters after its last row; without it for ever.
    A null time is left out, as no watermark passes it. ``groups`` is how many groups the keys are dealt to; it stays the same for a stream's life.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:  # state with timers needs this store
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = rows.where(F.col(at).isNotNull()).withWatermark(at, lateness).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    place = {c: k for k, c in enumerate(timed.columns)}
    schema = StructType([*timed.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in made.items())).fields])
    processor = Ordered(fold, [place[k] for k in keys], place["_t"], [place[c] for c in order], [place[c] for c in used], schema.names, keep)
    plain = StructType([StructField(f.name, f.dataType) for f in schema.fields])  # without the watermark's mark
    return timed.groupBy("_group").transformWithState(processor, plain, "append", "eventTime").drop("_t", "_group")


def look_back(events: DataFrame, keys: Sequence[str], at: str, event_id: str, minutes: int | Column, lateness: str = "1 hour", most_minutes: int | None = None) -> DataFrame:
    """(keys, event_id, at, duplicate) of a stream, as ``operators.events.look_back``; ``minutes`` may differ by row, up to ``most_minutes``."""
    span = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * MINUTE
    rows = events.select(*keys, event_id, at, span.alias("_span"))
    most = most_minutes if most_minutes is not None else minutes if isinstance(minutes, int) else None
    done = folded(rows, keys, at, [event_id], ["_t", "_span"], LookBack(), {"duplicate": "boolean", "_anchor": "bigint"}, lateness, None if most is None else most * MINUTE)
    return done.select(*keys, event_id, at, "duplicate")


def alerts(log: DataFrame, keys: Sequence[str], at: str, event_id: str, failed: Column, threshold: int = 3, cooldown_minutes: int = 60, lateness: str = "1 hour") -> DataFrame:
    """(keys, event_id, at, kind) of a stream, as ``operators.events.alerts``."""
    rows = log.select(*keys, event_id, at, failed.alias("_f"))
    done = folded(rows, keys, at, [event_id], ["_t", "_f"], Alerts(threshold, cooldown_minutes * MINUTE), {"kind": "string"}, lateness)
    return done.where("kind <> ''").select(*keys, event_id, at, "kind")


class Reserved:
    """State: the last reservation of a key, its event and whether it was sent. Rows are hits, or outcomes of earlier ones."""

    def start(self):
        return None

    def step(self, state, t, event, span, outcome, is_hit):
        if not is_hit:
            if state and state[1] == event and not state[2]:
                state = None if outcome == "failed" else (state[0], state[1], outcome == "sent")
            return state, (None, None)
        if state and t - state[0] <= span:
            return state, ("duplicate", state[1])
        return (t, event, False), ("reserved", event)


def reservations(rows: DataFrame, key: str, at: str, event_id: str, minutes: Column, outcome: str, lateness: str = "1 hour", most_minutes: int = 90 * 1440) -> DataFrame:
    """(key, event_id, at, status, first_event) of the hits of a stream: one delivery a key within its look-back, whatever the rule.

    A row with a null ``outcome`` is a hit; one with ``sent`` or ``failed`` tells what became of the hit of that event, and comes after it.
    A failed delivery frees the key, a sent one cannot be freed any more.
    """
    span = F.least(F.greatest(minutes.cast("long"), F.lit(1)), F.lit(most_minutes)) * MINUTE
    told = rows.select(key, F.col(event_id).cast("string").alias(event_id), at, F.coalesce(span, F.lit(MINUTE)).alias("_span"), outcome, F.col(outcome).isNull().alias("_hit"))
    done = folded(told, [key], at, ["_hit", event_id], ["_t", event_id, "_span", outcome, "_hit"], Reserved(), {"status": "string", "first_event": "string"}, lateness, most_minutes * MINUTE)
    return done.where("_hit").select(key, event_id, at, "status", "first_event")


class Clicks:
    """State: active labels, reason tags, event ids that were told and the time of the last click."""

    def start(self):
        return (), (), {}

    def step(self, state, event, label, reasons):
        active, tags, seen = state
        if event in seen:
            return state, (False, ",".join(active), ",".join(tags))
        asked = tuple(dict.fromkeys(x.strip() for x in reasons or () if x and x.strip()))
        if label == "invalid" and asked:
            now = {*active, label}
        else:
            now = {*active} ^ {label}
        active = tuple(x for x in LABELS if x in now)
        tags = (asked if label == "invalid" else tags) if "invalid" in now else ()
        seen[event] = True
        return (active, tags, seen), (True, ",".join(active), ",".join(tags))


def feedback(clicks: DataFrame, keys: Sequence[str], at: str, event_id: str, label: str, reasons: str, lateness: str = "1 hour") -> DataFrame:
    """(keys, event_id, at, counted, active_labels, reason_tags) of a stream, as ``operators.events.feedback_state`` after each click.

    A click toggles its label; ``invalid`` with reasons only sets it. Event ids stay in state, so a redelivered
    click counts once however late it comes again.
    """
    rows = clicks.select(*keys, event_id, at, label, reasons)
    made = {"counted": "boolean", "active_labels": "string", "reason_tags": "string"}
    return folded(rows, keys, at, [event_id], [event_id, label, reasons], Clicks(), made, lateness).drop(label, reasons)
