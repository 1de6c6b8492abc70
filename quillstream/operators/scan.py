"""Folds over each key's events in order that split a key of any length over many tasks.

Rows are dealt by ranges of (key, order), so a key with very many events covers several partitions, and are
written to the checkpoint folder, so that all passes see the same partitions. The first pass tells how
each partition changes the state of the key that it begins with, as a function of the state before it,
and the state that its last key ends with. The second follows these few rows key by key and gives every
partition the state that it begins with. The third marks the rows. No pass holds the events of a key.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstream.session import checkpointed

_KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
NEVER = float("-inf")


class Steps:
    """A step function of a time a, folded from events: an event at t sets a to t where a < cut, and leaves it elsewhere."""

    def __init__(self) -> None:
        self.bound = NEVER  # from here on a is still as it came
        self.cuts: list[float] = []
        self.group: list[int] = []  # of each piece below a cut
        self.above: list[int] = []  # of each group the group that it was merged into
        self.value: list[float] = []
        self.open: deque[int] = deque()  # groups that are not merged, by value

    def add(self, t: float, cut: float) -> None:
        new = len(self.above)
        merged = False
        while self.open and self.value[self.open[0]] < cut:
            self.above[self.open.popleft()] = new
            merged = True
        if cut > self.bound:
            self.cuts.append(cut)
            self.group.append(new)
            self.bound, merged = cut, True
        if merged:
            self.above.append(new)
            self.value.append(t)
            self.open.append(new)

    def _root(self, g: int) -> int:
        while self.above[g] != g:
            self.above[g] = self.above[self.above[g]]
            g = self.above[g]
        return g

    def packed(self) -> tuple[list[float], list[float]]:
        """The cuts and the values below them, neighbours of one value together."""
        cuts, values = [], []
        for cut, g in zip(self.cuts, self.group, strict=True):
            value = self.value[self._root(g)]
            if values and values[-1] == value:
                cuts[-1] = cut
            else:
                cuts.append(cut)
                values.append(value)
        return cuts, values


def after(steps: tuple[list[float], list[float]], a: float) -> float:
    cuts, values = steps
    k = bisect_right(cuts, a)
    return values[k] if k < len(cuts) else a


class LookBack:
    """State: the time of the last kept event. Told: whether an event lies within its span of it, and that time."""

    def start(self):
        return None

    def step(self, anchor, t, span):
        covered = anchor is not None and span is not None and t - anchor <= span
        anchor = anchor if covered else t
        return anchor, (covered, anchor)

    def begin(self):
        return Steps()

    def add(self, s: Steps, t, span) -> Steps:
        s.add(t, float("inf") if span is None else t - span)
        return s

    def end(self, s: Steps):
        return s.packed()

    def after(self, done, anchor):
        found = after(done, NEVER if anchor is None else anchor)
        return None if found == NEVER else found


class Alerts:
    """State: failures in a row, and the time of the last alert. Told: ``failure``, ``recovery`` or nothing."""

    def __init__(self, threshold: int, wait: int):
        self.threshold, self.wait = threshold, wait

    def start(self):
        return 0, None

    def step(self, state, t, bad):
        n, last = state
        cool = last is None or t is None or t - last >= self.wait
        alert = bool(bad) and n + 1 >= self.threshold and cool
        recovery = bad is False and n >= self.threshold and last is not None and cool
        return (n + 1 if bad else 0, t if alert else last), ("failure" if alert else "recovery" if recovery else "",)

    # For every number of failures before, up to the threshold, what becomes of the last alert.
    def begin(self):
        return [Steps() for _ in range(self.threshold + 1)], list(range(self.threshold + 1)), [0, False]

    def add(self, s, t, bad):
        steps, counts, tail = s
        for m, one in enumerate(steps):
            if bad and counts[m] + 1 >= self.threshold:
                one.add(*((NEVER, float("inf")) if t is None else (t, t - self.wait + 1)))
            counts[m] = counts[m] + 1 if bad else 0
        tail[:] = [tail[0] + 1, tail[1]] if bad else [0, True]
        return s

    def end(self, s):
        steps, _, tail = s
        return [one.packed() for one in steps], tuple(tail)

    def after(self, done, state):
        steps, (tail, broken) = done
        n, last = state
        found = after(steps[min(n, self.threshold)], NEVER if last is None else last)
        return tail if broken else n + tail, None if found == NEVER else found


def _segments(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, row after the last) of the runs of one key."""
    named = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    start = 0
    for i in range(1, len(named) + 1):
        if i == len(named) or named[i] != named[start]:
            yield named[start], start, i
            start = i


def scanned(rows: DataFrame, keys: Sequence[str], order: Sequence[str], used: Sequence[str], fold, made: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``made``: ``fold.step(state, *used) -> (state, values)`` over each key's rows in order.

    ``fold`` also has ``begin``, ``add``, ``end`` and ``after``, which make a function of the state from a run of rows
    and apply it; the result is the same as of steps one by one.
    """
    place, own = [*keys, *order], rows.columns
    dealt = checkpointed(rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_part", F.spark_partition_id()))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, first, state = None, None, True, None
        names, out = [*keys, "_part", "_last", "_blob"], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in used]
            for name, a, b in _segments(batch, keys):
                row = [batch.column(c).slice(a, 1) for c in (*keys, "_part")]
                if held is None:
                    held, key, state = row, name, fold.begin()
                elif name != key:
                    if first:
                        out.append((held, False, pickle.dumps(fold.end(state))))
                    held, key, state, first = row, name, fold.start(), False
                for i in range(a, b):
                    values = [c[i] for c in columns]
                    state = fold.add(state, *values) if first else fold.step(state, *values)[0]
        if held is not None:
            out.append((held, False, pickle.dumps(fold.end(state))) if first else (held, True, pickle.dumps(state)))
        for row, last, blob in out:
            yield pa.RecordBatch.from_arrays([*row, pa.array([last]), pa.array([blob], pa.binary())], names=names)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            parts, entries = [], []
            names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for name, part, last, blob in zip(names, *(batch.column(c).to_pylist() for c in ("_part", "_last", "_blob")), strict=True):
                if name != key:
                    key, state = name, fold.start()
                if last:
                    state = pickle.loads(blob)
                else:
                    parts.append(part)
                    entries.append(pickle.dumps(state))
                    state = fold.after(pickle.loads(blob), state)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(entries, pa.binary())], names=["_part", "_entry"])

    read = [*keys, "_part", *[c for c in used if c not in keys]]
    summaries = dealt.select(*dict.fromkeys(read)).mapInArrow(told, f"{key_ddl}, _part int, _last boolean, _blob binary")
    entries = summaries.repartition(*keys).sortWithinPartitions(*keys, "_part", "_last").mapInArrow(chained, "_part int, _entry binary")
    # One row for each partition at most, and a state is a few numbers.
    entered = dealt.join(F.broadcast(entries), "_part", "left")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, state = None, False, None
        for batch in batches:
            columns, out = [batch.column(c).to_pylist() for c in used], []
            for name, a, b in _segments(batch, keys):
                if not begun:
                    entry = batch.column("_entry")[a].as_py()
                    key, begun, state = name, True, fold.start() if entry is None else pickle.loads(entry)
                elif name != key:
                    key, state = name, fold.start()
                for i in range(a, b):
                    state, values = fold.step(state, *[c[i] for c in columns])
                    out.append(values)
            columns = zip(*out, strict=True) if out else [()] * len(made)
            arrays = [pa.array(c, _KINDS[k]) for c, k in zip(columns, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *arrays], names=[*own, *made])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in made.items())).fields])
    return entered.mapInArrow(marked, schema)
