"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Each text becomes a set of hashed indicators: word 1- and 2-grams, and 1- to 4-grams of token
shapes (case, repeated word, punctuation). Indicators are scaled by the log-count ratio of the two
classes and by the text's own norm, and a linear hinge-loss model is fitted by dual coordinate
descent. A margin becomes a probability by a logistic fit on held-back rows of the same sample.

The fit uses at most ``SAMPLE_ROWS`` labelled ids, those with the smallest hash, one text each, and no
text of more than ``SAMPLE_CHARS`` characters; scoring reads every whole text. The model that is sent to the tasks has ``SIZE`` floats, whatever the input.

Defined results: a null or empty text has no indicators and gets the score of the bare intercept;
rows without a label, or with one other than 0 and 1, are not learnt from; with no labelled rows or
one class the score is that class's share (0.5 without rows); an empty table gives an empty table;
other columns are ignored; repeated ids are each scored, and learnt from once, by one of their
texts; an id with both labels counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.arrow_text import CLASSES, LOWER, flat, mix, runs, slices, span_hashes

#: Labelled rows that a fit reads at most.
SAMPLE_ROWS = 6000
#: Characters of a text that is learnt from, at most; every text is scored.
SAMPLE_CHARS = 200_000
WORD_BITS, SHAPE_BITS = 18, 12
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS)

_TOKEN_CLASSES = np.where(CLASSES == 2, np.arange(256), CLASSES).astype(np.uint8)
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def indicators(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, indicator) pairs of a run of texts, ordered by text."""
    n = len(off) - 1
    starts, ends, text = runs(_TOKEN_CLASSES[data], off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _TOKEN_CLASSES[data[starts]] == 1
    h = span_hashes(LOWER[data], starts, ends)
    follows = np.concatenate([[False], text[1:] == text[:-1]])
    up = np.concatenate([[0], np.cumsum(_UPPER[data])])
    dig = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    upper, digit, length = up[ends] - up[starts], dig[ends] - dig[starts], ends - starts
    with np.errstate(over="ignore"):
        pairs = mix(h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])[follows[1:]]
        f = np.concatenate([h, pairs]) >> np.uint64(64 - WORD_BITS)
        doc = np.concatenate([text, text[1:][follows[1:]]])
        key = np.unique(doc * np.int64(1 << WORD_BITS) + f.astype(np.int64))
        # shapes: a punctuation mark is its own shape, a word is told by case, digits and repetition
        at = np.flatnonzero(word)
        same = np.zeros(len(starts), bool)
        same[at[1:]] = (h[at[1:]] == h[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
        case = np.where(digit > 0, 3, np.where((upper > 1) & (upper * 2 >= length), 2, np.where(upper > 0, 1, 0)))
        shape = np.where(word, 300 + case * 2 + same, data[starts].astype(np.int64) + 256 * (length > 1)).astype(np.uint64)
        flags = np.zeros(n << SHAPE_BITS, bool)
        gram, ok = np.zeros(len(shape), np.uint64), np.ones(len(shape), bool)
        for size in range(4):
            if size:
                ok = np.concatenate([[False] * size, (text[size:] == text[:-size])]) if size < len(text) else np.zeros(len(text), bool)
            earlier = np.concatenate([np.zeros(size, np.uint64), shape[: len(shape) - size]])[: len(shape)]
            gram = gram * np.uint64(0x100000001B3) + earlier + np.uint64(1)
            flags[(text[ok] << SHAPE_BITS) + (mix(gram[ok] + np.uint64(size << 40)) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)] = True
    set_at = np.flatnonzero(flags)
    doc = np.concatenate([key >> WORD_BITS, set_at >> SHAPE_BITS])
    f = np.concatenate([key & ((1 << WORD_BITS) - 1), (set_at & ((1 << SHAPE_BITS) - 1)) + (1 << WORD_BITS)])
    order = np.argsort(doc, kind="stable")
    return doc[order], f[order]


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float, rounds: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularised hinge-loss model, one dual variable at a time."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            slope = y[i] * (w[f] @ v + b) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * c:
            break
    return w, b


def logistic_line(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of 0/1 labels on one variable, slightly regularised."""
    scale = float(np.std(x)) or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    t = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        gradient = z.T @ (p - y) + 0.05 * t * [1, 0]
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2) + np.diag([0.05, 0])
        step = np.linalg.solve(hessian, gradient)
        t -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(t[0] / scale), float(t[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, c: float = 4.0, rounds: int = 25) -> np.ndarray:
    """Model of SIZE weights, then intercept, slope and intercept of the probability."""
    model = np.zeros(SIZE + 3, np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1 or len(labels) < 10:
        model[-1] = np.log((share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5)) if len(labels) else 0
        return model
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for f, label in zip(rows, labels, strict=True):
        (p if label else q)[f] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[f] / np.sqrt(max(len(f), 1)) for f in rows]
    y = np.where(labels > 0, 1.0, -1.0)
    back = np.arange(len(y)) % 5 == 4
    fitted, held = np.flatnonzero(~back), np.flatnonzero(back)
    w, b = dual_descent([rows[i] for i in fitted], [values[i] for i in fitted], y[fitted], SIZE, c, rounds)
    margins = np.array([w[rows[i]] @ values[i] + b for i in held])
    slope, intercept = logistic_line(margins, labels[held].astype(float)) if len({*labels[held].tolist()}) == 2 else (1.0, 0.0)
    model[:SIZE] = w * ratio
    model[SIZE:] = b, slope, intercept
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> np.ndarray:
    """Fit on rows of (id, text, 0/1 label); the caller bounds them. One task fits, the driver gets one row."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                doc, f = indicators(*flat(part.column(1)))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(f, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], names=["id", "f", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, ids = [], [], []
        for batch in batches:
            flat_f, cuts = batch.column(1).flatten().to_numpy(), np.cumsum([0, *batch.column(1).value_lengths().to_pylist()])
            rows += [flat_f[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            labels += batch.column(2).to_pylist()
            ids += batch.column(0).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], len(rows[i])))  # the same model whatever order rows come in
        model = fit([rows[i] for i in order], np.array([labels[i] for i in order], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    made = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias(text_col), F.col(label_col).cast("int").alias("label"))
    rows = made.mapInArrow(features, "id string, f array<int>, label int").repartition(1).mapInArrow(learn, "model binary").collect()
    return np.frombuffer(rows[0]["model"], np.float32) if rows else fit([], np.zeros(0))


def _probabilities(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    b, slope, intercept = (float(x) for x in weights[SIZE:])
    doc, f = indicators(*flat(column))
    total = np.bincount(doc, weights[f], len(column))
    number = np.maximum(np.bincount(doc, minlength=len(column)), 1)
    return 1 / (1 + np.exp(-np.clip(slope * (total / np.sqrt(number) + b) + intercept, -500, 500)))


def score(df: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``df`` as (id, score)."""
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(model, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_probabilities(part.column(1), sent.value))], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def accepted(df: DataFrame, model: np.ndarray, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose score is ``least`` or more."""
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(model, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(_probabilities(part.column(part.schema.get_field_index(text_col)), sent.value) >= least))

    return df.mapInArrow(run, df.schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, label_col: str, learn_if: Column, limit: int = SAMPLE_ROWS, longest: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``limit`` labelled documents of at most ``longest`` characters, those with the smallest hashed ids: (doc_id, text, label).

    An id gives one text, that of the smallest hash, and a label, 1 where it has both; texts that are too long are
    left out before the limit counts. So neither rows nor bytes of the sample can outgrow the bounds.
    """
    told = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & learn_if).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    short = documents.where(F.length(F.coalesce("text", F.lit(""))) <= longest).select("doc_id", F.xxhash64("text").alias("copy"))
    ids = (
        short.join(told, "doc_id").groupBy("doc_id").agg(F.min("copy").alias("copy"), F.first("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("copy")).join(F.broadcast(ids), ["doc_id", "copy"])
    return rows.select("doc_id", "text", "label").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
