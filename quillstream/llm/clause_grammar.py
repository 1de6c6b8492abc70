"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read the clauses of a text, composed where they read the same way. The lexicon reads a word and writes one of
the symbols insult, threat, target, negation, report or other with a weight; it is a set of stems,
known ones and ones learnt from labelled texts by their log-odds. The negation and report transducers, composed, read those symbols left to right in a clause: a negated or
reported insult counts less. The target and threat transducers, composed, read it in both directions, and
the larger weight holds: an insult next to a target counts more, and a threat counts in full only with a
target in its clause, before it or after it. A clause that ends in a report (…, he said) is reported as well. A text's score is a logistic function of its clause scores.

The fit uses at most ``SAMPLE_ROWS`` labelled rows (see linear_text.labelled_sample); scoring reads
every whole text. The grammar that is sent to the tasks has at most ``STEMS`` learnt stems.

Defined results: a null or empty text has no clauses and gets the score of no match; rows without a
0/1 label are not learnt from; with no labelled rows only the known stems count; an empty table gives
an empty table; other columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.arrow_text import LOWER, flat, mix, slices, span_hashes, words

SAMPLE_ROWS = 12000
STEMS = 20000
#: Lengths in bytes of the word beginnings that the lexicon knows; 0 is the whole word.
LENGTHS = (4, 5, 6, 7, 8, 9, 10, 12, 0)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed words of each symbol.
KNOWN = {
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk imbecile abruti crétin débile ordure idiota estúpido imbécil basura trottel dummkopf abschaum",
    THREAT: "kill hurt destroy beat stab shoot burn tuer frapper détruire matar golpear destruir töten schlagen zerstören",
    TARGET: "you your yourself they them he she him her vous toi tu ils elle usted ustedes ellos ella du dich ihr euch sie",
    NEGATION: "not no never nor cannot ne pas jamais ni nunca jamás nicht kein keine nie",
    REPORT: "said says told wrote called quoted reported according claimed dit écrit selon dijo según escribió sagte schrieb laut",
}
WEIGHTS = {INSULT: 3.0, THREAT: 2.5, TARGET: 0.0, NEGATION: 0.0, REPORT: 0.0, OTHER: 0.0}


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over the symbols: ``step[state][symbol]`` is the next state, the symbol written and a factor."""

    step: tuple[tuple[tuple[int, int, float], ...], ...]

    def compose(self, after: "Transducer") -> "Transducer":
        """The transducer that does ``self`` and then ``after`` on what it wrote; only reachable pairs of states are made."""
        number, rows, queue = {(0, 0): 0}, [], [(0, 0)]
        for a, b in queue:
            row = []
            for symbol in range(6):
                a2, written, x = self.step[a][symbol]
                b2, out, y = after.step[b][written]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    queue.append((a2, b2))
                row.append((number[a2, b2], out, x * y))
            rows.append(tuple(row))
        return Transducer(tuple(rows))


def _loop(states: int, rule) -> Transducer:
    return Transducer(tuple(tuple(rule(state, symbol) for symbol in range(6)) for state in range(states)))


def negation_scope(reach: int = 3, factor: float = 0.25) -> Transducer:
    """An insult or threat up to ``reach`` words after a negation keeps a part of its weight."""
    return _loop(reach + 1, lambda s, x: (reach, x, 1.0) if x == NEGATION else (max(s - 1, 0), x, factor if s and x in (INSULT, THREAT) else 1.0))


def reported_speech(factor: float = 0.4) -> Transducer:
    """After a word of reporting, the rest of the clause is another's."""
    return _loop(2, lambda s, x: (1, x, 1.0) if x == REPORT else (s, x, factor if s and x in (INSULT, THREAT) else 1.0))


def aimed_insult(reach: int = 4, factor: float = 1.5) -> Transducer:
    """An insult up to ``reach`` words from a target, in the direction of reading, weighs more."""
    return _loop(reach + 1, lambda s, x: (reach, x, 1.0) if x == TARGET else (max(s - 1, 0), x, factor if s and x == INSULT else 1.0))


def threat_pattern() -> Transducer:
    """A threat counts in full once a target was read in the clause, else by a third."""
    return _loop(2, lambda s, x: (1, x, 1.0) if x == TARGET else (s, x, 1.0 if s or x != THREAT else 1 / 3))


def closing_report(factor: float = 0.4) -> Transducer:
    """Read right to left: a clause that ends in a target and a word of reporting, in either order (he said, said she), is another's."""
    begins = {(0, REPORT): 1, (0, TARGET): 2, (1, TARGET): 3, (2, REPORT): 3}
    return _loop(5, lambda s, x: (3, x, factor if x in (INSULT, THREAT) else 1.0) if s == 3 else (begins.get((s, x), 4), x, 1.0))


@dataclass(frozen=True)
class Grammar:
    """What is read left to right (``attitude``), in both directions (``aim``), and right to left (``closing``)."""

    attitude: Transducer
    aim: Transducer
    closing: Transducer

    def factors(self, clause: list[int]) -> list[float]:
        """The factor of each symbol of a clause."""

        def run(machine: Transducer, symbols: list[int]) -> list[float]:
            state, out = 0, []
            for symbol in symbols:
                state, _, factor = machine.step[state][symbol]
                out.append(factor)
            return out

        back, told = run(self.aim, clause[::-1])[::-1], run(self.closing, clause[::-1])[::-1]
        return [min(a, c) * max(x, y) for a, x, y, c in zip(run(self.attitude, clause), run(self.aim, clause), back, told, strict=True)]


def clause_grammar() -> Grammar:
    return Grammar(negation_scope().compose(reported_speech()), aimed_insult().compose(threat_pattern()), closing_report())


@dataclass
class Lexicon:
    """Stems by hash, each with a symbol and a weight; ``hashes`` is sorted."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def known() -> "Lexicon":
        found = {}
        for symbol, text in KNOWN.items():
            for word in text.split():
                raw = np.frombuffer(word.encode(), np.uint8)
                found[int(beginning_hashes(raw, np.array([0]), np.array([len(raw)]), 0)[0])] = (symbol, WEIGHTS[symbol])
        return Lexicon.of(found)

    @staticmethod
    def of(found: dict[int, tuple[int, float]]) -> "Lexicon":
        keys = sorted(found)
        return Lexicon(np.array(keys, np.uint64), np.array([found[k][0] for k in keys], np.int8), np.array([found[k][1] for k in keys]))

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word: the heaviest of its stems, a known whole word first."""
        symbols, weights = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        if not len(self.hashes):
            return symbols, weights
        for length in LENGTHS:
            fits = np.arange(len(starts)) if not length else np.flatnonzero(ends - starts >= length)
            h = beginning_hashes(data, starts[fits], ends[fits], length)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            fits, at = fits[hit], at[hit]
            better = (self.weights[at] > weights[fits]) | (self.symbols[at] > INSULT)
            symbols[fits[better]], weights[fits[better]] = self.symbols[at[better]], self.weights[at[better]]
        return symbols, weights


def beginning_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Hash of the first ``length`` bytes of each word, or of the whole word and its end (0)."""
    h = span_hashes(lower, starts, ends if not length else starts + length)
    return h if length else mix(h + np.uint64(1))


_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?;\n|")] = True


def read_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts, ends, text and clause number of each word; A-Z and the Latin-1 capitals are lowered."""
    data, off = flat(column)
    _, text, starts, ends = words(data, off)
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
    lower = LOWER[data]
    # UTF-8 of U+00C0 to U+00DE is C3 80 to C3 9E, and 97 there is the multiplication sign.
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    lower[capital] += 32
    return lower, starts, ends, text, stops[starts]


def contracted(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are the end of a contracted negation: t after an apostrophe (don't), n before one (n'est), or a word ending in ’t."""
    padded = np.concatenate([[0, 0, 0, 0], lower, [0]]).astype(np.uint8)  # lower[k] is padded[k + 4]
    one = ends - starts == 1
    cut = one & (lower[starts] == ord("t")) & (padded[starts + 3] == 39) | one & (lower[starts] == ord("n")) & (padded[ends + 4] == 39)
    curly = ends - starts > 4
    for k, byte in enumerate((0xE2, 0x80, 0x99, ord("t"))):
        curly &= padded[ends + k] == byte
    return cut | curly


#: Features of a text: total and greatest clause score, total less what its length would bring by chance, and log length.
N_FEATURES = 4


def text_features(column: pa.Array, lexicon: Lexicon, grammar: Grammar) -> np.ndarray:
    lower, starts, ends, text, clause = read_words(column)
    out = np.zeros((len(column), N_FEATURES))
    n_words = np.bincount(text, minlength=len(column)).astype(float)
    symbols, weights = lexicon.read(lower, starts, ends)
    symbols[contracted(lower, starts, ends)] = NEGATION
    place = np.stack([text, clause]) if len(text) else np.zeros((2, 0), np.int64)
    fresh = np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(0)]) if len(text) else np.zeros(0, bool)
    number = np.cumsum(fresh) - 1
    heavy = np.zeros(number[-1] + 1 if len(number) else 0, bool)
    heavy[number[(symbols == INSULT) | (symbols == THREAT)]] = True
    kept = np.flatnonzero(heavy[number]) if len(number) else np.zeros(0, np.int64)
    scores: dict[int, float] = {}
    cuts = np.flatnonzero(np.concatenate([[True], number[kept][1:] != number[kept][:-1], [True]])).tolist() if len(kept) else []
    read, weighed = symbols[kept].tolist(), weights[kept].tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        clause = read[i:j]
        scores[int(number[kept[i]])] = sum(w * f for x, w, f in zip(clause, weighed[i:j], grammar.factors(clause), strict=True) if x in (INSULT, THREAT))
    if scores:
        which = text[np.flatnonzero(fresh)[list(scores)]]
        values = np.array(list(scores.values()))
        out[:, 0] = np.bincount(which, values, len(column))
        np.maximum.at(out[:, 1], which, values)
    out[:, 2] = n_words / 1000
    out[:, 3] = np.log1p(n_words)
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(x[:, 0]), x[:, 1], x[:, 0], x[:, 0] / (1 + x[:, 2]), x[:, 2], x[:, 3], x[:, 0] > 0, np.ones(len(x))])


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    scale = np.maximum(np.abs(z).max(0), 1e-9)
    z, t = z / scale, np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * 1e-2 * np.eye(len(t)), z.T @ (p - y) + ridge * 1e-2 * t)
        t -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return t / scale


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Runs of rows of bounded size: their numbers, and the part of the column."""
    start = 0
    for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
        yield np.arange(start, start + part.num_rows), part.column(0)
        start += part.num_rows


def _distinct(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the first of equal pairs of hash and owner."""
    order = np.lexsort((h, owner))
    a, b = h[order], owner[order]
    return order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(h) else order


def _text_words(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, and starts, ends, text numbers and hashes of the words of each text, each word once a text."""
    lower, starts, ends, text, _ = read_words(part)
    h = beginning_hashes(lower, starts, ends, 0)
    new = _distinct(h, text)
    return lower, starts[new], ends[new], text[new], h[new]


def _beginnings(words_of: tuple, length: int) -> np.ndarray:
    """Hashes of word beginnings of one length, each once a text."""
    lower, starts, ends, text, whole = words_of
    fits = np.flatnonzero(ends - starts >= max(length, 3))
    if not length:
        return whole[fits]
    h = beginning_hashes(lower, starts[fits], ends[fits], length)
    return h[_distinct(h, text[fits])]


def learn_lexicon(column: pa.Array, labels: np.ndarray, least: int = 4, odds: float = 2.0) -> Lexicon:
    """The known stems, and beginnings of words that toxic texts have far more often than others.

    Of texts with one label and one set of words one is counted.
    """
    sets = np.zeros(len(column), np.uint64)
    for at, part in _pieces(column):
        *_, text, h = _text_words(part)
        with np.errstate(over="ignore"):
            np.add.at(sets, at[text], mix(h + np.uint64(7)))
    _, first = np.unique(np.stack([sets, labels.astype(np.uint64)]), axis=1, return_index=True)
    toxic, clean = (np.sort(first[labels[first] == x]) for x in (1, 0))
    lists: dict[int, list[np.ndarray]] = {length: [] for length in LENGTHS}
    for _, part in _pieces(column.take(pa.array(toxic))):
        words_of = _text_words(part)
        for length in LENGTHS:
            lists[length].append(_beginnings(words_of, length))
    counts = {}
    for length, hashes in lists.items():
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)
        counts[length] = keys[n >= least], n[n >= least], np.zeros(int((n >= least).sum()))
    for _, part in _pieces(column.take(pa.array(clean))):
        words_of = _text_words(part)
        for length, (keys, _, in_clean) in counts.items():
            if len(keys):
                h = _beginnings(words_of, length)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                in_clean += np.bincount(at[keys[at] == h], minlength=len(keys))
    found: dict[int, tuple[int, float]] = {}
    for keys, in_toxic, in_clean in counts.values():
        weight = np.log((in_toxic + 0.5) / (len(toxic) + 2)) - np.log((in_clean + 0.5) / (len(clean) + 2)) - np.sqrt(1 / (in_toxic + 0.5))
        for k in np.flatnonzero(weight >= odds):
            found[int(keys[k])] = (INSULT, float(weight[k]))
    best = sorted(found, key=lambda k: (-found[k][1], k))[:STEMS]
    known = Lexicon.known()
    found = {k: found[k] for k in best}
    for k, symbol, weight in zip(known.hashes.tolist(), known.symbols.tolist(), known.weights.tolist(), strict=True):
        if symbol != INSULT or found.get(k, (0, 0.0))[1] < weight:
            found[k] = (symbol, weight)
    return Lexicon.of(found)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ self.weights, -500, 500)))


#: Without labelled rows: the score rises with the greatest clause score alone.
_UNFITTED = np.array([0, 1.0, 0, 0, 0, 0, 0, -2.5])


def fit(column: pa.Array, labels: np.ndarray) -> ToxicityModel:
    """Lexicon from two thirds of the rows, weights from the rest, then the lexicon again from all."""
    if len({*labels.tolist()}) < 2 or len(labels) < 30:
        return ToxicityModel(Lexicon.known(), _UNFITTED)
    grammar, part = clause_grammar(), np.arange(len(labels)) % 3
    design = np.zeros((len(labels), _design(np.zeros((1, N_FEATURES))).shape[1]))
    for held in range(3):
        lexicon = learn_lexicon(column.filter(pa.array(part != held)), labels[part != held])
        rows = np.flatnonzero(part == held)
        for at, texts in _pieces(column.take(pa.array(rows))):
            design[rows[at]] = _design(text_features(texts, lexicon, grammar))
    return ToxicityModel(learn_lexicon(column, labels), _logistic(design, labels.astype(float)))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> ToxicityModel:
    """Fit in one task on a bounded sample of (id, text, 0/1 label); the driver gets one row."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches])
        if rows.num_rows:
            rows = rows.sort_by([("id", "ascending"), ("label", "ascending"), ("text", "ascending")])
        column = rows.column("text").cast(pa.large_string()).combine_chunks() if rows.num_rows else pa.array([], pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        model = fit(column, rows.column("label").to_numpy().astype(np.int64))
        lexicon = model.lexicon
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (lexicon.hashes, lexicon.symbols, lexicon.weights, model.weights)], names=["h", "s", "w", "t"])

    made = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = made.repartition(1).mapInArrow(learn, "h binary, s binary, w binary, t binary").collect()
    if not rows:
        return ToxicityModel(Lexicon.known(), _UNFITTED)
    h, s, w, t = (np.frombuffer(x, kind) for x, kind in zip(rows[0], (np.uint64, np.int8, np.float64, np.float64), strict=True))
    return ToxicityModel(Lexicon(h, s, w), t)


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``df`` as (id, score)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, grammar = sent.value, clause_grammar()
        for batch in batches:
            for part in slices(batch, text_col):
                scores = fitted.probabilities(text_features(part.column(1), fitted.lexicon, grammar))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
