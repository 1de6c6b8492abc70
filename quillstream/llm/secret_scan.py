"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Two Markov models over characters, of second order with first and zeroth order mixed in, are trained from
labelled samples, one of random strings (keys and tokens) and one of ordinary identifiers. A maximal run of key
characters is a secret if its log-likelihood ratio for each character is above the threshold that held-back
ordinary samples set; runs that touch a span of the fixed patterns are left to those.

Samples come from the corpus and from a rule. Of at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS``
characters, those with the smallest hashed ids, the values that the fixed patterns find are labelled random, and the
distinct words of letters ordinary: identifiers are made of them in six styles. The rule adds strings drawn from the
alphabets of keys, and ordinary ones that are no words: dates, numbers, repeated characters and alphabets in order.

Defined results: a null or empty text has no spans; equal rows give equal results; an empty table
gives an empty table; other columns are ignored; long texts are scanned whole, as bytes, and spans
count code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.arrow_text import LOWER, flat, runs, slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(rb"[0-9a-f]{32,}")
#: Shortest value of an assignment, access key, hexadecimal run, and run scored by the models.
LEAST = {"assign": 8, "access": 16, "hex": 32, "markov": 20}

#: Documents, and characters of one, that samples are taken from at most; words and secrets that are kept of them.
SAMPLE_DOCS, SAMPLE_CHARS, WORD_LIMIT = 2000, 100_000, 4000

_KEY_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_KEY = np.zeros(256, np.uint8)
_KEY[list(_KEY_CHARS)] = 1
_HEX = np.zeros(256, np.uint8)
_HEX[list(b"0123456789abcdef")] = 1


WORDS = (
    "account address array author batch body buffer build cache call channel class client code column config content count create data date default delete document "
    "error event field file filter format function group handler header image index input item job key label level library line link list map message method model "
    "module name node number object offset option order output page parameter path pattern point process query queue range record region report request response "
    "result return role root row rule schema scope search select server service session set size source stage state status step store stream string style table "
    "task test text time title total tree type update user value version view width window word worker international understanding responsibility"
).split()


def _ordinary(rng: random.Random, words: list[str], style: int) -> str:
    """An identifier of words, or a string that is plainly no secret."""
    parts = [rng.choice(words) for _ in range(rng.randint(2, 6))]
    if style == 0:
        return "_".join(parts)
    if style == 1:
        return parts[0] + "".join(p.title() for p in parts[1:])
    if style == 2:
        return "-".join(parts)
    if style == 3:
        return "_".join(parts).upper()
    if style == 4:
        return "/".join(parts) + str(rng.randint(0, 99)) * (rng.random() < 0.3)
    if style == 5:
        return "".join(parts) + rng.choice(["", "", "_1", "=" * rng.randint(1, 30), "-" * rng.randint(1, 30)])
    day = f"{rng.randint(1990, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    letters = "abcdefghijklmnopqrstuvwxyz" if rng.random() < 0.5 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turned = letters[rng.randrange(26) :] + letters
    plain = (f"{day}/{day}", f"{day}_{rng.choice(words)}_{rng.randint(1, 99)}", rng.choice("abcxyzABC0159=-_") * rng.randint(20, 60), turned, turned[::-1], "0123456789" * rng.randint(2, 5), f"{rng.randint(0, 9)}" * 9 + "0" * rng.randint(11, 20), "-".join(str(rng.randint(1, 2030)) for _ in range(7)))
    return plain[rng.randrange(len(plain))]


def labelled_samples(n: int = 4000, seed: int = 7, words: list[str] | None = None, secrets: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Labelled strings: (random ones, ordinary ones). ``words`` and ``secrets`` are those of a corpus; a few fixed words serve without them."""
    rng = random.Random(seed)
    known = WORDS + sorted(words or ())
    alphabets = [b"0123456789abcdef", _KEY_CHARS[:62], _KEY_CHARS[:64], b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"abcdefghijklmnopqrstuvwxyz0123456789", _KEY_CHARS]
    drawn = lambda alphabet: "".join(rng.choice(alphabet.decode()) for _ in range(rng.randint(20, 64)))
    strange = [drawn(alphabets[i % len(alphabets)]) for i in range(n)]
    plain = [_ordinary(rng, known, i % 8) for i in range(n)]
    found = sorted(x for x in secrets or () if len(x) >= LEAST["markov"])
    return strange + found[:n], plain


class MarkovRatio:
    """Log-likelihood ratio of two character models of second order, and its threshold."""

    #: Weights of the second, first and zeroth order.
    MIX = (0.6, 0.3, 0.1)

    def __init__(self, strange: list[str], plain: list[str], alpha: float = 0.5) -> None:
        place = np.full(256, len(_KEY_CHARS) + 1, np.int64)
        place[list(_KEY_CHARS)] = np.arange(1, len(_KEY_CHARS) + 1)
        self.place, self.size = place, len(_KEY_CHARS) + 2
        long = LEAST["markov"]
        part = lambda xs, held: [x for i, x in enumerate(xs) if (i % 5 == 4) == held]
        self.table = (self._fit(part(strange, False), alpha) - self._fit(part(plain, False), alpha)).astype(np.float32)
        ordinary, random_ = ([self.score(x) for x in part(xs, True) if len(x) >= long] for xs in (plain, strange))
        #: Above nearly all ordinary samples that were not learnt from, and where there is room, half-way to the random ones.
        top = float(np.quantile(ordinary, 0.998)) if ordinary else 0.0
        self.threshold = max(top, (top + float(np.quantile(random_, 0.02))) / 2) if random_ else top

    def _fit(self, strings: list[str], alpha: float) -> np.ndarray:
        n = self.size
        counts = np.zeros((n, n, n))
        for s in strings:
            at = np.concatenate([[0, 0], self.place[np.frombuffer(s.encode(), np.uint8)]])
            np.add.at(counts, (at[:-2], at[1:-1], at[2:]), 1)
        zeroth = counts.sum((0, 1)) + alpha
        first = counts.sum(0) + alpha
        second = counts + alpha / n
        share = lambda c: c / c.sum(-1, keepdims=True)
        return np.log(self.MIX[0] * share(second) + self.MIX[1] * share(first)[None] + self.MIX[2] * share(zeroth)[None, None])

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log-likelihood ratio of each ``data[start:end]``."""
        if not len(starts):
            return np.zeros(0)
        lengths = ends - starts
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], lengths)
        now = self.place[data[at]]
        within = np.arange(cuts[-1]) - np.repeat(cuts[:-1], lengths)
        before = np.where(within > 0, np.concatenate([[0], now[:-1]]), 0)
        earlier = np.where(within > 1, np.concatenate([[0, 0], now[:-2]])[: len(now)], 0)
        return np.add.reduceat(self.table[earlier, before, now].astype(np.float64), cuts[:-1]) / lengths

    def score(self, s: str) -> float:
        raw = np.frombuffer(s.encode(), np.uint8)
        return float(self.scores(raw, np.array([0]), np.array([len(raw)]))[0])


#: A word of letters of one case or with a capital first, by itself: parts of longer runs may be parts of keys.
_LABELLED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[a-z]{3,20}|[A-Z][a-z]{2,19}|[A-Z]{3,20})(?![A-Za-z0-9+/_=-])")


def corpus_samples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = SAMPLE_DOCS, longest: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """(words, secrets) of a bounded sample of a corpus: at most ``WORD_LIMIT`` of each, by hash."""
    rows = df.select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), text_col).where(F.length(F.coalesce(text_col, F.lit(""))).between(1, longest))
    chosen = rows.select("h").distinct().orderBy("h").limit(docs)
    sample = rows.join(F.broadcast(chosen), "h").select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = text.encode()
                told = [(0, m.group(2)) for m in ASSIGN.finditer(raw) if len(m.group(2)) >= LEAST["assign"]] + [(0, m.group()) for m in ACCESS.finditer(raw) if len(m.group()) >= LEAST["access"]]
                told += [(0, m.group()) for m in _LONG_HEX.finditer(raw)]
                out = {(kind, value.decode()) for kind, value in told} | {(1, w) for w in _LABELLED.findall(text)}
                if out:
                    kinds, values = zip(*sorted(out), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], names=["kind", "value"])

    found = sample.mapInArrow(run, "kind int, value string").distinct()
    pick = lambda kind: [r.value for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(WORD_LIMIT).collect()]
    return pick(1), pick(0)


def _finds(raw: bytes, word: bytes) -> list[int]:
    found, at = [], raw.find(word)
    while at >= 0:
        found.append(at)
        at = raw.find(word, at + 1)
    return found


def _doc_spans(raw: bytes, keys: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans (start, kind, end) of one text; ``keys`` are runs that the models call random."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    base += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(raw)]
    spans, at, last = sorted(base), 0, []
    ends = sorted((s, e) for s, _, e in base)
    for s, e in sorted(keys):
        while at < len(ends) and ends[at][1] <= s:
            at += 1
        k, free = at, True
        while free and k < len(ends) and ends[k][0] < e:
            free, k = ends[k][1] <= s, k + 1
        if free:
            last.append((s, 3, e))
    return sorted(spans + last)




def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end) in code points, by start, then kind. Without ``samples`` the corpus gives them."""
    strange, plain = samples or labelled_samples(4000, 7, *corpus_samples(df, id_col, text_col))
    model = MarkovRatio(strange, plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_batch_spans(part.column(1), model), _SPANS)], names=[id_col, "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _batch_spans(column: pa.Array, model: MarkovRatio) -> list[list[dict]]:
    data, off = flat(column)
    lower = LOWER[data].tobytes()
    wanted = {*np.searchsorted(off, [at for word in ASSIGN_WORDS for at in _finds(lower, word)], "right") - 1}
    wanted |= {*np.searchsorted(off, _finds(data.tobytes(), b"AKIA"), "right") - 1}
    starts, ends, text = runs(_HEX[data], off)
    wanted |= {*text[ends - starts >= LEAST["hex"]]}
    starts, ends, text = runs(_KEY[data], off)
    long = ends - starts >= LEAST["markov"]
    starts, ends, text = starts[long], ends[long], text[long]
    random_like = model.scores(data, starts, ends) > model.threshold
    keys: dict[int, list[tuple[int, int]]] = {}
    for s, e, t in zip(starts[random_like].tolist(), ends[random_like].tolist(), text[random_like].tolist(), strict=True):
        keys.setdefault(t, []).append((s - int(off[t]), e - int(off[t])))
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    for t in sorted({int(x) for x in wanted} | keys.keys()):
        raw = data[off[t] : off[t + 1]]
        found = _doc_spans(raw.tobytes(), keys.get(t, []))
        if found:
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            out[t] = [{"kind": KINDS[k], "start": int(points[s]), "end": int(points[e])} for s, k, e in found]
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of each base kind, a digest of the base spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1).to_pylist()
            joined = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row) for row in spans]
            base = [[s for s in row if s["kind"] != "markov"] for row in spans]
            digests = [hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row).encode()).hexdigest() for row in base]
            counts = [pa.array([sum(s["kind"] == k for s in row) for row in base], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(joined, pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return find_spans(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
