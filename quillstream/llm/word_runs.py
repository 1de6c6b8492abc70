"""Runs of repeated words by Lyndon arrays over an ordered alphabet, in linear time.

The alphabet is the words of a text, ordered as bytes. A run of period q that ends before a smaller word
than the one q places earlier has, for some position i of its first period, the word list [i, i+q) as the
longest Lyndon word that starts at i; a run that ends before a larger one has it in the reverse order. So
both orders' Lyndon arrays tell every run, without suffix arrays, trees or hashes.

``lyndon`` goes over the words once, from left to right. The chain of previous smaller suffixes gives the
pairs to compare, and every pair that is compared is an edge of the Lyndon array, whose common extension
is kept. The last extension that was matched word by word, two equal stretches, is reused: a pair inside the
right stretch has its copy in the left one, so its extension is known or reaches the stretch's end, where
matching goes on. Along a chain the extensions already known decide all but the equal ones. So no word is
matched twice on the right side of a pair, and the whole is linear.

Which words can lie in a run at all is narrowed before: in a run of three periods or more every word
occurs three times and every pair of neighbours twice. Words and pairs that do not cut the text, again
and again, into stretches; stretches shorter than the shortest run go. This drops nothing that a run holds.

Defined results: words are what spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns
part. A null, empty or blank text has no words, no runs and the empty text as what is left. Rows are judged
each by itself, so repeated rows, ties, null ids and extra columns change nothing; an empty table gives an
empty table. Very long texts take time in proportion to their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.arrow_text import flat, slices, space_words

#: A run has at least so many words and so many periods.
LEAST, PERIODS = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """For each i the next j whose suffix is smaller (the end of the longest Lyndon word at i) and the common extension of i and j.

    A suffix that is a prefix of another is the smaller one; where no suffix is smaller, j is the length.
    """
    n = len(t)
    nss, ext = [n] * n, [0] * n  # edges to the next smaller suffix
    pss, back = [-1] * n, [0] * n  # edges from the previous smaller suffix
    at, shift, reach = 0, 0, 0  # t[at:reach] equals the words ``shift`` places earlier
    for x in range(1, n):
        y, known, equal = x - 1, 0, True
        while y >= 0:
            m = known
            if equal:
                if y >= at and x < reach:  # the pair's copy, as far as the stretch goes
                    if nss[y - shift] == x - shift:
                        m = max(m, min(ext[y - shift], reach - x))
                    elif pss[x - shift] == y - shift:
                        m = max(m, min(back[x - shift], reach - x))
                while x + m < n and t[y + m] == t[x + m]:
                    m += 1
                if x + m > reach:
                    at, shift, reach = x, x - y, x + m
            if x + m < n and t[y + m] < t[x + m]:
                pss[x], back[x] = y, m
                break
            nss[y], ext[y] = x, m
            # The next of the chain shares back[y] words with y, and y shares m with x.
            below = back[y]
            known, equal = (m, False) if m < below else (below, below == m)
            y = pss[y]
    return nss, ext


def runs_of(t: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``periods`` periods, two or more, by start and period."""
    n, found = len(t), set()
    index = np.arange(n)
    for order in (t, -t):
        nss, ext = (np.array(x, np.int64) for x in lyndon(order.tolist()))
        period = nss - index
        # The first full Lyndon root of a run has all but its last period and what is before it to the right.
        able = np.flatnonzero((nss < n) & (ext + 2 * period - 1 >= np.maximum(least, periods * period)))
        if not len(able):
            continue
        q, end = period[able], nss[able] + ext[able]
        first = np.lexsort((able, q, end))
        q, end, able = q[first], end[first], able[first]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (end[1:] != end[:-1])])
        for i, p, e in zip(able[new].tolist(), q[new].tolist(), end[new].tolist(), strict=True):
            reach = min(i, p - 1)  # a run starts less than a period before its first root
            unlike = np.flatnonzero(t[i - reach : i] != t[i - reach + p : i + p])
            start = i - reach + (int(unlike[-1]) + 1 if len(unlike) else 0)
            if e - start >= max(least, periods * p):
                found.add((start, e - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, text: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold runs: no run crosses a cut."""
    at = np.arange(len(codes))
    part = text.astype(np.int64)
    while len(at):
        before = len(at)
        # Pairs of neighbours that occur once in their stretch are cut; a run's pairs occur once a period.
        joined = (part[1:] == part[:-1]) & (at[1:] == at[:-1] + 1)
        _, code, count = np.unique(part * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        pair = np.where(joined, code[:-1] * len(count) + code[1:], -1)
        _, place, often = np.unique(pair, return_inverse=True, return_counts=True)
        whole = joined & (often[place] >= periods - 1) if len(pair) else joined
        stay = count[code] >= periods
        whole &= stay[1:] & stay[:-1]
        part = np.concatenate([[0], np.cumsum(~whole)])
        stay &= np.bincount(part)[part] >= least
        at, part = at[stay], part[stay]
        if len(at) == before and whole.sum() == joined.sum():
            break
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(at) else at
    return at[new], at[np.concatenate([new[1:], [len(at)]]) - 1] + 1 if len(at) else at


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed): each row's runs by start and period, and its words less those that lie in a run after its first period."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = flat(part.column(1))
        starts, ends, text = space_words(data, off)
        n, n_words = part.num_rows, len(starts)
        width = ends - starts
        solid = np.zeros(len(data) + 1, np.int8)
        solid[starts] += 1
        solid[ends] -= 1
        inside = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
        words = pa.Array.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int64)), pa.py_buffer(data[inside])])
        named = words.dictionary_encode()
        codes = named.indices.to_numpy().astype(np.int64)
        keep = np.ones(n_words, bool)
        first = np.searchsorted(text, np.arange(n + 1))
        found: dict[int, list[tuple[int, int, int]]] = {}
        a, b = stretches(codes, text, least, periods) if n_words else (np.zeros(0, int), np.zeros(0, int))
        if len(a):
            used = np.unique(np.concatenate([codes[i:j] for i, j in zip(a, b, strict=True)]))
            rank = np.zeros(int(used[-1]) + 1, np.int64)
            rank[used[pc.sort_indices(named.dictionary.take(pa.array(used))).to_numpy()]] = np.arange(len(used))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                for s, length, p in runs_of(rank[codes[i:j]], least, periods):
                    found.setdefault(int(text[i]), []).append((i + s - int(first[text[i]]), length, p))
                    keep[i + s + p : i + s + length] = False
        # What is left: the bytes of kept words, and a space in the byte before each but a text's first.
        mask = np.repeat(keep, width)
        left = np.zeros(len(data), bool)
        left[inside] = mask
        number = np.cumsum(keep) - keep
        later = keep & (number > number[np.minimum(first[text], max(n_words - 1, 0))]) if n_words else keep
        left[starts[later] - 1] = True
        shown = data.copy()
        shown[starts[later] - 1] = 32
        sizes = np.concatenate([[0], np.cumsum(left)])[off]
        collapsed = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(shown[left])])
        lists = [[{"start": s, "length": m, "period": p} for s, m, p in sorted(found.get(k, []), key=lambda r: (r[0], r[2]))] for k in range(n)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(lists, kind), collapsed.cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield one(part)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exponent, compared as exact fractions; of equal ones the first by start and then by period."""
    better = lambda a, b: (b["length"].cast("decimal(38,0)") * a["period"]) > (a["length"].cast("decimal(38,0)") * b["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))
