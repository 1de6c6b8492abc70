"""Substring de-duplication by suffix automata of reference shards: spans of 50 words and more that a smaller document has go.

A window is 50 consecutive words. Equal windows have equal grams of 12 words, so the smallest gram hash of
a window says where its copies are: a run of windows with one such gram is a piece, and all copies of a
window lie in pieces of one gram. Only grams of two documents and more go on, and of equal pieces only the
one of the smallest document; the other copies are removed whole. What is left, pieces of a gram that differ,
meets in buckets.

A bucket's pieces in order of documents, up to about ``SHARD`` words, are its reference shard. A task
builds the suffix automaton of the shard, each state with the first document that it occurs in, and the
pieces stream past: the matching statistics tell the spans of 50 words and more, and the state of
each window whether a smaller document has it. The shard's own pieces are judged as they enter; only windows
that are new are added. A bucket with more pieces than one shard holds is dealt to several tasks, each with
its shard, and the windows that the shard does not have go to the next round, where they are narrowed
to those whose two halves occur in two documents among what is still open. So a passage in a third of all
documents takes two rounds, and no task holds more than a shard.

Defined results: words are parted by white space as in ``space_words`` and compared as they are written.
A null, empty or blank text has no words, loses none and leaves the empty text. Windows of one document and
windows of rows with one id do not remove each other, so repeated rows and ties of an id share their
fate. A null id comes after all others; rows with null ids do not remove each other. Extra columns are
ignored; an empty table gives an empty table. What a text loses depends on the input only. Pieces count as equal
by two hashes of 64 bits, of one gram and of all words; the automata compare the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.arrow_text import flat, slices, space_words, span_hashes
from quillstream.llm.shared import written

WINDOW, GRAM = 50, 12
#: Windows of one piece at most, words of a reference shard and words that one task judges by it, about.
PIECE, SHARD = 4096, 100_000
NO_ID = 2**63 - 1
_FRACTIONS = [0.5**k for k in range(1, 25)]


def smallest(g: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g


def pieces_of(h: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, ends and grams of the pieces of texts whose words have the hashes ``h``."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = min(GRAM, window)
    begins = np.arange(n - size + 1)
    gram = smallest(span_hashes(h, begins, begins + size), window - size + 1).view(np.int64)
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(at):
        return at, at, gram[:0]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (gram[at[1:]] != gram[at[:-1]]) | (text[at[1:]] != text[at[:-1]])]))
    size = np.diff(np.concatenate([new, [len(at)]]))
    first = np.repeat(new, -(-size // PIECE))
    first = first + PIECE * (np.arange(len(first)) - np.repeat(np.cumsum(-(-size // PIECE)) - -(-size // PIECE), -(-size // PIECE)))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], at[last] + window, gram[at[first]]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))


def sketch(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, whole, key, copy, start, n) of every piece of rows (key, copy, text); ``whole`` is the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column(2))
                starts, ends, text = space_words(data, off)
                h = span_hashes(data, starts, ends)
                a, b, gram = pieces_of(h, text, window)
                if len(a):
                    row, first = text[a], np.searchsorted(text, np.arange(part.num_rows))
                    ids = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(span_hashes(h, a, b).view(np.int64)), part.column(0).take(ids), part.column(1).take(ids), pa.array((a - first[row]).astype(np.int32)), pa.array((b - a).astype(np.int32))], names=["gram", "whole", "key", "copy", "start", "n"])

    return rows.mapInArrow(run, "gram long, whole long, key long, copy long, start int, n int")


def _packed(rows: DataFrame) -> DataFrame:
    """(key, copy, z): texts compressed, as they are about to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column(2))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([tool.compress(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["key", "copy", "z"])

    return rows.mapInArrow(run, "key long, copy long, z binary")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, whole, key, n, words): the words of wanted pieces (gram, whole, key, copy, start, n), joined by spaces."""
    lists = wanted.groupBy(F.col("key").alias("_key"), F.col("copy").alias("_copy")).agg(F.collect_list(F.struct("gram", "whole", "start", "n")).alias("pieces"))
    # One row of each id and text is enough to read a piece from.
    there = _packed(rows).join(lists, (F.col("key") == F.col("_key")) & (F.col("copy") == F.col("_copy"))).dropDuplicates(["key", "copy"]).select("key", "z", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, z, found in zip(*batch.columns, strict=True):
                words = tool.decompress(z.as_py()).split()
                out = [(p["gram"], p["whole"], key.as_py(), p["n"], b" ".join(words[p["start"] : p["start"] + p["n"]])) for p in found.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["gram", "whole", "key", "n", "words"])

    return there.mapInArrow(run, "gram long, whole long, key long, n int, words binary")


class Automaton:
    """A suffix automaton of word sequences that are added in order of their documents; each state knows its first document."""

    def __init__(self, window: int):
        self.window = window
        self.go: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def add(self, words: list, doc: int) -> None:
        go, link, size, first = self.go, self.link, self.size, self.first
        last = 0
        for w in words:
            q = go[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                new = len(go)
                go.append({})
                link.append(0)
                size.append(size[last] + 1)
                first.append(doc)
                p = last
                while p >= 0 and w not in go[p]:
                    go[p][w] = new
                    p = link[p]
                last = new
                if p < 0:
                    continue
                q = go[p][w]
                if size[q] == size[p] + 1:
                    link[new] = q
                    continue
            else:
                new, p = None, last
            copy = len(go)  # the part of q's class that is not longer than what is added
            go.append(dict(go[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            first.append(first[q])
            while p >= 0 and go[p].get(w) == q:
                go[p][w] = copy
                p = link[p]
            link[q] = copy
            if new is None:
                last = copy
            else:
                link[new] = copy

    def windows(self, words: list) -> list[int | None]:
        """For each window of ``words`` the first document that has it, or None."""
        go, link, size, first, limit = self.go, self.link, self.size, self.first, self.window
        state = length = 0
        out = []
        for w in words:
            to = go[state].get(w)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = go[state].get(w)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
                while size[link[state]] >= limit:  # only the last ``limit`` words count
                    state, length = link[state], limit
            out.append(first[state] if length >= limit else None)
        return out[limit - 1 :]


def spans(flags: list[bool] | np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPANS_SQL = "array<struct<a:int,b:int>>"


def _judged(rows: DataFrame, window: int) -> DataFrame:
    """(gram, whole, key, n, words, gone, open): each piece's windows, as spans, that a smaller document has, and those still open.

    ``rows`` (bucket, share, guest, told, key, gram, whole, n, words, open) hold the shard's pieces (guest false) before those that stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, machine = None, None
        for batch in batches:
            out = []
            for bucket, share, guest, told, key, gram, whole, n, words, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, share) != where:
                    where, machine = (bucket, share), Automaton(window)
                letters = words.split(b" ")
                gone, rest = [], []
                for o in open_:
                    found = machine.windows(letters[o["a"] : o["b"] + window - 1])
                    if not guest and key != NO_ID:
                        for a, b in spans([d is None for d in found]):
                            machine.add(letters[o["a"] + a : o["a"] + b + window - 1], key)
                    gone += [(o["a"] + a, o["a"] + b) for a, b in spans([d is not None and d < key for d in found])]
                    if guest:
                        rest += [(o["a"] + a, o["a"] + b) for a, b in spans([d is None for d in found])]
                if told and (gone or rest):
                    out.append((gram, whole, key, n, words if rest else None, [{"a": a, "b": b} for a, b in gone], [{"a": a, "b": b} for a, b in rest]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), _SPANS, _SPANS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "whole", "key", "n", "words", "gone", "open"])

    return rows.mapInArrow(run, f"gram long, whole long, key long, n int, words binary, gone {_SPANS_SQL}, open {_SPANS_SQL}")


def _round(pieces: DataFrame, buckets: int, window: int) -> DataFrame:
    """One round over pieces (gram, whole, key, n, words, open), see ``_judged``."""
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    size = F.sum("n").alias("size"), F.percentile_approx("key", _FRACTIONS, 10_000).alias("marks")
    sizes = placed.groupBy("bucket").agg(*size)
    mark = F.least(F.ceil(F.log2(F.col("size") / SHARD)), F.lit(len(_FRACTIONS))).cast("int")
    until = F.when(F.col("size") <= SHARD, F.lit(NO_ID)).otherwise(F.element_at("marks", mark))
    sizes = written(sizes.select("bucket", until.alias("until"), F.ceil(F.col("size") / SHARD).cast("int").alias("shares")), "buckets")
    dealt = placed.join(sizes, "bucket").withColumn("guest", F.col("key") > F.col("until"))
    columns = ["bucket", "share", "guest", "told", "key", "gram", "whole", "n", "words", "open"]
    hosts = dealt.where("NOT guest").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("told", F.col("share") == 0)
    guests = dealt.where("guest").withColumn("share", F.pmod(F.xxhash64("gram", "whole"), F.col("shares")).cast("int")).withColumn("told", F.lit(True))
    both = hosts.select(columns).unionByName(guests.select(columns))
    return _judged(both.repartition("bucket", "share").sortWithinPartitions("bucket", "share", "guest", "key", "gram", "whole"), window)


def _narrowed(open_: DataFrame, window: int) -> DataFrame:
    """The pieces with those open windows whose two halves occur in open windows of two documents."""
    half = window // 2

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, whole, key, words, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(words, np.uint8)
                starts, ends, _ = space_words(data, np.array([0, len(data)]))
                h = span_hashes(data, starts, ends)
                # A window at i has the halves at i and at i + window - half.
                at = np.unique(np.concatenate([np.arange(o["a"] + s, o["b"] + s) for o in found for s in (0, window - half)]))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(span_hashes(h, at, at + half).view(np.int64)), pa.array([gram] * n, pa.int64()), pa.array([whole] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(at.astype(np.int32))], names=["half", "gram", "whole", "key", "at"])

    rows = written(open_.select("gram", "whole", "key", "words", "open").mapInArrow(halves, "half long, gram long, whole long, key long, at int"), "halves")
    shared = rows.groupBy("half").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("half")
    places = rows.join(shared, "half", "left_semi").groupBy("gram", "whole").agg(F.collect_set("at").alias("places"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, whole, key, n, words, found, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                has = np.zeros(n + 1, bool)
                has[at] = True
                still = np.zeros(n, bool)
                for o in found:
                    i = np.arange(o["a"], o["b"])
                    still[i] = has[i] & has[i + window - half]
                if still.any():
                    out.append((gram, whole, key, n, words, [{"a": a, "b": b} for a, b in spans(still)]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), _SPANS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "whole", "key", "n", "words", "open"])

    return open_.join(places, ["gram", "whole"]).select("gram", "whole", "key", "n", "words", "open", "places").mapInArrow(kept, f"gram long, whole long, key long, n int, words binary, open {_SPANS_SQL}")


def removed_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, copy, spans): spans of words [a, b), not merged, of rows (key, copy, text) that smaller documents have."""
    pieces = written(sketch(rows, window), "pieces")
    shared = pieces.groupBy("gram").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("gram")
    found = written(pieces.join(shared, "gram", "left_semi"), "shared-pieces")

    # Of equal pieces the first document's stays to be judged; all others go whole.
    first = F.min(F.struct("key", "copy", "start", "n")).alias("first")
    contents = written(found.groupBy("gram", "whole").agg(first), "contents")
    several = contents.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    judged = contents.join(several, "gram", "left_semi").select("gram", "whole", "first.*")
    open_ = written(_texts(rows, judged).withColumn("open", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - (window - 1)).cast("int").alias("b")))), "open")
    buckets = max(1, round(3 * (open_.agg(F.sum("n")).first()[0] or 0) / SHARD))
    told = None
    while not open_.isEmpty():
        done = written(_round(open_, buckets, window), "judged")
        gone = done.where(F.size("gone") > 0).select("gram", "whole", F.explode("gone").alias("w"))
        told = gone if told is None else told.unionByName(gone)
        open_ = written(_narrowed(done.where(F.size("open") > 0).drop("gone"), window), "open")

    owner = contents.select("gram", "whole", F.col("first.key").alias("owner"))
    copies = found.join(owner, ["gram", "whole"])
    spans_ = copies.where("key > owner").select("key", "copy", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    if told is not None:
        own = copies.where("key = owner").join(told, ["gram", "whole"])
        spans_ = spans_.unionByName(own.select("key", "copy", (F.col("start") + F.col("w.a")).alias("a"), (F.col("start") + F.col("w.b") + window - 1).alias("b")))
    return spans_.groupBy("key", "copy").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, n_spans, kept_sha256) of every row, with the kept words as text after them if asked for."""
    rows = _keyed(df, id_col, text_col)
    lost = removed_spans(rows, window).select(F.col("key").alias("_key"), F.col("copy").alias("_copy"), "spans")
    told = _packed(rows).join(lost, (F.col("key") == F.col("_key")) & (F.col("copy") == F.col("_copy")), "left").select("key", "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for key, z, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    words = tool.decompress(z.as_py()).split()
                    n, cut = len(words), []
                    for s in sorted((s["a"], s["b"]) for s in found or ()):
                        if cut and s[0] <= cut[-1][1]:
                            cut[-1] = (cut[-1][0], max(cut[-1][1], s[1]))
                        else:
                            cut.append(s)
                    for a, b in reversed(cut):
                        del words[a:b]
                    kept = b" ".join(words)
                    out.append((None if key == NO_ID else key, n, sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = [id_col, "n_words", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else ())]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else ())]
    return told.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else ""))
