"""Exact substring de-duplication with suffix arrays: bytes of repeated strings of ``LENGTH`` bytes go.

Every window of ``LENGTH`` bytes has a key that only its content decides: the hash of its smallest
k-mer. Consecutive windows of one key form a stretch. Equal windows have equal keys, so only stretches
whose key occurs again (in another text, or twice in one) can hold repeats; the others are left out
before any text is sorted. Stretches are dealt by key to buckets, and a bucket is worked in shards of
bounded size. Each shard gets a suffix array by Larsson-Sadakane refinement (ranks of 8 bytes, doubled,
sorting only the groups that are still open) and common prefixes by Kasai's inequality; windows whose
neighbours share ``LENGTH`` bytes are one class. Shards of a bucket are merged by binary search of the
windows of one in the sorted windows of the other. A window is removed if its class starts earlier.
A bucket of over ``HOT`` bytes is worked in rounds: its first shard, in order of documents, is sorted by
several tasks, and the other stretches are dealt to them and sought in it, a shard at a time. Windows that
nothing earlier has yet go on to the next round, narrowed to those whose two halves occur at two places among
what is left. So no task holds a bucket, and a passage in a third of all texts takes two rounds.

Texts that equal an earlier one are settled by their digest, and equal stretches of a task by a table,
before anything is sent, so a text or passage that fills a third of the table costs its task little.

Defined results: a null text is the empty one; texts shorter than ``LENGTH`` lose nothing; rows of one
id and text are one document, each with its result; rows of one id and different texts are documents of
which neither is earlier where positions are equal; null ids come last in order and return as null;
extra columns are ignored; an empty table gives an empty table; long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.arrow_text import _tables, flat, slices, span_hashes
from quillstream.llm.shared import written

LENGTH, KMER = 100, 24
#: Bytes of text for each bucket of keys and each bucket of stretches, and of a shard's stretches at most.
KEY_BUCKET, STRETCH_BUCKET, SHARD = 32 << 20, 3 << 20, 2 << 20
#: Bytes of stretches from which a bucket is worked in rounds.
HOT = 4 * SHARD
_FRACTIONS = [0.5**k for k in range(1, 25)]
_LAST = 2**63 - 1


# --- windows and their keys -------------------------------------------------------------------


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, key, text and number of k-mer places of each stretch of a run of texts."""
    n, width = len(data), LENGTH - KMER + 1
    none = np.zeros(0, np.int64)
    lengths = np.diff(off)
    if n < LENGTH or not (lengths >= LENGTH).any():
        return none, none, none.astype(np.uint64), none, none
    powers, inverses = _tables(n + 1)
    bits = np.uint64(max(24, int(n).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
        h = (total[KMER:] - total[:-KMER]) * inverses[: n - KMER + 1]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones is smallest
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    number = np.maximum(lengths - LENGTH + 1, 0)
    begins, sizes = off[:-1][number > 0], number[number > 0]
    change = np.zeros(len(place) + 1, np.int32)
    change[begins] += 1
    np.add.at(change, begins + sizes, -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
    edge[begins] = True
    first = np.flatnonzero(edge)
    end = np.concatenate([first[1:], [len(place)]])
    ok = inside[first]
    first, end = first[ok], end[ok]
    key, text = h[place[first]], np.searchsorted(off, first, "right") - 1
    joined = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
    places = np.diff(np.concatenate([joined, [len(key)]]))
    return first[joined], np.concatenate([end[joined[1:] - 1], end[-1:]]), key[joined], text[joined], places


_KEYS = "bucket int, kind int, ids binary, ths binary, places binary, keys binary, flags binary"


def _key_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys of each slice of texts, by bucket (kind 0), and the keys known to repeat within the slice (kind 1)."""
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            ids, ths = (part.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            _, _, key, text, places = stretches(*flat(part.column(2)))
            if not len(key):
                continue
            order = np.lexsort((text, key))
            key, text, places = key[order], text[order], places[order]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(fresh) - 1
            begins = np.flatnonzero(fresh)
            sizes = np.diff(np.concatenate([begins, [len(key)]]))
            low, high = np.minimum.reduceat(ths[text], begins), np.maximum.reduceat(ths[text], begins)
            same_text = np.concatenate([[False], (key[1:] == key[:-1]) & (text[1:] == text[:-1])])
            repeats = (low != high) | (np.maximum.reduceat(places, begins) > 1) | (np.add.reduceat(same_text.astype(np.int64), begins) > 0)
            # One entry for a key that repeats here, all its texts for one that does not (copies of a text).
            chosen = np.flatnonzero(~repeats[group] | fresh)
            bucket = (key[chosen] >> np.uint64(20)) % np.uint64(n_buckets)
            by = np.argsort(bucket, kind="stable")
            chosen, bucket = chosen[by], bucket[by]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = []
            for i, j in zip(cuts, [*cuts[1:], len(chosen)], strict=True):
                at = chosen[i:j]
                docs, place = np.unique(text[at], return_inverse=True)
                rows.append((int(bucket[i]), 0, ids[docs].tobytes(), ths[docs].tobytes(), place.astype(np.uint32).tobytes(), key[at].tobytes(), repeats[group[at]].astype(np.uint8).tobytes()))
            at = np.flatnonzero(repeats[group])
            at = at[~same_text[at]]
            if len(at):
                docs, place = np.unique(text[at], return_inverse=True)
                rows.append((int(ths[docs[0]] % n_buckets), 1, ids[docs].tobytes(), ths[docs].tobytes(), place.astype(np.uint32).tobytes(), key[at].tobytes(), b""))
            yield _record(rows, _KEY_SCHEMA)


_KEY_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("ids", "ths", "places", "keys", "flags"))])


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _key_batch(ids: np.ndarray, ths: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """A row for each document and key."""
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), pa.array(keys.view(np.int64))], names=["id", "th", "key"])


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: (id, th, key) of the documents of keys that occur again."""
    now, held = None, []

    def settle() -> Iterator[pa.RecordBatch]:
        if held:
            ids, ths, keys, flags = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            ids, ths, keys, flags = ids[order], ths[order], keys[order], flags[order]
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            again = (np.minimum.reduceat(ths, begins) != np.maximum.reduceat(ths, begins)) | (np.maximum.reduceat(flags, begins) > 0)
            # Entries flagged as repeating within their slice have told their documents there.
            at = np.repeat(again, np.diff(np.concatenate([begins, [len(keys)]]))) & (flags == 0)
            if at.any():
                yield _key_batch(ids[at], ths[at], keys[at])
            held.clear()

    for batch in batches:
        for bucket, kind, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, ths, places, keys = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, np.uint32, np.uint64), strict=False))
            ids, ths = ids[places], ths[places]
            if kind == 1:
                yield _key_batch(ids, ths, keys)
                continue
            if bucket != now:
                yield from settle()
                now = bucket
            held.append((ids, ths, keys, np.frombuffer(raw[4], np.uint8)))
    yield from settle()


# --- stretches and shards ---------------------------------------------------------------------

_STRETCH_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("ths", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("z", pa.binary()), ("bytes", pa.int64())])
_STRETCHES = "bucket int, kind int, ids binary, ths binary, starts binary, sizes binary, z binary, bytes long"


def _collapse(strings: list[bytes], ids: list[int], ths: list[int], starts: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of the strings that come first among equal ones, and of the others."""
    first: dict[bytes, int] = {}
    later = []
    for i, s in enumerate(strings):
        j = first.setdefault(s, i)
        if j != i:
            if (ids[i], starts[i]) < (ids[j], starts[j]):
                first[s], i = i, j
            if (ids[i], starts[i]) != (ids[first[s]], starts[first[s]]):
                later.append(i)
    return list(first.values()), later


def _found(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[tuple]:
    """From (id, th, z, keys), 128 documents at a time: ids, hashes, bytes and offsets, and (begin, end, text, bucket) of the stretches of repeating keys."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            texts = [unpack.decompress(z) for z in part.column(2).to_pylist()]
            keys = np.unique(part.column(3).flatten().to_numpy().view(np.uint64))
            data, off = flat(pa.array(texts, pa.large_binary()))
            first, end, key, text, _ = stretches(data, off)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key) if len(keys) else np.zeros(0, np.int64)
            bucket = ((key[at] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            yield part.column(0).to_pylist(), part.column(1).to_pylist(), data, off, first[at], end[at], text[at], bucket


def _stretch_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """From (id, th, z, keys): the stretches of repeating keys by bucket; of equal ones of a task all but the first are settled (kind 1)."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    held: list[tuple[bytes, int, int, int, int]] = []
    size = 0

    def settle() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        strings, ids, ths, starts, buckets = map(list, zip(*held, strict=True))
        kept, later = _collapse(strings, ids, ths, starts)
        rows = []
        kept.sort(key=lambda i: buckets[i])
        at = 0
        while at < len(kept):
            end = at
            while end < len(kept) and buckets[kept[end]] == buckets[kept[at]]:
                end += 1
            part = kept[at:end]
            rows.append((buckets[part[0]], 0, *_columns(ids, ths, starts, strings, part), pack.compress(b"".join(strings[i] for i in part)), sum(len(strings[i]) for i in part)))
            at = end
        if later:
            rows.append((ids[later[0]] % n_buckets, 1, *_columns(ids, ths, starts, strings, later), b"", 0))
        yield _record(rows, _STRETCH_SCHEMA)
        held.clear()

    for ids, ths, data, off, first, end, text, bucket in _found(batches, n_buckets):
        raw = data.tobytes()
        for a, b, t, k in zip(first.tolist(), end.tolist(), text.tolist(), bucket.tolist(), strict=True):
            held.append((raw[a : b + LENGTH - 1], ids[t], ths[t], a - int(off[t]), k))
            size += b - a + LENGTH - 1
        if size > 16 * SHARD:
            yield from settle()
            size = 0
    yield from settle()


def _columns(ids: list, ths: list, starts: list, strings: list, part: list[int]) -> tuple[bytes, ...]:
    return tuple(np.array([x[i] for i in part], np.int64).tobytes() for x in (ids, ths, starts)) + (np.array([len(strings[i]) for i in part], np.int64).tobytes(),)


def packed_words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(words8: np.ndarray, mark: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and which of them share their first ``mark`` bytes with another.

    Larsson-Sadakane: groups of equal ranks are sorted by the rank ``h`` bytes on, doubling ``h``; groups
    of one are never touched again.
    """
    n = len(words8)
    order = np.argsort(words8)
    ranked = words8[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    slot = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot
    alone = begins & np.concatenate([begins[1:], [True]]) if n else begins
    open_ = np.flatnonzero(~alone)  # places in the suffix array that belong to groups of several
    deep = np.zeros(n, bool)
    h = 8
    while len(open_):
        if h == mark:
            deep[order[open_]] = True
        at, group = order[open_], slot[open_]
        # Of suffixes that end within h bytes the shorter comes first; zeros beyond the end decide nothing.
        behind = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1 - at)
        by = np.argsort(group * (2 * n) + behind + n)
        at, behind = at[by], behind[by]
        order[open_] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])])
        new = np.maximum.accumulate(np.where(fresh, open_, 0))
        slot[open_] = new
        rank[at] = new
        single = fresh & np.concatenate([fresh[1:], [True]])
        open_ = open_[~single]
        h *= 2
    return order, deep


def _equal_bytes(words8: np.ndarray, p: np.ndarray, q: np.ndarray, done: np.ndarray, cap: int) -> np.ndarray:
    """How many bytes from ``p`` and ``q`` are equal, up to ``cap``, given that ``done`` are."""
    n, out, at = len(words8), done.copy(), np.arange(len(p))
    while len(at):
        at = at[(out[at] < cap) & (np.maximum(p[at], q[at]) + out[at] < n)]
        x = words8[p[at] + out[at]] ^ words8[q[at] + out[at]]
        step = np.full(len(at), 8)
        for k in range(7):
            step[x >= np.uint64(1 << (8 * k))] = 7 - k
        step[x >= np.uint64(1 << 56)] = 0
        out[at] += step
        at = at[step == 8]
    return np.minimum(np.minimum(out, cap), n - np.maximum(p, q))


def common_prefixes(words8: np.ndarray, p: np.ndarray, before: np.ndarray, cap: int = LENGTH, lane: int = 64) -> np.ndarray:
    """Kasai: common prefix of each suffix ``p`` with ``before``, the one ahead of it in the suffix array.

    ``p`` rises, and the array orders whole suffixes, without which the inequality would not hold. Where ``p`` follows its predecessor by one byte, its prefix is shorter by one at most, so the
    comparison goes on from there; lanes of ``lane`` places are walked side by side.
    """
    out = np.zeros(len(p), np.int64)
    if not len(p):
        return out
    index = np.arange(len(p))
    fresh = np.concatenate([[True], p[1:] != p[:-1] + 1])
    begin = np.maximum.accumulate(np.where(fresh, index, 0))
    step = (index - begin) % lane
    for k in range(lane):
        at = np.flatnonzero(step == k)
        if not len(at):
            break
        known = np.maximum(out[at - 1] - 1, 0) if k else np.zeros(len(at), np.int64)
        out[at] = _equal_bytes(words8, p[at], before[at], known, cap)
    return out


class Shard:
    """Stretches of one bucket, at most about SHARD bytes: its sorted distinct windows and their first places."""

    def __init__(self, strings: list[bytes], ids: list[int], ths: list[int], starts: list[int]) -> None:
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings], np.int64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        self.words8 = packed_words(data)
        order, deep = suffix_array(self.words8)
        string = np.repeat(np.arange(len(strings)), sizes)
        within = np.arange(len(data)) - off[string]
        # Suffixes alone with their first 64 bytes share less with any neighbour; the rest is measured in text order.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = np.flatnonzero(deep & (place > 0))
        shared = np.zeros(len(order), np.int64)
        shared[place[at]] = common_prefixes(self.words8, at, order[place[at] - 1])
        group = np.cumsum(shared < LENGTH) - 1
        window = (within + LENGTH <= sizes[string])[order]
        order, group = order[window], group[window]
        fresh = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        self.group = np.cumsum(fresh) - 1
        self.order, self.string, self.within = order, string, within
        self.ids, self.ths, self.starts = (np.array(x, np.int64) for x in (ids, ths, starts))
        self.of_id, self.of_place = self.ids[string[order]], (self.starts[string] + within)[order]
        begins = np.flatnonzero(fresh)
        self.heads = order[begins]  # one window of each class, in order
        self.first_id, self.first_place = self.of_id[begins], self.of_place[begins]
        several = np.flatnonzero(np.diff(np.concatenate([begins, [len(order)]]))[self.group] > 1)
        by = several[np.lexsort((self.of_place[several], self.of_id[several], self.group[several]))]
        lead = by[np.concatenate([[True], self.group[by[1:]] != self.group[by[:-1]]])] if len(by) else by
        self.first_id[self.group[lead]], self.first_place[self.group[lead]] = self.of_id[lead], self.of_place[lead]

    def window_words(self, at: np.ndarray) -> np.ndarray:
        """The LENGTH bytes from each place as big-endian numbers, the last one cut to what is within."""
        steps = range(0, LENGTH, 8)
        out = np.stack([self.words8[np.minimum(at + k, len(self.words8) - 1)] for k in steps], axis=1)
        rest = LENGTH % 8
        if rest:
            out[:, -1] >>= np.uint64(8 * (8 - rest))
        return out

    def meet(self, other: "Shard") -> None:
        """Find each class of ``other`` among the sorted classes of this shard; both learn the earlier first place."""
        if not len(self.heads) or not len(other.heads):
            return
        wanted = other.window_words(other.heads)
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.heads))
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) // 2
            found = self.window_words(self.heads[middle])
            differ = found != wanted[open_]
            column = differ.argmax(1)
            line = np.arange(len(open_))
            less = differ.any(1) & (found[line, column] < wanted[open_][line, column])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        at = np.minimum(low, len(self.heads) - 1)
        hit = np.flatnonzero((self.window_words(self.heads[at]) == wanted).all(1))
        mine = at[hit]
        earlier = (self.first_id[mine] < other.first_id[hit]) | ((self.first_id[mine] == other.first_id[hit]) & (self.first_place[mine] < other.first_place[hit]))
        other.first_id[hit], other.first_place[hit] = np.where(earlier, self.first_id[mine], other.first_id[hit]), np.where(earlier, self.first_place[mine], other.first_place[hit])
        self.first_id[mine], self.first_place[mine] = other.first_id[hit], other.first_place[hit]

    def gone(self) -> np.ndarray:
        """Which windows, in sorted order, start earlier elsewhere."""
        first_id, first_place = self.first_id[self.group], self.first_place[self.group]
        return (first_id < self.of_id) | ((first_id == self.of_id) & (first_place < self.of_place))

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, first byte and end within it of the runs of consecutive windows that are chosen."""
        at = np.sort(self.order[chosen])
        cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (self.string[at[1:]] != self.string[at[:-1]])]) if len(at) else np.zeros(0, bool)
        begin = at[cut]
        end = at[np.concatenate([cut[1:], [True]])] if len(at) else at
        return self.string[begin], self.within[begin], self.within[end] + LENGTH

    def later(self) -> tuple[np.ndarray, ...]:
        """(id, th, begin, end) of byte ranges covered by windows that start earlier elsewhere."""
        s, begin, end = self.runs(self.gone())
        return self.ids[s], self.ths[s], self.starts[s] + begin, self.starts[s] + end


_SPAN_SCHEMA = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _bucket_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: removed ranges (id, th, begin, end)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    now, strings, ids, ths, starts = None, [], [], [], []

    def spans(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SPAN_SCHEMA)

    def settle() -> Iterator[pa.RecordBatch]:
        if strings:
            kept, later = _collapse(strings, ids, ths, starts)
            if later:
                begin = np.array([starts[i] for i in later], np.int64)
                yield spans(np.array([ids[i] for i in later], np.int64), np.array([ths[i] for i in later], np.int64), begin, begin + np.array([len(strings[i]) for i in later], np.int64))
            shards, part, size = [], [], 0
            for i in [*kept, None]:
                if i is None or (part and size + len(strings[i]) > SHARD):
                    shards.append(Shard(*([x[j] for j in part] for x in (strings, ids, ths, starts))))
                    part, size = [], 0
                if i is not None:
                    part.append(i)
                    size += len(strings[i])
            for k, shard in enumerate(shards):
                for other in shards[:k]:
                    other.meet(shard)
            for k, shard in enumerate(shards):  # again, as an earlier pair may have learnt of a still earlier place
                for other in shards[k + 1 :]:
                    other.meet(shard)
            for shard in shards:
                yield spans(*shard.later())
        for x in (strings, ids, ths, starts):
            x.clear()

    for batch in batches:
        for bucket, kind, *raw, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            i, t, s, n = (np.frombuffer(x, np.int64) for x in raw)
            if kind == 1:
                yield spans(i, t, s, s + n)
                continue
            if bucket != now:
                yield from settle()
                now = bucket
            text, cuts = unpack.decompress(z), np.concatenate([[0], np.cumsum(n)]).tolist()
            strings += [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ids += i.tolist()
            ths += t.tolist()
            starts += s.tolist()
    yield from settle()


# --- buckets in rounds ------------------------------------------------------------------------

_HOT = "bucket int, id long, th long, begin long, text binary"
_HOT_SCHEMA = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("begin", pa.int64()), ("text", pa.binary())])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch (bucket, id, th, begin, text) of packed ones."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for bucket, *raw, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            i, t, s, n = (np.frombuffer(x, np.int64).tolist() for x in raw)
            text, cuts = unpack.decompress(z), np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).tolist()
            yield _record([(bucket, *row, text[a:b]) for *row, a, b in zip(i, t, s, cuts[:-1], cuts[1:], strict=True)], _HOT_SCHEMA)


_JUDGED = "bucket int, id long, th long, begin long, end long, text binary"
_JUDGED_SCHEMA = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("text", pa.binary())])


def _round_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, share, guest, id, th, begin, text), a bucket's shard before its guests: removed ranges, without text, and guests' windows that are still open, with it."""
    where, host, held, size, hosting = None, None, [], 0, True

    def shard() -> Shard:
        strings, ids, ths, starts = map(list, zip(*held, strict=True))
        return Shard(strings, ids, ths, starts)

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal host
        if not held:
            return
        made, rows = shard(), []
        if hosting:
            host = made
        elif host is not None:
            host.meet(made)
        gone = made.gone()
        if not hosting or where[1] == 0:  # every task of a bucket sorts the shard, one tells of it
            s, begin, end = made.runs(gone)
            rows += [(where[0], *x, None) for x in zip(made.ids[s].tolist(), made.ths[s].tolist(), (made.starts[s] + begin).tolist(), (made.starts[s] + end).tolist(), strict=True)]
        if not hosting:
            s, begin, end = made.runs(~gone)
            rows += [(where[0], held[k][1], held[k][2], held[k][3] + a, held[k][3] + b, held[k][0][a:b]) for k, a, b in zip(s.tolist(), begin.tolist(), end.tolist(), strict=True)]
        if rows:
            yield _record(rows, _JUDGED_SCHEMA)

    for batch in batches:
        for bucket, share, guest, i, th, begin, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, share) != where or guest == hosting or (guest and size + len(text) > SHARD):
                yield from settle()
                held, size = [], 0
                if (bucket, share) != where:
                    where, host = (bucket, share), None
                hosting = not guest
            held.append((text, i, th, begin))
            size += len(text)
    yield from settle()


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, id, at, row): the hash and the place of each half window of the stretches (id, begin, text, row)."""
    half = LENGTH // 2
    for batch in batches:
        for i, begin, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(text, np.uint8)
            at = np.arange(len(data) - half + 1)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(span_hashes(data, at, at + half).view(np.int64)), pa.array(np.full(n, i, np.int64)), pa.array(at + begin), pa.array(np.full(n, row, np.int64))], names=["half", "id", "at", "row"])


def _narrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (bucket, id, th, begin, text, places): the runs of windows both halves of which have shared places."""
    for batch in batches:
        rows = []
        for bucket, i, th, begin, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            has = np.zeros(len(text) + 1, bool)
            has[np.array(places) - begin] = True
            both = np.flatnonzero(has[: len(text) - LENGTH + 1] & has[LENGTH - LENGTH // 2 : len(text) - LENGTH // 2 + 1])
            for run in np.split(both, np.flatnonzero(np.diff(both) > 1) + 1) if len(both) else ():
                a, b = int(run[0]), int(run[-1]) + LENGTH
                rows.append((bucket, i, th, begin + a, text[a:b]))
        if rows:
            yield _record(rows, _HOT_SCHEMA)


def _hot_spans(stretches_: DataFrame) -> DataFrame | None:
    """Removed ranges (id, th, begin, end) of the stretches (bucket, id, th, begin, text) of hot buckets."""
    told = None
    tell = lambda rows: rows if told is None else told.unionByName(rows)
    open_ = written(stretches_, "hot")
    while not open_.isEmpty():
        # Of equal stretches the first stays, and the others go whole.
        named = open_.withColumn("digest", F.sha2("text", 256))
        heads = named.groupBy("bucket", "digest").agg(F.min(F.struct("id", "begin")).alias("head"))
        joined = named.join(heads, ["bucket", "digest"])
        copies = joined.where(F.struct("id", "begin") > F.col("head"))
        told = tell(copies.select("id", "th", "begin", (F.col("begin") + F.octet_length("text")).cast("long").alias("end")))
        first = written(joined.where(F.struct("id", "begin") == F.col("head")).select("bucket", "id", "th", "begin", "text"), "hot-heads")

        size = F.sum(F.octet_length("text")).alias("size")
        sizes = first.groupBy("bucket").agg(size, F.percentile_approx("id", _FRACTIONS, 10_000).alias("marks"))
        mark = F.least(F.ceil(F.log2(F.col("size") / SHARD)), F.lit(len(_FRACTIONS))).cast("int")
        until = F.when(F.col("size") <= SHARD, F.lit(_LAST)).otherwise(F.element_at("marks", mark))
        dealt = first.join(sizes.select("bucket", until.alias("until"), F.ceil(F.col("size") / SHARD).cast("int").alias("shares")), "bucket").withColumn("guest", F.col("id") > F.col("until"))
        columns = ["bucket", "share", "guest", "id", "th", "begin", "text"]
        hosts = dealt.where("NOT guest").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        guests = dealt.where("guest").withColumn("share", F.pmod(F.xxhash64("id", "begin"), F.col("shares")).cast("int"))
        both = hosts.select(columns).unionByName(guests.select(columns)).repartition("bucket", "share").sortWithinPartitions("bucket", "share", "guest", "id", "begin", "th")
        judged = written(both.mapInArrow(_round_rows, _JUDGED), "hot-judged")
        told = tell(judged.where("text IS NULL").select("id", "th", "begin", "end"))

        left = judged.where("text IS NOT NULL").withColumn("row", F.xxhash64("bucket", "id", "th", "begin"))
        halves = written(left.select("id", "begin", "text", "row").mapInArrow(_halves, "half long, id long, at long, row long"), "hot-halves")
        place = F.struct("id", "at")
        shared = halves.groupBy("half").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("half")
        places = halves.join(shared, "half", "left_semi").groupBy("row").agg(F.collect_set("at").alias("places"))
        open_ = written(left.join(places, "row").select("bucket", "id", "th", "begin", "text", "places").mapInArrow(_narrow_rows, _HOT), "hot")
    return told


# --- the operator -----------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    tool = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = flat(part.column(2))
            raw = data.tobytes()
            z = [tool.compress(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], names=["id", "th", "z"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, th, z, spans): (id, th, n_removed, n_spans, kept_sha256, kept)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            rows = []
            for i, th, z, spans in zip(*(c.to_pylist() for c in batch.slice(start, 128).columns), strict=True):
                text, at, removed, n, kept = unpack.decompress(z), 0, 0, 0, []
                for begin, end in sorted((s["begin"], s["end"]) for s in spans):
                    if n == 0 or begin > at:
                        kept.append(text[at:begin])
                        n += 1
                        removed += end - begin
                        at = end
                    elif end > at:
                        removed += end - at
                        at = end
                kept = b"".join([*kept, text[at:]])
                rows.append((i, th, removed, n, hashlib.sha256(kept).hexdigest(), kept))
            yield _record(rows, _CUT_SCHEMA)


_CUT_SCHEMA = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is the remaining bytes, if asked for."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    base = written(rows.select("key", "id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    n_bytes = base.agg(F.sum("n_bytes")).first()[0] or 0
    n_keys, n_stretches = max(1, n_bytes // KEY_BUCKET), max(1, n_bytes // STRETCH_BUCKET)
    slots = lambda n: int(min(n, 20_000))
    first = base.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("id").alias("first_id"))

    keyed = rows.select("id", "th", "text").mapInArrow(lambda b: _key_rows(b, n_keys), _KEYS)
    dealt = keyed.repartition(slots(n_keys), "bucket").sortWithinPartitions("bucket")
    again = dealt.mapInArrow(_repeated_keys, "id long, th long, key long")
    # A document's keys come from many buckets; only the first of equal texts goes on.
    heads = base.join(first, (base["sha"] == first["sha"]) & (base["id"] == first["first_id"])).select("id", "th").distinct()
    keys_of = again.groupBy("id", "th").agg(F.collect_list("key").alias("keys"))
    packed = rows.select("id", "th", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(_packed, "id long, th long, z binary")
    candidates = written(packed.join(keys_of.join(heads, ["id", "th"], "left_semi"), ["id", "th"]).dropDuplicates(["id", "th"]), "candidates")

    found = candidates.select("id", "th", "z", "keys")
    made = written(found.mapInArrow(lambda b: _stretch_rows(b, n_stretches), _STRETCHES), "stretches")
    hot = made.where("kind = 0").groupBy("bucket").agg(F.sum("bytes").alias("size")).where(F.col("size") > HOT).select("bucket", F.lit(True).alias("hot"))
    flagged = made.join(hot, "bucket", "left")
    cold = flagged.where("hot IS NULL OR kind = 1").select("bucket", "kind", "ids", "ths", "starts", "sizes", "z")
    spans = cold.repartition(slots(n_stretches), "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_spans, "id long, th long, begin long, end long")
    rounds = _hot_spans(flagged.where("hot AND kind = 0").select("bucket", "ids", "ths", "starts", "sizes", "z").mapInArrow(_unpacked, _HOT))
    spans = spans if rounds is None else spans.unionByName(rounds)
    ranges = spans.groupBy("id", "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    cut = candidates.select("id", "th", "z").join(ranges, ["id", "th"]).mapInArrow(_cut, "id long, th long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = cut if with_text else cut.drop("kept").withColumn("kept", F.lit(None).cast("binary"))

    known = base.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    joined = known.join(cut.withColumnRenamed("n_removed", "r"), ["id", "th"], "left")
    pick = lambda whole, some, none: F.when(F.col("copy"), whole).otherwise(F.coalesce(some, none))
    out = joined.select(
        F.col("key").alias(id_col), "id", "th", "copy", "n_bytes",
        pick(F.col("n_bytes"), F.col("r"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"), "kept",
    )
    if not with_text:
        return out.select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    texts = rows.select("id", "th", F.col("text").cast("binary").alias("_text")).dropDuplicates(["id", "th"])
    whole = out.join(texts, ["id", "th"])
    kept = F.when(F.col("copy"), F.lit(b"")).otherwise(F.coalesce("kept", "_text")).alias("kept")
    return whole.select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", kept)
