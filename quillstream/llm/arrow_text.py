"""Vectorised views of Arrow text columns: bytes, tokens and their hashes.

Everything here works on one Arrow batch inside a task. A null text is the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have ``limit`` bytes together, or one row each."""
    _, off = flat(batch.column(text))
    start, n = 0, len(off) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
            _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]), dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits, so that all bits of a hash can be used."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, the same for equal bytes anywhere."""
    powers, inverses = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


#: Classes of bytes: 0 space, 1 word (letters, digits, all of a character beyond ASCII), 2 other.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    CLASSES[_a:_b] = 1
#: ASCII letters in lower case, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(classes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of one class other than 0."""
    n = len(classes)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.ones(n + 1, bool)
    edge[1:n] = classes[1:] != classes[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    keep = classes[at[:-1]] != 0
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in ASCII lower case: hashes, text numbers, starts and ends."""
    only = np.where(CLASSES == 1, 1, 0).astype(np.uint8)[data]
    starts, ends, text = runs(only, off)
    return span_hashes(LOWER[data], starts, ends), text, starts, ends


#: Bytes that part words where only white space does: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def space_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words that white space parts, as they are written."""
    return runs((~SPACES[data]).astype(np.uint8), off)
