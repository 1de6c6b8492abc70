"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A vocabulary of ranks (one base64 token and its rank a line) becomes a BPE model of the
library: each byte is written as one printable character, and every pair of tokens whose
concatenation is a token is a merge of that token's rank. Texts are cut by the pattern, and
each piece is encoded by the library once for each worker and kept in a bounded table, as
natural text repeats its pieces. Decoding reverses the byte table, so ids that end inside a
character give back the very bytes.

Defined results: a null or empty text has no ids; equal rows give equal results; an empty
table gives an empty table; columns other than the two named are ignored; a very long text is
one row like any other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.llm.arrow_text import slices

#: Bytes of pieces and their ids, about, that a worker's table keeps before it is emptied; bytes of texts that are cut at once, or one text.
KEPT_BYTES, SLICE = 40 << 20, 1 << 19
_codecs: dict[tuple[str, str], "ByteBpe"] = {}


def byte_characters() -> list[str]:
    """A printable character for each byte: the byte's own where Latin-1 prints it, else the next from 256 up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encodes texts to ids and decodes ids to bytes; one for each worker and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.characters = byte_characters()
        named = {token: "".join(self.characters[b] for b in token) for token in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(named[a], named[b]) for a, b in sorted(cuts, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
        model = models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.findall = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.kept = 0
        size = max(ranks.values(), default=-1) + 1
        back = {c: b for b, c in enumerate(self.characters)}
        table = [b""] * size
        for name, rank in self.tokenizer.get_vocab().items():
            table[rank] = bytes(back[c] for c in name)
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        self.table = np.frombuffer(b"".join(table), np.uint8)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.asarray(found.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.asarray(found.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            for k, piece in enumerate(part):
                self.pieces[piece] = raw[cuts[k] : cuts[k + 1]]
                self.kept += 160 + 2 * len(piece) + cuts[k + 1] - cuts[k]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.findall(text) for text in texts]
        new = set().union(*cut) - self.pieces.keys() if cut else ()
        if new:
            if self.kept > KEPT_BYTES:
                self.pieces.clear()
                self.kept = 0
                new = set().union(*cut)
            self._learn(list(new))
        get = self.pieces.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.table[at].tobytes()

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id's span in characters; ids that share a character share it whole."""
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        number = np.concatenate([[0], np.cumsum(lead)])
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        first = number[starts] - np.where(lead[np.minimum(starts, max(len(raw) - 1, 0))], 0, 1) if len(ids) else number[starts]
        return first.astype(np.int32), number[ends].astype(np.int32)


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (array of int), and ``starts``/``ends`` in characters of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in tool.encode(texts)]
                spans = [tool.offsets(x, t.encode()) for x, t in zip(ids, texts, strict=True)]
                lists = [[x.astype(np.int32) for x in ids], [s for s, _ in spans], [e for _, e in spans]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], names=[id_col, "ids", "starts", "ends"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``bytes`` (binary), the concatenated bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for batch in batches:
            raw = [tool.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids in the same pass: id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                packed = tool.encode([t or "" for t in part.column(1).to_pylist()])
                decoded = [hashlib.sha256(tool.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in packed]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array(decoded)],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
