import hashlib

import numpy as np
import pytest

from quillstream.llm import suffix_dedup as S
from tests.llm.fixtures import DOCS, documents, plain


def brute(rows):
    last = 2**63 - 1
    docs = {((last if i is None else i), t or "") for i, t in rows}
    first = {}
    for i, t in docs:
        b = t.encode()
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            first[w] = min(first.get(w, (i, k)), (i, k))
    out = {}
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        edges = np.diff(np.concatenate([[0], gone[: len(b)].astype(int)]))
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i, t] = (len(b), int(gone[: len(b)].sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted((-1 if i is None else i, *out[(last if i is None else i), t or ""]) for i, t in rows)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small, monkeypatch):
    if small:  # many buckets, and several shards to merge in each
        monkeypatch.setattr(S, "STRETCH_BUCKET", 20_000)
        monkeypatch.setattr(S, "KEY_BUCKET", 5_000)
        monkeypatch.setattr(S, "SHARD", 1_500)
    df = documents(spark)
    got = S.dedupe(df, with_text=not small).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(plain(df))
    if not small:
        assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_no_documents_and_no_repeats(spark):
    assert S.dedupe(spark.createDataFrame([], DOCS)).count() == 0
    one = spark.createDataFrame([(1, "short", 0.0, "", 0, ""), (2, None, 0.0, "", 0, "")], DOCS)
    assert sorted((r.doc_id, r.n_removed, r.n_bytes) for r in S.dedupe(one).collect()) == [(1, 0, 5), (2, 0, 0)]


@pytest.mark.parametrize("text", [b"banana" * 40, bytes(300), b"abc" * 90 + b"abd" * 70, bytes(range(256)) * 3])
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    words8 = S.packed_words(data)
    order, _ = S.suffix_array(words8)
    padded = text + b"\0" * 8
    want = sorted(range(len(text)), key=lambda i: (padded[i : i + 8], text[i:]))
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text))) or order.tolist() == want
    place = np.argsort(order)
    at = np.flatnonzero(place > 0)
    before = order[place[at] - 1]
    got = S.common_prefixes(words8, at, before)

    def shared(p, q):
        n = 0
        while n < 100 and max(p, q) + n < len(text) and text[p + n] == text[q + n]:
            n += 1
        return n

    assert got.tolist() == [shared(p, q) for p, q in zip(at.tolist(), before.tolist(), strict=True)]


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 180).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, n).astype(np.uint8), passage, rng.integers(97, 123, 50).astype(np.uint8)]) for n in (0, 33, 180)]
    data, off = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    first, end, key, _, _ = S.stretches(data, off)
    seen = {}
    for a, b, k in zip(first, end, key, strict=True):
        for p in range(a, b):
            assert seen.setdefault(data[p : p + 100].tobytes(), k) == k
    assert len({k for w, k in seen.items()}) > 3


@pytest.mark.parametrize("shard", [3_000, 20_000])
def test_hot_buckets_are_worked_in_rounds(spark, monkeypatch, shard):
    """A line in every document, each time between other bytes, and near copies of one text: no task holds a bucket."""
    rng = np.random.default_rng(4)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    line, base = word(130), word(900)
    rows = [(i % 280, word(150) + line[: 60 + i % 70] + word(120) + line) for i in range(300)]
    for i in range(300, 380):
        at = int(rng.integers(0, 880))
        rows.append((i, base[:at] + word(3) + base[at + 3 :]))
    rows += [(400, base + base), (401, "ab" * 900), (None, base), (402, base), (402, base[50:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(S, "STRETCH_BUCKET", 4_000)
    monkeypatch.setattr(S, "HOT", 10_000)
    monkeypatch.setattr(S, "SHARD", shard)
    rounds = []
    monkeypatch.setattr(S, "_hot_spans", lambda rows, f=S._hot_spans: rounds.append(rows.count()) or f(rows))
    got = S.dedupe(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    assert rounds[0] > 200
