import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import automaton_dedup as A
from tests.llm.fixtures import DOCS, documents, plain, words


def brute(rows, window=50):
    last = 2**63 - 1
    texts = [((last if i is None else i), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, w in texts:
        gone = np.zeros(len(w) + 1, int)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = 1
        kept = b" ".join(x for x, g in zip(w, gone, strict=False) if not g)
        out.append((None if i == last else i, len(w), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in A.dedupe(df, **options).collect()), key=str)


def hot(rng, n):
    """A passage in every text between words of its own, near copies of one text, and a text that repeats itself."""
    passage, base = words(rng, 70), words(rng, 300, 2000).split()
    rows = []
    for i in range(n):
        rows.append((3 * i, f"{words(rng, rng.randint(0, 60), 10**6)} {passage} {words(rng, rng.randint(0, 60), 10**6)}"))
        near = list(base)
        for _ in range(3):
            near[rng.randrange(300)] = f"own{i}"
        rows.append((3 * i + 1, " ".join(near)))
        rows.append((3 * i + 2, "a b c " * rng.randint(10, 60)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard, piece", [(100_000, 4096), (600, 4096), (1500, 7)])
def test_equals_brute_force(spark, shard, piece, monkeypatch):
    monkeypatch.setattr(A, "SHARD", shard)  # small ones: several tasks a bucket, and several rounds
    monkeypatch.setattr(A, "PIECE", piece)
    rows = plain(documents(spark)) + [(None if i is None else i + 1000, t) for i, t in hot(random.Random(shard), 25)] + [(1001, "x\x0by z " * 40), (1001, "x\x0by z\n" * 40), (None, "a b c " * 50)]
    df = spark.createDataFrame([(i, t, 0.5, "s", 7, "k") for i, t in rows], DOCS).repartition(5)
    assert got(df, with_text=False) == brute(rows)


def test_other_windows_and_the_kept_words(spark):
    rows = [(i, words(random.Random(i % 4), 30, 20)) for i in range(12)] + [(20, None), (21, ""), (22, "w1x1")]
    df = spark.createDataFrame([(i, t, 0.5, "s", 7, "k") for i, t in rows], DOCS)
    for window in (3, 8, 13):
        assert got(df, window=window) == brute(rows, window)
    for r in A.dedupe(df, window=8).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], DOCS)
    assert got(empty) == []
    rows = [(i, words(random.Random(1), 60)) for i in range(3)]
    df = spark.createDataFrame([(i, t, 0.5, "s", 7, "k") for i, t in rows], DOCS)
    for name in ("key", "copy", "gram", "words", "open", "spans", "_key", "n"):
        df = df.withColumn(name, F.lit(1))
    assert got(df) == brute(rows)


def test_automaton_knows_every_substring():
    rng = random.Random(2)
    for _ in range(60):
        machine, seen, window = A.Automaton(4), {}, 4
        for doc in range(6):
            t = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
            assert machine.windows(t) == [seen.get(tuple(t[k : k + window])) for k in range(len(t) - window + 1)]
            machine.add(t, doc)
            for k in range(len(t) - window + 1):
                seen.setdefault(tuple(t[k : k + window]), doc)


def test_smallest_of_consecutive_values():
    g = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 39, 50):
        assert A.smallest(g, width).tolist() == [int(g[i : i + width].min()) for i in range(51 - width)]
