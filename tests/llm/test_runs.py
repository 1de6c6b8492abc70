import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import queries, word_runs
from tests.llm.fixtures import DOCS, documents, plain


def brute_runs(t, least=24, periods=3):
    n, out = len(t), set()
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and t[j] == t[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, periods * p) and not any(t[i : i + size - q] == t[i + q : i + size] for q in range(1, p)):
                out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    a, g = (h // 10) % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, split(text))
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(250):
        k, t = rng.choice([1, 2, 3, 5]), []
        while len(t) < rng.randint(1, 70):
            t += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
        for least, periods in ((2, 2), (3, 3), (24, 3)):
            assert word_runs.runs_of(np.array(t), least, periods) == brute_runs(t, least, periods)


def test_lyndon_edges_and_extensions():
    rng = random.Random(9)
    for _ in range(200):
        t = [rng.randrange(3) for _ in range(rng.randint(1, 40))] * rng.randint(1, 3)
        nss, ext = word_runs.lyndon(t)
        for i in range(len(t)):
            assert nss[i] == next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            if nss[i] < len(t):
                common = next((m for m in range(len(t)) if nss[i] + m == len(t) or t[i + m] != t[nss[i] + m]), 0)
                assert ext[i] == common


class Counted(int):
    times = 0

    def __eq__(self, other):
        Counted.times += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("kind", ["equal", "fibonacci", "periodic", "blocks", "halves", "binary"])
def test_words_are_matched_a_bounded_number_of_times(kind):
    n, rng = 6000, random.Random(3)
    a, b = [1], [0]
    while len(a) < n:
        a, b = a + b, a
    t = {
        "equal": [1] * n, "fibonacci": a[:n], "periodic": ([rng.randrange(9) for _ in range(40)] * n)[:n], "halves": [0] * (n // 2) + [1] + [0] * (n // 2),
        "blocks": [x for i in range(1, 110) for x in [0] * i + [1]][:n], "binary": [rng.randrange(2) for _ in range(n)],
    }[kind]
    for sign in (1, -1):
        Counted.times = 0
        word_runs.lyndon([Counted(sign * x) for x in t])
        assert Counted.times <= 3 * len(t)


@pytest.mark.parametrize("seed", range(3))
def test_cuts_cross_no_run(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(60):
        u = [rng.randrange(30) for _ in range(rng.randint(1, 12))]
        words += u * rng.choice([1, 1, 2, 3, 5]) + [rng.randrange(500) for _ in range(rng.randint(0, 9))]
    codes = np.array(words)
    a, b = word_runs.stretches(codes, np.zeros(len(codes), np.int64), 24, 3)
    inside = [(s + i, m, p) for i, j in zip(a, b, strict=True) for s, m, p in word_runs.runs_of(codes[i:j])]
    assert sorted(inside, key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = plain(documents(spark))
    for i in range(100, 400):
        u = [f"ü{rng.randrange(40)}" for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\n", " \t", "\r\n  "]).join(rng.choice([[], ["lead"], u[1:]]) + u * rng.randint(1, 9) + rng.choice([[], ["tail"], u[:3]]))))
    rows += [(500, "same " * 5000), (501, " nbsp  " * 30), (502, " a b" * 8), (503, "x" * 100_000), (None, "same " * 30), (504, "same\x0b" * 24)]
    spark.createDataFrame([(i, t, 0.5, "s", 7, "k") for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_word_runs(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((expected(i, t) for i, t in rows), key=str)


def test_what_is_left_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a  b\n" * 12 + "end"), (2, None), (3, " \n"), (4, "no repeats here")], "n_words long, runs string")
    got = word_runs.repeats(df.withColumn("collapsed", F.lit("x")), "n_words", "runs")
    assert got.columns == ["n_words", "n_words", "runs", "collapsed"]
    out = word_runs.repeats(df.toDF("doc_id", "text").withColumn("runs", F.lit(1))).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out] == [(1, 25, [(0, 24, 2)], "a b end"), (2, 0, [], ""), (3, 0, [], ""), (4, 3, [], "no repeats here")]
    assert word_runs.repeats(df.toDF("doc_id", "text").limit(0)).count() == 0
