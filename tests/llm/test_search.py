import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import metric_tree as M

SCHEMA = "vec_id long, embedding array<float>, score long, rank int"


def brute(rows, k, every):
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % every == 0:
            found = sorted(((int(q @ x), j) for j, x in usable if j != i and len(x) == len(q)), key=lambda r: (-r[0], r[1]))[:k]
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, every=10):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in M.top_k(df, lambda c: c % every == 0, k).collect())


@pytest.mark.parametrize("block", [8192, 40])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(12)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (None, rows[0][1]), (310, [1.0, 2.0]), (311, [3.0, 4.0])]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_repeated_ids_of_one_vector(spark):
    same = [1.0, -2.0, 0.5]
    rows = [(50, same)] * 14 + [(i, same) for i in range(51, 56)] + [(60, same)] * 8 + [(61, [0.5, 0.5, 0.5])] * 3
    # The rows of one query id share a ranking, as in the SQL, so with 14 of them the best candidate fills it.
    assert [(q, n, j) for q, n, j, _ in run(spark, rows, every=50)] == [(50, n, 51) for n in range(1, 6)]
    assert [(n, j) for _, n, j, _ in run(spark, [(50, same), *rows[14:]], every=50)] == [(n, 50 + n) for n in range(1, 6)]
    # Of one repeated id alone each row is a candidate for the others.
    got = run(spark, [(10, same)] + [(12, same)] * 9, every=10)
    assert [(n, j) for _, n, j, _ in got] == [(n, 12) for n in range(1, 6)]


def test_few_and_none(spark):
    rows = [(0, [0.5, -0.5]), (1, [1.0, 1.0])]
    assert run(spark, rows) == [(0, 1, 1, 0)]
    df = spark.createDataFrame([], SCHEMA)
    assert M.top_k(df, lambda c: c % 10 == 0).count() == 0


def test_tree_pages_hold_their_radius():
    rng = np.random.default_rng(2)
    tree = M.MTree(rng.integers(-100, 100, (3000, 6)))
    assert sorted(x for _, rows, _, _ in tree.leaves for x in rows.tolist()) == list(range(3000))
    assert all((d <= radius + 1e-9).all() and len(d) <= M.PAGE for _, _, d, radius in tree.leaves)
    ids = [[i] for i in range(3000)]
    for q in rng.integers(-100, 100, (20, 6)):
        scores = tree.vectors @ q
        want = sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda r: (-r[0], r[1]))[:5]
        assert tree.search(q, 5, -(2**62), ids, -1) == want


def test_large_components_stay_exact():
    tree = M.MTree(np.array([[2**28, 1], [2**28, 3], [-(2**28), 5]]))
    assert tree.search(np.array([2**28, 1]), 2, -(2**62), [[0], [1], [2]], -1) == [(2**56 + 3, 1), (2**56 + 1, 0)]


def test_columns_may_clash(spark):
    df = spark.createDataFrame([(0, [1.0], 3, 4), (1, [2.0], 5, 6)], SCHEMA)
    got = M.top_k(df, lambda c: F.lit(True))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 2
