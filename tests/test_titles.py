import random

import pyarrow as pa
import pytest

from quillstream.operators import titles


def alike(x, y):
    grams = lambda v: {v[i : i + 2] for i in range(len(v) - 1)} or {v}
    if x in y or y in x:
        return min(len(x), len(y)) >= 8
    a, b = grams(x), grams(y)
    n = len(a & b)
    return n / min(len(a), len(b)) >= 0.65 and n / len(a | b) >= 0.45


def test_any_length_and_beginning(spark):
    """Pairs that begin differently, of under 8 and over 60 characters, and parts of a long title."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJ") for _ in range(n))
    long = word(300)
    cores = ["ABCDEF", "XABCDEF", "ABCDEF", "Q", "", "", long, long[120:140], long[40:], "ZZ" + long[:200], long]
    for _ in range(60):
        x = word(rng.choice((3, 5, 9, 20, 70, 150)))
        cores += [x, word(2) + x[1:], x[: len(x) // 2] + word(len(x) // 4)]
    got = titles.near_duplicates(spark.createDataFrame(list(enumerate(cores)), "doc_id long, title string"), "doc_id", "title").collect()
    head = {}
    for i, x in enumerate(cores):
        head.setdefault(x, i)
    kinds = sorted((i, x) for x, i in head.items() if x)
    want = {(i, j, "similar") for i, x in kinds for j, y in kinds if i < j and alike(x, y)}
    want |= {(head[x], i, "short" if len(x) < 8 else "equal") for i, x in enumerate(cores) if x and head[x] != i}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert (0, 1, "similar") not in want and (6, 7, "similar") in want


def test_within_a_span(spark):
    """Every pair of rows in reach, by brute force; equal titles make a chain."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ABCDEFGH") for _ in range(n))
    rows, cores = [], []
    for i in range(80):
        x = rng.choice(cores) if cores and i % 3 else word(rng.choice((1, 4, 9, 30, 90)))
        x = (x, word(3) + x, x[: len(x) // 2] + word(2), x[2:])[rng.randrange(4)]
        cores.append(x)
        rows.append((i, x, rng.randrange(120)))
    rows += [(80, None, 3), (81, "ABCDEFGHAB", None)]
    got = titles.near_duplicates_within(spark.createDataFrame(rows, "doc_id long, core string, t long"), "doc_id", "core", "t", 24).collect()
    usable = [r for r in rows if r[1] and r[2] is not None]
    want = {(a[0], b[0], "similar") for a in usable for b in usable if a[0] < b[0] and a[1] != b[1] and abs(a[2] - b[2]) <= 24 and alike(a[1], b[1])}
    for i, x, t in usable:
        before = max(((u, j) for j, y, u in usable if y == x and (u, j) < (t, i)), default=None)
        if before and t - before[0] <= 24:
            want.add((min(i, before[1]), max(i, before[1]), "equal"))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_shared_bigrams_are_counted_by_matrices_and_one_by_one(monkeypatch):
    rng = random.Random(3)
    left, right = (["".join(rng.choice("ABCDEF甲乙丙丁戊") for _ in range(rng.choice((1, 2, 9, 80)))) for _ in range(n)] for n in (40, 23))
    grams = lambda v: {v[i : i + 2] for i in range(len(v) - 1)} or {v}
    want = [[len(grams(x) & grams(y)) for y in right] for x in left]
    for few, columns in ((0, 7), (10**6, 7), (6, 5)):
        monkeypatch.setattr(titles, "FEW", few)
        monkeypatch.setattr(titles, "COLUMNS", columns)
        assert titles._shared(titles._bigrams(left), titles._bigrams(right), 40, 23).tolist() == want


def test_whole_titles_in_many_tiles(spark, monkeypatch):
    """Tiles of few titles: each pair is told once, whichever tiles its titles are in, and no task holds more than two tiles."""
    monkeypatch.setattr(titles, "TILE_ROWS", 8)
    rng = random.Random(11)
    cores = ["".join(rng.choice("ABCD") for _ in range(rng.choice((2, 9, 40)))) for _ in range(70)]
    got = titles.near_duplicates(spark.createDataFrame(list(enumerate(cores)), "doc_id long, title string"), "doc_id", "title").where("relation = 'similar'").collect()
    head = {}
    for i, x in enumerate(cores):
        head.setdefault(x, i)
    want = {(i, j) for x, i in head.items() for y, j in head.items() if i < j and alike(x, y)}
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want


def test_within_a_span_in_many_tiles(spark, monkeypatch):
    """Blocks of time of more rows than a tile takes, and times below zero."""
    monkeypatch.setattr(titles, "TILE_ROWS", 4)
    test_within_a_span(spark)
    rows = [(i, f"ABCDEFGHI{'XYZ'[i % 3] * 2}", t) for i, t in enumerate([-25, -24, -1, 0, 23, 24, -48, -25])]
    got = titles.near_duplicates_within(spark.createDataFrame(rows, "doc_id long, core string, t long"), "doc_id", "core", "t", 24).where("relation = 'similar'").collect()
    want = {(i, j) for i, x, t in rows for j, y, u in rows if i < j and x != y and abs(t - u) <= 24 and alike(x, y)}
    assert want and len(got) == len(want) and {(r[0], r[1]) for r in got} == want


@pytest.mark.parametrize("alone", [True, False])
def test_a_cell_of_wide_tiles_is_compared_in_parts(monkeypatch, alone):
    """Every pair of a cell once, where a tile takes many products; also texts that both tiles have, parts with few bigrams of their own, and single characters."""
    monkeypatch.setattr(titles, "TILE_ROWS", 8)
    monkeypatch.setattr(titles, "TILE_CHARS", 300)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("ABCDEF") for _ in range(rng.choice((1, 2, 7, 8, 30, 90))))
    cores = [word() for _ in range(60)]
    cores += [x[3:] + "ABABAB" for x in cores[:9]] + [x * 3 for x in cores[:9]] + cores[:4]
    second = [not alone and k % 3 == 0 for k in range(len(cores))]
    rows = pa.table({"a": [0] * len(cores), "b": [0 if alone else 1] * len(cores), "second": second, "id": range(len(cores)), "core": cores, "t": range(len(cores))})
    want = sorted((i, j) for i, x in enumerate(cores) for j, y in enumerate(cores) if (i < j if alone else second[i] < second[j]) and x != y and alike(x, y))
    got = [tuple(r.values()) for b in titles._met(iter(rows.to_batches())) for r in b.to_pylist()]
    assert sorted((x, y) for x, _, y, _ in got) == want and all((x, y) == (t, u) for x, t, y, u in got)
    plain = [tuple(r.values()) for b in titles._met_ever(iter(rows.drop_columns("t").to_batches())) for r in b.to_pylist()]
    assert sorted(plain) == want


def test_texts_go_to_few_cells():
    """340,000 titles of 400 characters (1 GB of documents) went to 333 cells each; few titles are still dealt to many."""
    assert titles._whole_tiles(340_000, 136_000_000) <= 42
    assert [titles._whole_tiles(n, 400 * n) for n in (0, 1, 1024, 1025, 34_000)] == [1, 1, 1, 2, 32]
