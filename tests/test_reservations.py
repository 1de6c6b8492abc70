import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import graph, reservations

T0 = dt.datetime(2024, 1, 1)
ITEMS = "i long, t timestamp, hits array<struct<rule:string,key:string,aliases:array<string>,minutes:long>>, outcome string, settled timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def told(spark, rows):
    df = spark.createDataFrame([(i, at(m), [(r, k, a, s) for r, k, a, s in hits], o, None if e is None else at(e)) for i, m, hits, o, e in rows], ITEMS)
    return {r.i: (r.status, tuple(r.reserved or ()), r.matched, r.first_event) for r in reservations.reserve_sets(df, "t", "i", "hits", "outcome", "settled").collect()}


def plain(rows):
    """One table of reservations for all rules, in time order."""
    table, events, out = {}, [], {}
    for i, m, hits, outcome, end in rows:
        later = outcome is not None and end is not None and end > m
        events.append((m, 1, str(i), i, hits, outcome, later))
        if later:
            events.append((end, 0, str(i), i, None, outcome, later))
    mine = {}
    for m, _, _, i, hits, outcome, later in sorted(events, key=lambda e: e[:3]):
        if hits is None:
            for k in mine.pop(i, []):
                if k in table and outcome == "sent":
                    table[k][1] = True
                elif k in table and not table[k][1]:
                    del table[k]
            continue
        seen, new, covered = set(), [], []
        for rule, key, aliases, span in hits:
            if not rule or not key or key in seen:
                continue
            seen.add(key)
            span = max(1, min(span, 90 * 24 * 60))
            found = key if key in table and table[key][0] >= m - span else None
            if found is None:
                near = [(table[a][0], a) for a in [a for a in aliases if a.strip() and a != key][:16] if a in table and table[a][0] >= m - min(span, 30 * 24 * 60)]
                found = min(near)[1] if near else None
            if found is None:
                new.append(key)
                continue
            covered.append((found, table[found][2]))
            if found != key and table[found][1]:
                table.setdefault(key, [m, True, table[found][2]])
        if not seen:
            continue
        for key in new:
            table[key] = [m, outcome == "sent" and not later, i]
        if later:
            mine[i] = new
        elif outcome == "failed":
            for key in new:
                del table[key]
        out[i] = (("failed" if outcome == "failed" else "reserved") if new else "duplicate", tuple(new), *(covered[0] if covered else (None, None)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_one_table_of_reservations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        group, m = rng.randrange(6), rng.randrange(20_000 if seed < 3 else 90_000)
        key = lambda: f"g{group}k{rng.randrange(6)}"  # noqa: B023, E731
        hits = [(rng.choice(["r1", "r2", ""]), rng.choice([key(), key(), ""]), [rng.choice([key(), " "]) for _ in range(rng.randrange(3))], rng.choice([0, 45, 600, 10**7])) for _ in range(rng.choice([1, 1, 2, 3]))]
        rows.append((i, m, hits, rng.choice(["sent", "sent", "failed", None]), rng.choice([None, m - 5, m, m + rng.randrange(900)])))
    assert told(spark, rows) == plain(rows)


def test_a_key_is_reserved_whatever_the_rule(spark):
    got = told(spark, [(1, 0, [("a", "k", [], 60)], "sent", None), (2, 30, [("b", "k", [], 60)], "sent", None), (3, 61, [("b", "k", [], 60)], "sent", None)])
    assert [got[i][0] for i in (1, 2, 3)] == ["reserved", "duplicate", "reserved"] and got[2][2:] == ("k", 1)


def test_release_confirm_and_alias_take_over(spark):
    got = told(spark, [
        (1, 0, [("a", "k", [], 600)], "failed", 20), (2, 10, [("a", "k", [], 600)], None, None), (3, 30, [("a", "k", [], 600)], "sent", 50),
        (4, 40, [("a", "new", ["k"], 600)], "sent", None), (5, 60, [("a", "new2", ["k"], 600)], "sent", None), (6, 70, [("a", "new2", [], 600)], "sent", None), (7, 80, [("a", "new", [], 600)], "sent", None),
    ])
    # 2 meets the reservation that 1 loses later; 4 meets one that is not confirmed yet, so its key stays free for 7.
    assert [got[i][0] for i in range(1, 8)] == ["failed", "duplicate", "reserved", "duplicate", "duplicate", "duplicate", "reserved"]
    assert got[6][2:] == ("new2", 3)


def test_sets_are_duplicates_only_as_a_whole(spark):
    got = told(spark, [(1, 0, [("a", "x", [], 60)], "sent", None), (2, 5, [("a", "x", [], 60), ("a", "y", [], 60)], "sent", None), (3, 6, [("b", "y", [], 60), ("b", "x", [], 60)], "sent", None)])
    assert got == {1: ("reserved", ("x",), None, None), 2: ("reserved", ("y",), "x", 1), 3: ("duplicate", (), "y", 2)}


def test_look_back_is_clamped_and_rows_without_hits_go(spark):
    df = spark.createDataFrame([(None, None), (0, None), (10**9, None), (None, 0), (None, 3), (None, 400), (None, -2)], "m long, d long")
    assert [r[0] for r in df.select(reservations.look_back_minutes(F.col("m"), F.col("d"))).collect()] == [14 * 1440, 1, 129600, 14 * 1440, 3 * 1440, 129600, 1440]
    assert told(spark, [(1, 0, [("", "x", [], 60)], "sent", None), (2, 0, [], "sent", None)]) == {}
    assert reservations.reserve_sets(spark.createDataFrame([], ITEMS), "t", "i", "hits").count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (200, 201)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
