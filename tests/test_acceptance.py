import datetime as dt
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.operators import acceptance as A

T0 = dt.datetime(2024, 1, 1)


def norm(t):
    return re.sub(r"\s+", "", (t or "").replace("Ａ", "A")).lower()


def sequential(rows):
    """{item: accepted} of (group, item, title, order), one after the other."""
    out, seen = {}, {}
    for g, i, t, o in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, str(r[1]))):
        x = norm(t)
        prior = seen.setdefault(g, [])
        like = x and any(x in p or p in x for p in prior)
        out[i] = not like
        if x and not like:
            prior.append(x)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_accepted_titles_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab漢 Ａ") for _ in range(rng.randint(0, 9)))
    rows = [(rng.choice(["s", "t", None]), i, rng.choice([word(), word() + word(), None if i % 17 == 0 else word() * 2]), rng.choice([None, *range(30)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, t string, o long")
    got = A.accepted_titles(df, "g", "i", "t", "o").collect()
    assert len(got) == len(rows) and {r.i: r.accepted for r in got} == sequential(rows)


def test_parts_of_long_titles_and_few_pieces(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh漢") for _ in range(n))
    xs = []
    for n in (3, 7, 8, 9, 15, 16, 17, 40, 64, 65, 300):
        x = word(n)
        xs += [x, word(5) + x, x + word(3), word(1) + x + word(30), x[1:]]
    got = {(r.part, r.whole) for r in A.containing_pairs(spark.createDataFrame([("g", x) for x in xs], "g string, t string"), "g", "t").collect()}
    assert got == {(x, y) for x in xs for y in xs if x != y and x in y}
    # A title's anchors are about as many as its characters, of any size; 2,000 characters had 8,000 pieces with the title beside each.
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([word(2000)])], names=["id", "x"])
    assert sum(b.num_rows for b in A._anchors(iter([batch]))) < 2 * 2000


def test_short_titles_in_a_very_long_one(spark):
    """Pieces of a title cost its length; they were cut out one by one from the title's start, which cost its square: minutes for 150,000 characters."""
    rng = random.Random(17)
    long = "".join(rng.choice("abcdefgh漢") for _ in range(150_000))
    xs = [long, "b", "h漢", "abz", long[9:12], long[70_000:70_004], long[140_000:140_007], long[99:108], long[-21:], "z" + long[50:60], long[1:], "z"]
    began = time.monotonic()
    got = {(r.part, r.whole) for r in A.containing_pairs(spark.createDataFrame([("g", x) for x in xs], "g string, t string"), "g", "t").collect()}
    assert got == {(x, y) for x in xs for y in xs if x != y and x in y}
    assert time.monotonic() - began < 60


def test_only_sought_anchors_are_told(spark):
    """A long title without a part among the titles tells what it is sought by itself and next to nothing else; all its anchors, as many as its characters, were told before."""
    rng = random.Random(19)
    xs = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (9, 20, 50, 3000)]
    rows = spark.createDataFrame(list(enumerate(xs)), "id long, x string").withColumn("h", F.lit(1).cast("long"))
    sought = rows.mapInArrow(lambda batches: A._anchors(batches, own=True), A.ANCHORS)
    sizes, bits = A._filter(sought)
    assert sizes == {8, 16, 32, 2048}
    held = rows.mapInArrow(lambda batches: A._anchors(batches, sizes, wanted=bits), A.ANCHORS).collect()
    own = {tuple(r) for r in sought.collect()}
    assert own <= {tuple(r) for r in held} and len(held) < len(own) + 30
    assert rows.mapInArrow(lambda batches: A._anchors(batches), A.ANCHORS).count() > 1500


def test_titles_are_hashed_a_few_long_ones_at_a_time(monkeypatch):
    rng = random.Random(23)
    xs = ["".join(rng.choice("abcd") for _ in range(rng.choice((1, 3, 9, 400)))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(xs)], names=["id", "x"])
    told = lambda: [r for b in A._anchors(iter([batch])) for r in b.to_pylist()]
    once, seen, sized = told(), [], A._sized
    monkeypatch.setattr(A, "PART_CHARS", 1000)
    monkeypatch.setattr(A, "_sized", lambda titles, *a: seen.append(sum(map(len, titles))) or sized(titles, *a))
    key = lambda r: tuple(r.values())
    assert sorted(map(key, told())) == sorted(map(key, once)) and max(seen) < 1000 + 400 and sum(seen) == sum(map(len, xs))
    assert list(A._anchors(iter([batch.slice(0, 0)]))) == []


def test_chains_alternate_and_no_rows(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(20, 22), (21, 22), (22, 23)], "earlier long, later long")
    nodes = spark.createDataFrame([(k,) for k in [*range(13), 20, 21, 22, 23, 99]], "node long")
    got = {r.node: r.accepted for r in A.first_independent(nodes, links).collect()}
    assert got == {**{k: k % 2 == 0 for k in range(13)}, 20: True, 21: True, 22: False, 23: True, 99: True}
    assert A.first_independent(nodes.limit(0), links.limit(0)).count() == 0
    none = spark.createDataFrame([], "g string, i long, t string, o long")
    assert A.accepted_titles(none, "g", "i", "t", "o").count() == 0


LEDGER = "source string, item_id string, title string, url string, first_seen_at timestamp, collection_class string, processability_status string, admission_status string, processing_status string"


def test_decisions_of_a_run(spark):
    hours = lambda h: T0 + dt.timedelta(hours=h)
    ledger = [
        ("a", "1", "old news", "u/1", hours(-3), "live", "ready", "admitted", "done"), ("a", "2", "wait", "u/2", hours(-3), "live", "failed_retryable", "", ""),
        ("a", "3", "late", "u/3", hours(-30), "live", "pending", "", ""), ("a", "4", "late too", "u/4", hours(-30), "live", "ready", "pending", ""), ("a", "5", "base", "u/5", hours(-3), "baseline", "pending", "", ""),
        ("l1", "x", "Shared title", "u/s", hours(-1), "live", "ready", "admitted", "done"),
    ]
    items = [("a", str(k), "t", "u", T0) for k in range(1, 6)] + [
        ("a", "6", " ", None, T0), ("a", "7", "Fresh story", "u/7", hours(1)), ("a", "8", "fresh STORY, more of it", "u/8", hours(2)), ("a", "9", "fresh", "u/9", hours(0)), ("a", "7", "repeated", "u", hours(3)),
        ("b", "1", "anything", "u", T0), ("b", "2", "anything", "u", T0), ("l1", "2", "other", "u/s", hours(1)), ("l1", "3", "SHARED  title again", "u/n", hours(1)), ("l1", "4", "really new", "u/m", hours(1)), ("a", "10", "", "u/only", hours(5)), (None, "1", "t", "u", T0),
    ]
    df, past = spark.createDataFrame(items, "source string, item_id string, title string, url string, published_at timestamp"), spark.createDataFrame(ledger, LEDGER)
    got = {(r.source, r.item_id): r.decision for r in A.run_decisions(df, past, F.lit(T0), ("l1", "l2")).collect()}
    assert got == {
        ("a", "1"): "known", ("a", "2"): "retry", ("a", "3"): "expired", ("a", "4"): "retry", ("a", "5"): "known", ("a", "6"): "empty", ("a", "9"): "new", ("a", "7"): "similar", ("a", "8"): "similar", ("a", "10"): "new",
        ("b", "1"): "baseline", ("b", "2"): "baseline", ("l1", "2"): "duplicate", ("l1", "3"): "duplicate", ("l1", "4"): "new",
    }
    assert {r.decision for r in A.run_decisions(df.where("source = 'b'"), past, F.lit(T0), notify_baseline=True).collect()} == {"new"}
