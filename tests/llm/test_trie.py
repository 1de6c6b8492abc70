import hashlib
import random
import zlib

import pytest

from quillstream.llm import prefix_trie as P
from quillstream.llm.queries import rebuilt_conversations

TURNS = "conv_id long, turn long, role string, text string, digest string, depth int, n_convs string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(p))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_conversations_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BITS", 3)  # several blocks of ids at one node
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 140), 250, -5, -250, -200, 2**40]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bb", "é漢", None])))
    rows += [(7, None, "system", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 0, "user", "no conversation"), (300, 5, None, "x" * 50_000)]
    df = table(spark, rows)
    want = brute(rebuilt(rows))
    assert got(P.nodes(rebuilt_conversations(df), df)) == want


def test_without_ids_rows_and_turns(spark):
    assert P.nodes(table(spark, [])).count() == 0
    assert P.nodes(table(spark, [(None, 1, "user", "a")])).count() == 0
    only = spark.createDataFrame([(4,), (9,), (4,)], "conv_id long")
    none = hashlib.sha256(b"4,9").hexdigest()
    assert got(P.nodes(table(spark, []), only)) == [(4, 0, None, 2, 0, 1, 0, none)]


def test_role_and_text_are_kept_apart(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, None, "abc")]
    assert got(P.nodes(table(spark, rows))) == brute({1: [("ab", "c")], 2: [("a", "bc")], 3: [("", "abc")], 4: [("", "abc")]})


def test_long_and_equal_conversations(spark):
    same = [(c, t, "user", "same" if t % 3 else "other") for c in range(40) for t in range(30)]
    assert got(P.nodes(table(spark, same))) == brute({c: [("user", "same" if t % 3 else "other") for t in range(30)] for c in range(40)})
