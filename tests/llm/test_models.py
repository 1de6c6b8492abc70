import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import clause_grammar as G
from quillstream.llm import linear_text as L
from quillstream.llm import queries as Q
from quillstream.llm.arrow_text import flat
from quillstream.llm.shared import remainder
from tests.llm.fixtures import DOCS, documents


def column(*texts):
    return pa.array(list(texts), pa.large_string())


def test_indicators_are_of_their_own_text():
    texts = ["a b a", None, "", "B b!! c", "a b a"]
    doc, f = L.indicators(*flat(column(*texts)))
    sets = [set(f[doc == i].tolist()) for i in range(5)]
    assert sets[0] == sets[4] and not sets[1] and not sets[2] and sets[3] and sets[3] != sets[0]
    alone = set(L.indicators(*flat(column("B b!! c")))[1].tolist())
    assert alone == sets[3]


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(200):
        label = i % 2
        rows.append(np.unique(rng.integers(0, 50, 10) + 50 * label))
        y.append(1.0 if label else -1.0)
    values = [np.full(len(r), 1 / np.sqrt(len(r))) for r in rows]
    w, b = L.dual_descent(rows, values, np.array(y), 100, 4.0, 30)
    assert all((w[r] @ v + b) * t > 0 for r, v, t in zip(rows, values, y, strict=True))


def test_fit_without_contrast():
    assert (L.fit([], np.zeros(0))[: L.SIZE] == 0).all()
    one = L.fit([np.array([1, 2])] * 20, np.ones(20, np.int64))
    assert one[-1] > 0 and not one[: L.SIZE].any()


def _accuracy(spark, sf_dir, name, label, modulus, held, threshold):
    got = {r.doc_id: r for r in Q.QUERIES[name](spark, sf_dir).collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(got) == sorted(docs)
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
    truth = [(got[r.doc_id], r[label]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r.doc_id].held_out]
    return truth


def test_quality_on_held_out_rows(spark):
    truth = _accuracy(spark, "/root/testdata/sf0.01", "op4_quality_classifier", "quality", 3, 1, 0.5)
    assert np.mean([r.predicted == y for r, y in truth]) >= 0.95
    assert all(r.predicted == 1 for r, y in truth if y == 1)
    assert np.mean([r.predicted == 0 for r, y in truth if y == 0]) >= 0.9  # not by the larger class alone


def test_toxicity_on_held_out_rows(spark):
    truth = _accuracy(spark, "/root/testdata/sf0.01", "op9_toxicity_grammar", "toxic", 4, 2, 0.3)
    assert np.mean([r.predicted == y for r, y in truth]) >= 0.9
    caught = [r.predicted for r, y in truth if y == 1]
    # Five of the 14 toxic rows here hold nothing but invented words and line noise.
    assert len(caught) == 14 and sum(caught) >= 9 and np.mean([y for r, y in truth if r.predicted]) >= 0.9


def test_hard_texts_are_scored(spark):
    df = documents(spark)
    model = L.fit([np.array([1])] * 10 + [np.array([2])] * 10, np.array([0] * 10 + [1] * 10))
    got = L.score(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert L.accepted(df, model, 0.0).columns == df.columns and L.accepted(df, model, 0.0).count() == df.count()
    toxic = G.score(df, G.ToxicityModel(G.Lexicon.known(), G._UNFITTED)).collect()
    assert len(toxic) == df.count()
    empty = spark.createDataFrame([], DOCS)
    assert L.score(empty, model).count() == 0 and G.score(empty, G.ToxicityModel(G.Lexicon.known(), G._UNFITTED)).count() == 0


def test_sample_is_bounded_and_learns_no_held_out_row(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(50).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, None).otherwise(F.col("id") % 3).cast("int").alias("quality"))
    got = L.labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), 3) != 1, 7).collect()
    assert len(got) == 7 and all(r.label in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)
    none = L.train(L.labelled_sample(docs, labels.where("false"), "quality", F.lit(True)))
    assert not none.any()


def clause_score(text):
    return G.text_features(column(text), G.Lexicon.known(), G.clause_grammar())[0]


@pytest.mark.parametrize("low, high", [("not an idiot", "an idiot"), ("he said idiot", "idiot"), ("what an idiot", "you idiot"), ("they kill", "hello there"), ("kill", "you kill"), ("", "idiot")])
def test_grammar_weighs_clauses(low, high):
    if high == "hello there":
        assert clause_score(low)[1] > clause_score(high)[1] == 0
    else:
        assert clause_score(low)[1] < clause_score(high)[1]


def test_clauses_do_not_reach_over_stops():
    assert clause_score("not. idiot")[0] == clause_score("idiot")[0]
    assert clause_score("idiot. idiot")[1] == clause_score("idiot")[1] and clause_score("idiot. idiot")[0] == 2 * clause_score("idiot")[0]


@pytest.mark.parametrize("name, parts", [("attitude", (G.negation_scope(), G.reported_speech())), ("aim", (G.aimed_insult(), G.threat_pattern()))])
def test_composition_is_sequential(name, parts):
    grammar = getattr(G.clause_grammar(), name)
    rng, states, state = random.Random(1), [0] * len(parts), 0
    for _ in range(500):
        symbol = rng.randrange(6)
        state, written, factor = grammar.step[state][symbol]
        want = 1.0
        for k, part in enumerate(parts):
            states[k], symbol, x = part.step[states[k]][symbol]
            want *= x
        assert written == symbol and factor == pytest.approx(want)


def _clause_score(text):
    return float(G.text_features(column(text), G.Lexicon.known(), G.clause_grammar())[0, 0])


def test_threats_and_targets_in_both_orders():
    bare = _clause_score("kill")
    assert _clause_score("i will kill you") == _clause_score("you i will kill") == 3 * bare
    assert _clause_score("kill. you") == bare
    assert _clause_score("you are an idiot") == _clause_score("what an idiot you are") > _clause_score("what an idiot")


def test_reports_at_the_end_of_a_clause():
    whole = clause_score("you are an idiot")[0]
    for reported in ("you are an idiot, he said", "you are an idiot said she", "he said you are an idiot"):
        assert clause_score(reported)[0] < 0.5 * whole, reported
    for own in ("you are an idiot, he laughed", "an idiot said so to you"):  # nobody is quoted, or the idiot speaks
        assert clause_score(own)[0] > 0.6 * whole, own
    assert G.closing_report().step[0][G.REPORT][0] == 1


def test_negations_and_reports():
    plain_score = _clause_score("be an idiot")
    for text in ("don't be an idiot", "don\u2019t be an idiot", "n'est idiot", "not an idiot"):
        assert 0 < _clause_score(text) < plain_score
    assert 0 < _clause_score("the critic called it idiot") < plain_score
    assert _clause_score("DÉBILE") == _clause_score("débile") > 0


def test_sample_is_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(1, f"other {k}") for k in range(50)] + [(2, "x" * 300), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert L.labelled_sample(docs, labels, "quality", F.lit(True), 7).count() <= 7
    rows = L.labelled_sample(docs, labels, "quality", F.lit(True), 1000, 200).collect()
    assert sorted(r.doc_id for r in rows) == [1, 3]  # one text an id, none that is too long
    assert L.labelled_sample(docs, labels, "quality", F.lit(True), 2, 200).count() == 2  # long texts do not use the limit up
    both = spark.createDataFrame([(1, 0), (1, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.label for r in L.labelled_sample(docs, both, "quality", F.lit(True)).collect()} == {1: 1, 3: 0}


def test_dual_descent_equals_a_dense_solver():
    rng = np.random.default_rng(4)
    x = (rng.random((24, 9)) < 0.5) * rng.normal(size=(24, 9))
    y = np.where(rng.random(24) < 0.5, 1.0, -1.0)
    rows = [np.flatnonzero(r) for r in x]
    w, b = L.dual_descent(rows, [r[f] for r, f in zip(x, rows, strict=True)], y, 9, 0.7, 4000)
    wide = np.column_stack([x, np.ones(24)])  # the intercept as one more feature
    q = (y[:, None] * wide) @ (y[:, None] * wide).T
    a = np.zeros(24)
    for _ in range(200_000):  # projected gradient ascent on the dense dual
        a = np.clip(a + (1 - q @ a) / (np.abs(q).sum(1).max()), 0, 0.7)
    dense = (a * y) @ wide
    assert np.allclose([*w, b], dense, atol=1e-2)  # it stops at a step of a thousandth


def test_fit_and_score_equal_a_dense_version(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'good' if k % 2 else 'bad'}{rng.integers(6)} w{rng.integers(9)}" for _ in range(rng.integers(1, 8))) for k in range(40)] + ["", "odd words only"]
    labels = np.array([k % 2 for k in range(40)] + [0, 1])
    dense = np.zeros((len(texts), L.SIZE), bool)
    for k, t in enumerate(texts):
        dense[k, L.indicators(*L.flat(pa.array([t])))[1]] = True
    ratio = np.log((1.0 + dense[labels == 1].sum(0)) / (1.0 + dense[labels == 1].sum(0)).sum()) - np.log((1.0 + dense[labels == 0].sum(0)) / (1.0 + dense[labels == 0].sum(0)).sum())
    scaled = dense * ratio / np.sqrt(np.maximum(dense.sum(1), 1))[:, None]
    model = L.fit([np.flatnonzero(r) for r in dense], labels)
    used = np.abs(ratio) > 1e-9
    weights = np.where(used, model[: L.SIZE] / np.where(used, ratio, 1), 0)
    b, slope, intercept = (float(v) for v in model[L.SIZE :])
    want = 1 / (1 + np.exp(-(slope * (scaled @ weights + b) + intercept)))
    got = {r.doc_id: r.score for r in L.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-4)
    fitted = np.arange(len(texts)) % 5 != 4
    plain, b2 = L.dual_descent([np.arange(L.SIZE)[r] for r in dense[fitted]], [v[r] for v, r in zip(scaled[fitted], dense[fitted], strict=True)], np.where(labels[fitted] > 0, 1.0, -1.0), L.SIZE, 4.0, 25)
    assert np.allclose(weights[used], plain[used], atol=1e-3) and abs(b - b2) < 1e-3
