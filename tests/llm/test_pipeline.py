"""The pipeline's stages on hard tables, and run() against a plain version of it."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quillstream.llm import linear_text, queries
from tests.llm.fixtures import documents, plain
from tests.llm.test_text_ops import near_brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Hard documents with the columns of ``documents``, labels, and two benchmark items, one of them planted."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = documents(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    planted = " ".join(docs.where("doc_id = 3").first().text.split()[5:17])
    spark.createDataFrame([(1, planted), (2, "never seen in any text of these"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def lines_brute(rows):
    """Without the lines of three-line windows that start earlier: by id and place."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = "\n".join(lines[k : k + 3])
            if window.replace("\n", "").strip(" ") and window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out.append((i, t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), bool(gone)))
    return [(i, t) for i, t, cut in out if not cut or (t or "").strip(" ")]


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_near_duplicates_then_decontaminate(spark, folder):
    """Stages three and four on all the hard rows, against plain versions."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = plain(docs)
    group, _ = near_brute(rows)
    want, seen = [], set()
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0)):
        if group[n] not in seen or not words_of(rows[n][1]):
            want.append(rows[n])
        seen.add(group[n])
    kept = C.near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    got = plain(kept)
    assert sorted(i or -1 for i, _ in got) == sorted(i or -1 for i, _ in want)
    bench = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in bench if w for k in range(max(1, len(w) - 9))}
    dirty = lambda t: any(tuple(words_of(t)[k : k + len(w)]) == w for w in windows for k in range(len(words_of(t)) - len(w) + 1))
    clean = plain(C.decontaminate(spark, docs, folder))
    assert sorted(map(str, clean)) == sorted(str(r) for r in rows if not dirty(r[1]))
    assert 0 < len(clean) < len(rows)


def test_run_equals_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.quality_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = linear_text.score(docs.withColumn("doc_id", F.monotonically_increasing_id()), model).collect()
    by_row = {r.doc_id: r.score for r in scored}
    numbered = docs.withColumn("_n", F.monotonically_increasing_id()).collect()
    rows = [(r.doc_id, r.text) for r in numbered if by_row[r._n] >= 0.5]
    rows = lines_brute(rows)
    group, _ = near_brute(rows)
    kept, seen = [], set()
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0)):
        if group[n] not in seen or not words_of(rows[n][1]):
            kept.append(rows[n])
        seen.add(group[n])
    bench = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in bench if w for k in range(max(1, len(w) - 9))}
    kept = [(i, t) for i, t in kept if not any(tuple(words_of(t)[k : k + len(w)]) == w for w in windows for k in range(len(words_of(t)) - len(w) + 1))]
    got = C.run(spark, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded_sha256) for r in got) == sorted((i if i is not None else -1, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept)


CLASHES = ("_here", "_copy", "_key", "_words", "_alone", "_turn", "_starts", "_lines", "key", "copy", "row", "id", "words", "starts", "text_copy", "n_windows")


@pytest.mark.parametrize("stage", [C.lines, C.near_duplicates, C.decontaminate, C.quality])
def test_stages_keep_columns_of_any_name(spark, folder, stage):
    """Extra columns, named as the stages' own or of map type, come back as they were."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES], F.create_map(F.lit("a"), F.col("doc_id")).alias("m"))
    out = stage(spark, extra, folder)
    assert out.columns == extra.columns
    rows = out.where("doc_id IS NOT NULL").collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES) and all(r.m == {"a": r.doc_id} for r in rows)
    assert sorted(map(str, plain(out))) == sorted(map(str, plain(stage(spark, docs, folder))))
