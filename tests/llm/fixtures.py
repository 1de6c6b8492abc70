"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, score double, spans string, label int, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def documents(spark, seed=5, n=60):
    """Documents with copies, near copies, shared passages and repeated lines; names of extra columns clash with results."""
    rng = random.Random(seed)
    shared = words(rng, 60)
    rows, texts = [], []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            t = "\n".join(words(rng, 12) for _ in range(rng.randint(1, 8)))
        elif kind == 1:
            t = rng.choice(texts)
        elif kind == 2:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = words(rng, 20) + "\n" + shared + "\n" + words(rng, 20)
        elif kind == 4:
            line = words(rng, 9)
            t = "\n".join([line, line, "é ü 漢字 " + line, line, line])
        else:
            t = words(rng, rng.randint(1, 4))
        texts.append(t)
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n \n"), (n + 3, "ab" * 3000), (n + 4, words(rng, 3000)), (n + 5, rows[3][1]), (n + 5, rows[3][1]), (None, rows[3][1])]
    return spark.createDataFrame([(i, t, 0.5, "s", 7, "k") for i, t in rows], DOCS)


def plain(df):
    return [(r.doc_id, r.text) for r in df.collect()]
