"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index is built for the test terms: a first pass counts them in the corpus, and each window of an
item is then sought by its rarest term. A second pass makes the postings of those terms. A posting is
intersected with the list of the window's next rarest term, at the difference of their offsets, before
anything is stored, so lists of frequent terms are never written. For what is left the exact phrase
is measured to both sides of the posting, and the stored rows are alignments of an item with a text.

Both passes look test terms up in a broadcast table if there are at most ``BROADCAST_TERMS`` of them
(which is counted), and in a shuffled join beyond. An anchor carries the words of its item beside it, at
most ``2 * window - 1``; postings that are shuffled or stored carry as many of their text, never all words.
Stored are the postings of the rarest terms that meet the next rarest one at its offset; ``postings`` and
``proximity`` are the index of all given terms, for searches that come back to it.

Defined results: null texts and texts without words have no words and no hits; an item of fewer than
ten words is one window, one without words is none; rows of one id and text get equal results; an
empty table on either side gives no hits; extra columns are ignored; null item ids count as no item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.shared import written

WINDOW = 10
BROADCAST_TERMS = 200_000
#: Separators if letters A-Z are read as a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in their own case; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def plain(word: Column) -> Column:
    """A word with A-Z in lower case."""
    return F.translate(word, _UPPER, _LOWER)


def _beside(words_col: str, place: str, window: int) -> Column:
    """The words around a place, which is then at ``window - 1``; null where the text has none."""
    return F.transform(F.sequence(F.lit(1 - window), F.lit(window - 1)), lambda k: F.get(words_col, F.col(place) + k))


def _maybe_broadcast(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_TERMS else df


def tokens(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, copy, w, pos, term): a row per word; ``term`` is in lower case, ``w`` all words of the text."""
    rows = documents.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("copy"), words(F.col(text_col)).alias("w"))
    return rows.select("key", "copy", "w", F.posexplode("w").alias("pos", "word")).select("key", "copy", "w", "pos", F.lower("word").alias("term"))


def anchors(documents: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int = WINDOW) -> tuple[DataFrame, int]:
    """(term, item, iw, j, size, other, shift) and an upper bound of its rows.

    A row per item position ``j`` that is the rarest of some window, with the words of the item, the next
    rarest term of one such window and its offset from ``j``. Windows with a term that the corpus lacks are left out.
    """
    listed = items.select(F.col(item_col).alias("item"), F.xxhash64(item_text_col).alias("version"), F.transform(words(F.col(item_text_col)), plain).alias("iw")).where(F.size("iw") > 0).distinct()
    placed = listed.select("item", "version", "iw", F.size("iw").alias("n_iw"), F.posexplode("iw").alias("j", "word"))
    placed = placed.select("item", "version", _beside("iw", "j", window).alias("iw"), "n_iw", "j", F.lower("word").alias("term"))
    placed = written(placed, "test-terms")
    vocabulary = placed.select("term").distinct()
    n_terms = placed.count()
    counts = tokens(documents, id_col, text_col).select("term").join(_maybe_broadcast(vocabulary, n_terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    counts = written(counts, "test-term-counts")
    known = placed.join(_maybe_broadcast(counts, n_terms), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.least(F.col("n_iw"), F.lit(window))
    begins = F.explode(F.sequence(F.greatest(F.col("j") - size + 1, F.lit(0)), F.least(F.col("j"), F.col("n_iw") - size))).alias("s")
    spread = known.select("item", "version", "iw", "n_iw", "j", "term", "n", begins)
    order = Window.partitionBy("item", "version", "s").orderBy("n", "j")
    ranked = spread.withColumn("r", F.row_number().over(order)).where("r <= 2")
    each = ranked.groupBy("item", "version", "s").agg(
        F.min("n").alias("least"), F.first("n_iw").alias("n_iw"), F.max(F.when(F.col("r") == 1, F.col("iw"))).alias("iw"),
        F.max(F.when(F.col("r") == 1, F.col("j"))).alias("j"), F.max(F.when(F.col("r") == 1, F.col("term"))).alias("term"),
        F.max(F.when(F.col("r") == 2, F.col("j"))).alias("j2"), F.max(F.when(F.col("r") == 2, F.col("term"))).alias("other"),
    ).where("least > 0")
    wanted = each.select("term", "item", "iw", "j", F.least(F.col("n_iw"), F.lit(window)).alias("size"), "other", (F.col("j2") - F.col("j")).alias("shift")).distinct()
    return written(wanted, "anchors"), n_terms * window


def alignments(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Stored rows (key, copy, item, begin, end): word ranges of texts, each made of whole windows of the item."""
    wanted, bound = anchors(documents, items, id_col, text_col, item_col, item_text_col, window)
    held = tokens(documents, id_col, text_col)
    if bound > BROADCAST_TERMS:  # these rows are shuffled
        held = held.withColumn("w", _beside("w", "pos", window)).withColumn("at", F.lit(window - 1))
    else:
        held = held.withColumn("at", F.col("pos"))
    next_to = F.lower(F.get("w", F.col("at") + F.col("shift")))
    met = held.join(_maybe_broadcast(wanted, bound), "term").where(F.col("other").isNull() | (next_to == F.col("other")))
    # The postings that met, with the words beside them, are stored: what measures them would make the code of the pass
    # over all words too long to be compiled.
    met = written(met.select("key", "copy", "item", "pos", "size", "iw", _beside("w", "at", window).alias("w")), "postings")

    def run(sign: int) -> Column:
        """Equal words beside the posting, on one side."""
        same = [F.coalesce(plain(F.get("w", F.lit(window - 1 + sign * k))) == F.get("iw", F.lit(window - 1 + sign * k)), F.lit(False)) for k in range(1, window)]
        first_other = F.array_position(F.array(*same), False)
        return F.when(first_other == 0, window - 1).otherwise(first_other - 1).cast("int")

    here = plain(F.get("w", F.lit(window - 1))) == F.get("iw", F.lit(window - 1))
    measured = met.where(here).select("key", "copy", "item", "pos", "size", run(-1).alias("left"), run(1).alias("right"))
    exact = measured.where(F.col("left") + F.col("right") + 1 >= F.col("size"))
    return written(exact.select("key", "copy", "item", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.col("right") + 1).alias("end")), "alignments")


def contamination(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: (id, copy, n_words, n_hit, items): words, hit words and the items that occur, as sorted texts."""
    found = alignments(documents, items, id_col, text_col, item_col, item_text_col, window)
    order = Window.partitionBy("key", "copy").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("begin"), F.coalesce(reached, F.col("begin"))), F.lit(0))
    hits = found.distinct().withColumn("new", new).groupBy("key", "copy").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hits = hits.select(F.col("key").alias("_key"), F.col("copy").alias("_copy"), "n_hit", "items")
    rows = documents.select(F.col(id_col), F.xxhash64(text_col).alias("copy"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    joined = rows.join(hits, rows[id_col].eqNullSafe(hits["_key"]) & (rows["copy"] == hits["_copy"]), "left")
    return joined.select(id_col, "copy", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def postings(documents: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, key, copy, pos) of the given ``terms`` (column ``term``)."""
    wanted = terms.select(F.lower("term").alias("term")).distinct()
    return tokens(documents, id_col, text_col).join(_maybe_broadcast(wanted, wanted.count()), "term").select("term", "key", "copy", "pos")


def proximity(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Matches (first, second, key, copy, pos, other_pos) of pairs of terms at most ``within`` words apart.

    ``index`` has postings, ``pairs`` the columns ``first`` and ``second``. Positions meet by blocks of ``within`` words.
    """
    block = F.floor(F.col("pos") / within)
    one = pairs.join(index, pairs["first"] == index["term"]).select("first", "second", "key", "copy", "pos", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    other = index.select(F.col("term").alias("second"), "key", "copy", F.col("pos").alias("other_pos"), block.alias("block"))
    met = one.join(other, ["second", "key", "copy", "block"])
    return met.where((F.abs(F.col("pos") - F.col("other_pos")) <= within) & (F.col("pos") != F.col("other_pos"))).select("first", "second", "key", "copy", "pos", "other_pos")
