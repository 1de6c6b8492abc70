"""Line de-duplication by overlapping windows of three consecutive lines, in DataFrame functions only.

Every window is hashed to 128 bits. One aggregation finds the windows that occur again and where each
occurs first (smallest document id, then smallest position); it keeps a row a window and task, so a
window that every document holds costs no more than another. The later occurrences come from a join of
two exchanges that Spark can split where a window is frequent. Covered positions of a document are
merged to ranges, and what lies between the ranges stays.

Defined results: lines are what ``\\n`` separates; a window of blank lines only is no window; texts of
fewer than three lines have none and stay. A null text has no lines and stays null; an empty one stays
empty. Documents with a null id come last in order. Rows of one id and text share their fate and are
not copies of each other: they have the same positions. Extra columns stay as they are; an empty table
gives an empty table. What a text loses depends on the input only, never on other removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3
_LAST = "9223372036854775807"


def _windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, copy, pos, a, b): a row per window, ``a`` and ``b`` its hash, ``copy`` the text's."""
    lines = F.split(text_col, "\n")
    taken = lambda i: F.slice(F.col("lines"), i + 1, SIZE)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - SIZE),
        lambda i: F.when(F.exists(taken(i), lambda x: F.trim(x) != ""), F.struct(F.xxhash64(taken(i)).alias("a"), F.xxhash64(F.lit(7), taken(i)).alias("b"))),
    )
    rows = df.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("copy"), lines.alias("lines")).where(F.size("lines") >= SIZE)
    placed = rows.select("key", "copy", F.posexplode(hashed).alias("pos", "w")).where("w IS NOT NULL")
    return placed.select("key", "copy", "pos", "w.a", "w.b")


def _order(key: Column, pos: Column) -> Column:
    """One number for (document, position), so that a plain minimum finds the first occurrence."""
    return (F.coalesce(key, F.lit(int(_LAST))).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + pos).cast("decimal(38,0)")


def removed_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, copy, starts, ends): the merged covered ranges of each document that loses lines."""
    windows = _windows(df, id_col, text_col).withColumn("at", _order(F.col("key"), F.col("pos")))
    again = windows.groupBy("a", "b").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(again.select("a", "b", "first"), ["a", "b"]).where("at > first")
    starts = F.array_sort(F.collect_set("pos"))
    found = later.groupBy("key", "copy").agg(starts.alias("s"))
    before = lambda i: F.get("s", i - 1)
    after = lambda i: F.get("s", i + 1)
    return found.select(
        "key", "copy",
        F.filter("s", lambda x, i: before(i).isNull() | (x > before(i) + SIZE)).alias("starts"),
        F.transform(F.filter("s", lambda x, i: after(i).isNull() | (after(i) > x + SIZE)), lambda x: x + SIZE).alias("ends"),
    )


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text without later occurrences of windows, and ``n_lines`` and ``n_removed`` after its columns."""
    ranges = removed_ranges(df, id_col, text_col)
    # The row goes as one value, so that no name of its columns meets one of these.
    here = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_copy"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    joined = here.join(ranges, F.col("id").eqNullSafe(F.col("key")) & (F.col("text_copy") == F.col("copy")), "left")
    lines = F.split("text", "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    from_ = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    to = lambda k: F.coalesce(F.get("starts", k), F.size("lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("starts")), lambda k: F.slice(F.col("lines"), from_(k) + 1, to(k) - from_(k))))
    gone = F.aggregate(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")), F.lit(0).cast("long"), lambda t, r: t + r["e"] - r["s"])
    marked = joined.withColumn("lines", F.when(F.col("starts").isNotNull(), lines))
    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col)
    columns = [text if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c == text_col or c not in ("n_lines", "n_removed")]
    return marked.select(*columns, n_lines.alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))
