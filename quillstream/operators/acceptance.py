"""Order-dependent acceptance: a title is dropped only if it is like an accepted earlier one.

Accepted titles are the lexicographically first maximal independent set of the graph of like titles. Equal titles
are one node, that of their first item; like pairs are found by the rarest piece of the shorter title, which is the longer the longer that title is, so
not all pairs are tried; and rounds over the pairs accept every title without an undecided earlier one and drop
those that an accepted one reaches, until all are decided.

Titles are alike if one contains the other, white space and case aside. A ledger tells which items a run has seen
before, which of them are tried again, and what other sources told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.session import checkpointed

#: Characters of the smallest pieces that titles are found by; shorter titles are found whole.
PIECE = 4
#: Hours after which a retry of a detail is given up, and how many last titles of linked sources are compared.
RETRY_HOURS, RECENT = 24, 80


def plain_title(title: Column) -> Column:
    """A title without white space, in lower case, the full-width A as A."""
    return F.lower(F.regexp_replace(F.replace(T.text_of(title), F.lit("Ａ"), F.lit("A")), r"(?U)\s+", ""))


_ODD = np.uint64(0x9E3779B97F4A7C15)
ANCHORS = "`id` bigint, `size` int, `n` int, `p` bigint"
#: Characters of titles that are hashed together at most, besides one title that goes beyond them.
PART_CHARS = 1 << 18
#: Bits of the filter of sought anchors: for each of them, and at most (16 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 27


def _mixed(hashed: np.ndarray) -> np.ndarray:
    return (hashed ^ (hashed >> np.uint64(29))) * _ODD


def _found(rows: np.ndarray, hashed: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of valid places; a hash that a row repeats in the next place once."""
    rows, hashed = rows[: len(valid)][valid], hashed[valid]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])
    return rows[new], hashed[new]


def _sized(titles: list[str], sizes: set[int] | None, own: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, hashes) of titles laid end to end: all pieces of the sizes 1 to 4, and anchors of the sizes from 8 on; ``own`` has those alone that a title is sought by."""
    lengths = np.array([len(x) for x in titles], np.int64)
    hashed = _mixed(np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.uint64) * _ODD)
    rows = np.repeat(np.arange(len(titles)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(rows))  # characters from a place to its title's end
    asked = lambda size: sizes is None or size in sizes
    short = np.where(lengths < 2 * PIECE, np.minimum(lengths, PIECE), 0)
    single, half = hashed, 1  # hashes of pieces of one and of half characters; two of these make the next
    while len(rows):
        if half <= PIECE:
            for size, made in ((half, hashed), *([(3, _mixed(hashed[:-2] * _ODD + single[2:]))] if half == 2 and len(rows) > 2 else [])):
                if asked(size):
                    valid = left[: len(made)] >= size
                    yield size, *_found(rows, made, valid & (short[rows[: len(made)]] == size) if own else valid)
        if half >= PIECE:
            # Titles under the size are done with.
            kept = lengths[rows] >= 2 * half
            if not kept.all():
                hashed, rows, left = hashed[kept], rows[kept], left[kept]
            if asked(2 * half) and len(rows):
                least, span = hashed, 1
                while span < half:
                    least, span = np.minimum(least[:-span], least[span:]), 2 * span
                least = np.minimum(least[:-1], least[1:])
                valid = left[: len(least)] >= 2 * half
                yield 2 * half, *_found(rows, least, valid & (lengths[rows[: len(least)]] < 4 * half) if own else valid)
        if len(rows) <= half:
            break
        # Places at the end of the last title are not valid for pieces of that length.
        hashed = np.append(_mixed(hashed[:-half] * _ODD + hashed[half:]), hashed[-half:])
        half *= 2


def _anchors(batches: Iterator[pa.RecordBatch], sizes: set[int] | None = None, own: bool = False, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(id, size, n, p) of titles (id, title, group's hash): the pieces of the least hash in each window of a size, for every size up to a title's length.

    Of the size s, pieces have s / 2 characters and windows s / 2 + 1 pieces, so a window is s characters. A title that
    has a part of s characters or more has all windows of that part, and so all its anchors of that size. Sizes under 8 are those of
    pieces, of which all are given. ``p`` tells the group, the size and the piece; ``wanted`` is a filter of it that lets too much through.
    """
    for batch in batches:
        # Some titles at a time, and few long ones.
        ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(np.arange(len(ends)) // 256 + ends // PART_CHARS)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(at, end - at)
            ids, titles = part.column(0).to_numpy(), part.column(1).to_pylist()
            groups = part.column(2).to_numpy().astype(np.int64).view(np.uint64) * _ODD if part.num_columns > 2 else np.zeros(len(ids), np.uint64)
            lengths = np.array([len(x) for x in titles], np.int32)
            told = []
            for size, rows, hashed in _sized(titles, sizes, own):
                p = _mixed(_mixed(hashed + groups[rows]) + np.uint64(size))
                if wanted is not None:
                    place = p >> np.uint64(65 - len(wanted).bit_length() - 3)
                    there = (wanted[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    rows, p = rows[there], p[there]
                order = np.lexsort((p, rows))
                rows, p = _found(rows[order], p[order], np.ones(len(p), bool))
                told.append((ids[rows], np.full(len(rows), size, np.int32), lengths[rows], p.view(np.int64)))
            columns = [np.concatenate(c) for c in zip(*told, strict=True)] or [np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "size", "n", "p"])


def _filter(sought: DataFrame) -> tuple[set[int], np.ndarray]:
    """The sizes of sought anchors, and bits that are set for their ``p``: some bits for each, ``MOST_BITS`` at most, so that a full one only lets more through."""
    counts = {r["size"]: r["count"] for r in sought.groupBy("size").count().collect()}  # one row for each power of two
    bits = min(MOST_BITS, max(1 << 15, 1 << (FILTER_BITS * sum(counts.values())).bit_length()))
    place = F.shiftrightunsigned("p", 65 - bits.bit_length()) + 1
    made = np.zeros(bits // 8, np.uint8)
    parts = sought.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    for r in parts.collect():
        made[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return set(counts), made


def containing_pairs(titles: DataFrame, group: str, title: str) -> DataFrame:
    """(group, part, whole) of the distinct titles of a group of which one is a proper part of the other.

    A title under 8 characters is sought by its rarest piece of up to 4 among all pieces of that size; a longer one by its rarest anchor of the
    largest size that it has. Titles travel as numbers, and are compared as texts where pieces meet.
    """
    rows = checkpointed(titles.select(F.col(group).alias("g"), F.col(title).alias("x")).where("x <> ''").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = _id_pairs(rows)
    of = lambda c, name: rows.select(F.col("id").alias(c), F.col("g").alias(f"_{c}"), F.col("x").alias(name))
    return found.join(of("a", "part"), "a").join(of("b", "whole"), "b").select(F.col("_a").alias(group), "part", "whole")


def _id_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): ids of the rows (id, g, x), whose titles are distinct in a group, of which a's title is a proper part of b's."""
    keyed = rows.select("id", "x", F.xxhash64("g").alias("h"))
    # A title under 8 characters is sought by a piece of up to 4, one of s <= n < 2 s by an anchor of the size s; only what is sought of anything travels.
    sought = checkpointed(keyed.mapInArrow(lambda batches: _anchors(batches, own=True), ANCHORS))
    sizes, bits = _filter(sought)
    wanted = rows.sparkSession.sparkContext.broadcast(bits)
    held = checkpointed(keyed.mapInArrow(lambda batches: _anchors(batches, sizes, wanted=wanted.value), ANCHORS).select("id", "n", "p"))
    rarity = held.groupBy("p").agg(F.count("*").alias("df")).where("df > 1")
    # Where one of a title's anchors is its own alone, no other title has the whole.
    common = sought.join(rarity, "p", "left").groupBy("id").agg(F.first("n").alias("n"), F.min(F.coalesce("df", F.lit(1))).alias("df"), F.min_by("p", F.struct("df", "p")).alias("p")).where("df > 1")
    met = common.select("p", F.col("id").alias("a"), F.col("n").alias("n1")).join(held.select("p", F.col("id").alias("b"), F.col("n").alias("n2")), "p").where("n2 > n1").select("a", "b").distinct()
    of = lambda c, k: rows.select(F.col("id").alias(c), F.col("g").alias(f"g{k}"), F.col("x").alias(f"x{k}"))
    return met.join(of("a", 1), "a").join(of("b", 2), "b").where((F.col("g1") == F.col("g2")) & F.col("x2").contains(F.col("x1"))).select("a", "b")


def first_independent(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """(node, accepted) of ``nodes`` (node): the first maximal independent set by links (earlier, later).

    A node is dropped if a link leads to it from an accepted one. Rounds go on until no link is left; each decides at
    least the earliest undecided node of every component. Links must lead from earlier to later nodes.
    """
    links = checkpointed(links.select("earlier", "later").distinct())
    dropped = None
    while not links.isEmpty():
        heads = links.select(F.col("earlier").alias(node)).join(links.select(F.col("later").alias(node)), node, "left_anti").distinct()
        gone = checkpointed(links.join(heads, F.col("earlier") == F.col(node), "left_semi").select(F.col("later").alias(node)).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        # What starts at a head or a dropped node decides nothing more, and links to dropped nodes are told.
        left = links.join(heads, F.col("earlier") == F.col(node), "left_anti")
        for end in ("earlier", "later"):
            left = left.join(gone, F.col(end) == F.col(node), "left_anti")
        links = checkpointed(left)
    if dropped is None:
        return nodes.select(node, F.lit(True).alias("accepted"))
    return nodes.select(node).join(dropped.distinct().withColumn("_gone", F.lit(True)), node, "left").select(node, F.col("_gone").isNull().alias("accepted"))


def accepted_titles(items: DataFrame, group: str, item: str, title: str, order: str) -> DataFrame:
    """(group, item, accepted): items of a group in ``order``, then by id; an item is dropped if an accepted earlier one is alike.

    Empty titles are like nothing and are accepted. A null order goes first; a null group is a group.
    """
    rows = items.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(group).alias("_group"), F.col(item).alias("_item"), plain_title(F.col(title)).alias("x"), F.col(order).alias("_order"))
    place = F.struct(F.col("_order").isNotNull(), "_order", F.col("_item").cast("string"))
    rows = rows.withColumn("place", place)
    first = checkpointed(rows.where("x <> ''").groupBy("g", "x").agg(F.min("place").alias("place")).withColumn("id", F.monotonically_increasing_id()))
    pairs = _id_pairs(first.select("id", "g", "x"))
    # Links are of numbers; which end is earlier is told by the places.
    of = lambda c: first.select(F.col("id").alias(c), F.struct("place", "x").alias(f"_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    ahead = F.col("_a") < F.col("_b")
    links = both.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("later"))
    told = first_independent(first.select(F.col("id").alias("node")), links)
    told = first.join(told, F.col("id") == F.col("node")).select("g", F.sha2("x", 256).alias("_x"), F.col("place").alias("head"), "accepted")
    out = rows.select("*", F.sha2("x", 256).alias("_x")).join(told, ["g", "_x"], "left")
    mine = F.when(F.col("x") == "", True).otherwise(F.col("accepted") & (F.col("place") == F.col("head")))
    return out.select(F.col("_group").alias(group), F.col("_item").alias(item), mine.alias("accepted"))


def run_decisions(items: DataFrame, ledger: DataFrame, now: Column, linked: tuple[str, ...] = (), notify_baseline: bool = False) -> DataFrame:
    """(source, item_id, decision) of a run's items against the ledger, an id once for each source.

    ``items`` have (source, item_id, title, url, published_at); ``ledger`` has (source, item_id, title, url, first_seen_at, collection_class,
    processability_status, admission_status, processing_status). Decisions: ``empty`` (neither title nor URL), ``retry`` and ``expired`` of live
    items that are not done, ``known``, ``baseline`` (the source's first run; not told, as titles are not compared then), ``similar`` to an accepted earlier title of the run, ``duplicate``
    of a linked source's item by URL, title or one of its last 80 titles, and ``new``. Of repeated ids the first by time, then by title, counts.
    """
    first = Window.partitionBy("source", "item_id").orderBy(F.col("published_at").asc_nulls_first(), "title", "url")
    rows = items.select("source", "item_id", F.trim(T.text_of(F.col("title"))).alias("title"), F.trim(T.text_of(F.col("url"))).alias("url"), "published_at").where("source IS NOT NULL AND item_id IS NOT NULL")
    rows = rows.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").drop("_turn")
    waits = lambda c: F.col(c).isin("pending", "failed_retryable")
    open_ = (F.col("collection_class") == "live") & (waits("processability_status") | (F.col("admission_status") == "pending") | waits("processing_status"))
    old = waits("processability_status") & (now.cast("timestamp") - F.make_dt_interval(hours=F.lit(RETRY_HOURS)) > F.col("first_seen_at").cast("timestamp"))
    seen = ledger.select("source", "item_id", F.coalesce(F.when(open_ & old, "expired").when(open_, "retry"), F.lit("known")).alias("_seen")).groupBy("source", "item_id").agg(F.min("_seen").alias("_seen"))
    told = ledger.select("source").distinct().withColumn("_told", F.lit(True))
    rows = checkpointed(rows.join(seen, ["source", "item_id"], "left").join(told, "source", "left"))
    begins = F.when((F.col("title") == "") & (F.col("url") == ""), "empty").when(F.col("_seen").isNotNull(), F.col("_seen")).when(F.col("_told").isNull(), "new" if notify_baseline else "baseline")
    rows = rows.withColumn("decision", begins)
    fresh = rows.where("decision IS NULL")
    if linked:
        others = ledger.where(F.col("source").isin(*linked))
        mine = fresh.where(F.col("source").isin(*linked)).select("source", "item_id", "title", "url")
        by = lambda c: mine.join(others.select(F.trim(T.text_of(F.col(c))).alias(c)).where(f"{c} <> ''").distinct(), c, "left_semi")
        last = others.orderBy(F.col("first_seen_at").desc(), "source", "item_id").limit(RECENT).select(plain_title(F.col("title")).alias("y")).where("y <> ''").distinct()
        x = plain_title(F.col("title"))
        like = mine.withColumn("x", x).where("x <> ''").join(F.broadcast(last), F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x")), "left_semi")  # 80 rows at most
        double = by("url").unionByName(by("title").select("source", "item_id", "title", "url")).unionByName(like.drop("x")).select("source", "item_id").distinct().withColumn("_double", F.lit(True))
    else:
        double = fresh.select("source", "item_id").where("false").withColumn("_double", F.lit(True))
    fresh = checkpointed(fresh.join(double, ["source", "item_id"], "left"))
    # A duplicate is not accepted, so it drops no title after it.
    kept = accepted_titles(fresh.where("_double IS NULL"), "source", "item_id", "title", "published_at")
    judged = fresh.join(kept, ["source", "item_id"], "left").select("source", "item_id", F.when(F.col("_double"), "duplicate").when(F.col("accepted"), "new").otherwise("similar").alias("decision"))
    return rows.where("decision IS NOT NULL").select("source", "item_id", "decision").unionByName(judged)
