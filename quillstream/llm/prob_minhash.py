"""Near-duplicates by ProbMinHash of weighted word shingles, banding and exact verification.

A shingle of five words with its count as weight sends arrivals, a Poisson process of that rate, to
random registers; each register keeps the shingle that arrives first, and arrivals later than the
last register's first one are never made. Two texts agree in a register with the probability of their
probability Jaccard similarity. Registers are banded; texts that share a band are candidates.

Equal texts, as multisets of shingles, are one node from the start. In a band each node is verified
with the band's smallest node; where that does not join all, with the node of the band that most such heads
are linked to, a central one, which joins most copies. Nodes of a band that are still in different components get ``FINE`` registers, whose agreement estimates the similarity, and meet in blocks of about
``BLOCK`` nodes; only pairs whose estimate is within three standard deviations of the threshold, or above,
are made at all and verified, each in the first band that it shares. So a group of near copies gives a
row for each block pair and for each likely link between components, never one for each pair. Classes
are the connected components of the verified links.

What can be missed: a link whose texts share no band (at a similarity of 0.8 about one in 5,000, for 16
bands of four registers) and one whose estimate falls three deviations short (one in 700 at exactly 0.8,
none in practice above 0.83). The README has the recall that was measured against all pairs.

Defined results: the class id is the smallest document id of the class; texts without words (null,
empty) and texts like no other are their own class; texts of fewer than five words are one shingle;
rows of one id are judged by their own texts; null ids are members but never class ids while others
are; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.arrow_text import flat, mix, slices, words
from quillstream.llm.components import components
from quillstream.llm.shared import written

WORDS, THRESHOLD = 5, 0.8
REGISTERS, BANDS = 64, 16
#: Members that are verified with one copy of a head's text.
SHARE = 256
#: Nodes of a band that are compared at once, and the registers that they are compared by.
BLOCK, FINE = 128, 1024


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, hashes and counts of the distinct shingles of each text, ordered by text and hash."""
    h, text, _, _ = words(data, off)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    first = np.searchsorted(text, np.arange(len(off) - 1))
    count = np.bincount(text, minlength=len(off) - 1)
    place = np.arange(n) - first[text]
    size = np.minimum(count, WORDS)[text]
    begins = np.flatnonzero(place + size <= count[text])
    with np.errstate(over="ignore"):
        s = size[begins].astype(np.uint64)
        for k in range(WORDS):
            more = k < size[begins]
            s[more] = mix(s[more] * np.uint64(0x9E3779B97F4A7C15) + h[begins[more] + k])
    owner = text[begins]
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])]))
    return owner[new], s[new], np.diff(np.concatenate([new, [len(s)]])).astype(float)


def signatures(owner: np.ndarray, s: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers (n, registers) of ``n`` texts: the hash of the shingle that arrives first."""
    winners = np.zeros(n * registers, np.uint64)
    total = np.bincount(owner, weight, n)
    limit = np.where(total > 0, registers / np.maximum(total, 1e-300) * (np.log(registers) + 3), 0.0)
    todo = total > 0
    while todo.any():
        chosen = np.flatnonzero(todo[owner])
        doc, h, w = owner[chosen], s[chosen], weight[chosen]
        times = np.full(n * registers, np.inf)
        t, step = np.zeros(len(h)), 0
        while len(h):
            with np.errstate(over="ignore"):
                draw = mix(h + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                where = mix(h + np.uint64((2 * step + 2) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            t = t - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
            live = t <= limit[doc]
            doc, h, w, t, where = doc[live], h[live], w[live], t[live], where[live]
            at = doc * registers + (where % np.uint64(registers)).astype(np.int64)
            np.minimum.at(times, at, t)
            won = t == times[at]
            winners[at[won]] = h[won]
            step += 1
        full = np.isfinite(times.reshape(n, registers)).all(1)
        todo &= ~full
        limit[todo] *= 2
    return winners.reshape(n, registers)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    rows = REGISTERS // BANDS
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), BANDS)).copy()
        for k in range(rows):
            h = mix(h * np.uint64(0x100000001B3) + registers[:, k::rows][:, :BANDS])
    return h.view(np.int64)


def fingerprints(owner: np.ndarray, s: np.ndarray, weight: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits that equal multisets of shingles share; None for a text without words."""
    out = np.zeros((n, 2), np.uint64)
    has = np.zeros(n, bool)
    has[owner] = True
    if len(owner):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                out[owner[starts], k] = np.add.reduceat(mix(s ^ np.uint64(salt)) * weight.astype(np.uint64), starts)
    raw = out.tobytes()
    return [raw[16 * i : 16 * i + 16] if ok else None for i, ok in enumerate(has.tolist())]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets given as (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    x, y = wa[both], wb[at[both]]
    rest_a, rest_b = float(wa[~both].sum()), float(wb.sum() - y.sum())
    if not len(x):
        return 0.0
    pairs, n = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), k in zip(pairs.T, n, strict=True):
        total += k / (float((np.maximum(pairs[0] / p, pairs[1] / q) * n).sum()) + rest_a / p + rest_b / q)
    return total


def _split(owner: np.ndarray, s: np.ndarray, weight: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    cuts = np.searchsorted(owner, np.arange(n + 1))
    return [(s[i:j], weight[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, copy, node, bands): each row's id, the hash of its text, the fingerprint of its shingles and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                made, n = shingles(*flat(part.column(2))), part.num_rows
                bands = band_hashes(signatures(*made, n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(*made, n), pa.binary()), lists], names=["key", "copy", "node", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("copy"), text_col).mapInArrow(run, f"key {kind}, copy long, node binary, bands array<bigint>")


def _packed(rows: DataFrame) -> DataFrame:
    """(node, z) of rows (node, text): texts compressed, as they are about to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column(1))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tool.compress(raw[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["node", "z"])

    return rows.mapInArrow(run, "node binary, z binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of compressed texts."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    return shingles(*flat(pa.array([tool.decompress(z) for z in column.to_pylist()], pa.large_binary())))


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the pairs (head, member) of nodes that reach the threshold: each head's text is held once, its members stream by."""
    shares = pairs.groupBy("head").agg(F.count("*").alias("n")).select("head", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "head").withColumn("share", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int"))
    members = dealt.join(texts, dealt["member"] == texts["node"]).select("head", "share", "member", "z")
    heads = shares.join(texts, shares["head"] == texts["node"]).select("head", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("binary").alias("member"), "z")
    both = heads.unionByName(members).repartition("head", "share").sortWithinPartitions("head", "share", F.col("member").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = _split(*_unpacked(part.column(3)), part.num_rows)
                out = []
                for h, member, one in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets, strict=True):
                    if member is None:
                        head, held = h, one
                    elif head == h and probability_jaccard(held, one) >= threshold:
                        out.append((h, member))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["u", "v"])

    return both.mapInArrow(run, "u binary, v binary")


def _fine(texts: DataFrame) -> DataFrame:
    """(node, fine) of rows (node, z): a byte of each of ``FINE`` registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                raw = signatures(*_unpacked(part.column(1)), part.num_rows, FINE).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[k * FINE : (k + 1) * FINE] for k in range(part.num_rows)], pa.binary())], names=["node", "fine"])

    return texts.select("node", "z").mapInArrow(run, "node binary, fine binary")


def _likely(open_: DataFrame, threshold: float) -> DataFrame:
    """(head, member): pairs of rows (band, node, root, bands, fine) with one band and two roots whose estimate may reach the threshold.

    The nodes of a band are dealt to blocks by hash; block pairs are joined, and their pairs of nodes are
    compared inside the task. A pair is told by the first band that it shares.
    """
    sizes = open_.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = written(dealt.groupBy("band", "block").agg(F.collect_list(F.struct("node", "root", "bands", "fine")).alias("rows")), "blocks")
    other = blocks.select("band", F.col("block").alias("block2"), F.col("rows").alias("rows2"))
    met = blocks.join(other, "band").where(F.col("block") <= F.col("block2")).select("band", (F.col("block") == F.col("block2")).alias("same"), "rows", "rows2")
    # A byte agrees by chance in one of 256 unequal registers.
    least = threshold - 3 * float(np.sqrt(threshold * (1 - threshold) / FINE))
    least = int(np.floor(FINE * (least + (1 - least) / 256)))

    def side(rows: pa.StructScalar) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        field = rows.values.field
        fine = np.frombuffer(b"".join(field("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        return field("node").to_pylist(), np.array(field("root").to_pylist(), object), field("bands").flatten().to_numpy().reshape(-1, BANDS), fine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, same, rows, rows2 in zip(*batch.columns, strict=True):
                (a, root, bands, fine), (b, root2, bands2, fine2) = side(rows), side(rows2)
                place = int(np.flatnonzero(bands[0] == band.as_py())[0])
                out = []
                for i in range(len(a)):
                    apart = root2 != root[i]
                    if same.as_py():
                        apart[: i + 1] = False
                    apart &= ~(bands2[:, :place] == bands[i, :place]).any(1)
                    at = np.flatnonzero(apart)
                    near = at[(fine2[at] == fine[i]).sum(1) >= least]
                    out += [(min(a[i], b[k]), max(a[i], b[k])) for k in near.tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["head", "member"])

    return met.mapInArrow(run, "head binary, member binary")


def _central(placed: DataFrame, links: DataFrame, stars: DataFrame) -> DataFrame:
    """(head, member), less those of ``stars``: the nodes of each band that its head is not linked to all of, with its most linked node."""
    degree = links.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("degree"))
    linked = links.select(F.col("u").alias("head"), F.col("v").alias("node"), F.lit(True).alias("linked"))
    marked = placed.join(linked, ["head", "node"], "left").join(degree, "node", "left")
    best = F.max_by("node", F.struct(F.coalesce("degree", F.lit(0)), "node"))
    bands = marked.groupBy("band").agg(best.alias("centre"), F.bool_and(F.coalesce("linked", F.col("node") == F.col("head"))).alias("whole"), F.count("*").alias("n"))
    around = placed.join(bands.where("NOT whole AND n > 2").select("band", "centre"), "band").where("node <> centre")
    pairs = around.select(F.least("centre", "node").alias("head"), F.greatest("centre", "node").alias("member")).distinct()
    return pairs.join(stars, ["head", "member"], "left_anti")


def members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, copy, class_id, class_copy, class_node) of every row; ``copy`` is xxhash64 of the text.

    ``class_id`` and ``class_copy`` are those of the first row of the class, by id and then by hash, null ids last.
    """
    sketches = written(sketch(df, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "copy"))
    nodes = written(sketches.where("node IS NOT NULL").groupBy("node").agg(first.alias("first"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").drop("n")
    placed = written(banded.join(heads, "band"), "bands")
    # The text of a node is that of its first row; repeated rows of one id and text are told once.
    needed = nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", F.col("first.key").alias("key"), F.col("first.copy").alias("copy"))
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_copy"), F.col(text_col).alias("text"))
    held = rows.join(needed, rows["_id"].eqNullSafe(needed["key"]) & (rows["_copy"] == needed["copy"])).select("node", "text")
    texts = written(_packed(held).groupBy("node").agg(F.first("z").alias("z")), "texts")

    stars = placed.where("node <> head").select("head", F.col("node").alias("member")).distinct()
    links = written(_verify(stars, texts, threshold), "stars")
    central = written(_central(placed, links, stars), "central")
    links = links.unionByName(written(_verify(central, texts, threshold), "central-links"))
    stars = stars.unionByName(central)
    roots = components(links)

    # Nodes of bands whose nodes are not all in one component.
    rooted = placed.drop("head").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    open_ = written(rooted.join(split, "band", "left_semi"), "open")
    fine = written(_fine(texts.join(open_.select("node").distinct(), "node", "left_semi")), "fine")
    detail = open_.join(nodes.select("node", "bands"), "node").join(fine, "node")
    pairs = written(_likely(detail, threshold), "pairs")
    more = written(_verify(pairs.join(stars, ["head", "member"], "left_anti"), texts, threshold), "more")
    roots = components(links.unionByName(more))

    named = sketches.join(roots, "node", "left").select("key", "copy", F.coalesce("root", "node").alias("class_node"))
    # As a table of its own, so that the join after it is not tied to the aggregation: Spark may split a class of very many rows.
    heading = written(named.where("class_node IS NOT NULL").groupBy("class_node").agg(first.alias("first")), "heads")
    classed = named.join(heading, "class_node", "left")
    own = lambda name: F.when(F.col("class_node").isNull(), F.col(name)).otherwise(F.col(f"first.{name}"))
    return classed.select("key", "copy", own("key").alias("class_id"), own("copy").alias("class_copy"), "class_node")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of every row."""
    return members(df, id_col, text_col, threshold).select(F.col("key").alias(id_col), "class_id")


def first_of_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that are the first of their class, one for each class.

    Of rows with the first row's id and text the one that is smallest in its other columns stays. Rows
    without words are their own classes and all stay.
    """
    found = members(df, id_col, text_col, threshold)
    leading = found.where(F.col("key").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("class_copy")))
    leading = leading.select("key", "copy", F.col("class_node").isNotNull().alias("words")).distinct()
    # The row goes as one value, so that no name of its columns meets one of these.
    here = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_copy"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    kept = here.join(leading, F.col("id").eqNullSafe(F.col("key")) & (F.col("text_copy") == F.col("copy"))).select("id", "copy", "words", "row")
    # Rows without words are told apart by a number that no other row has.
    alone = F.when(F.col("words"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    value = lambda c: F.col("row").getField(c)
    others = [c for c in df.columns if c not in (id_col, text_col)]
    order = [F.to_json(F.struct(value(c).alias("v"))) if "map<" in df.schema[c].dataType.simpleString() else value(c) for c in others] or [F.lit(0)]
    turn = F.row_number().over(Window.partitionBy("id", "copy", "alone").orderBy(*order))
    return kept.withColumn("alone", alone).withColumn("turn", turn).where("turn = 1").select(*[value(c).alias(c) for c in df.columns])
