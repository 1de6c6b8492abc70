"""Near-duplicate titles: every pair of distinct cores that the rule of ``similar_titles`` joins.

Bigrams of a small alphabet are common to nearly all titles, so that an index of them meets every pair many
times over. Titles are dealt to tiles of bounded size instead, tiles that may hold similar titles meet in a task, and
the common bigrams of all their pairs are counted by a product of matrices: a pair costs the same whatever it shares,
only similar pairs become rows, and a task holds two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.session import checkpointed

#: Shares of the smaller and of the joint set of bigrams that a similar pair has in common at least; characters of a contained core.
SMALLER, LARGER, CONTAINED = 0.65, 0.45, 8
#: Titles and characters of a tile, at most about; columns of a matrix; pairs up to which a bigram's rows are counted one by one.
TILE_ROWS, TILE_CHARS, COLUMNS, FEW = 1024, 1 << 21, 2048, 2048
#: Where all titles meet: tiles that are made before a tile is more than one product wide, products of its width at most, and pairs of a task, about.
WHOLE_TILES, WIDE, TASK_PAIRS = 32, 8, 1 << 28


def _bigrams(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bigram) of every distinct bigram of each core, ordered by bigram; a single character is one."""
    sizes = np.array([len(x) for x in cores], np.int64)
    points = np.frombuffer("".join(cores).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(cores)), sizes)
    inner = rows[1:] == rows[:-1]
    single = sizes[rows] == 1
    rows, grams = np.concatenate([rows[:-1][inner], rows[single]]), np.concatenate([(points[:-1] * 1114112 + points[1:])[inner], points[single]])
    # A bigram takes 41 bits, so one number has the row as well, and numbers are sorted faster than pairs.
    bits = len(cores).bit_length()
    both = np.sort((grams << bits) | rows)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return both & ((1 << bits) - 1), both >> bits


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of an ordered array, where each begins and how often it is there."""
    at = np.flatnonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))
    return ordered[at], at, np.diff(np.append(at, len(ordered)))


def _shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int, m: int) -> np.ndarray:
    """How many bigrams row i of the left and row j of the right tile share: rare ones pair by pair, others by matrices of some columns."""
    out = np.zeros((n, m), np.float32)
    (a, a_at, a_n), (b, b_at, b_n) = _runs(left[1]), _runs(right[1])
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    a_at, a_n, b_at, b_n = a_at[i], a_n[i], b_at[j], b_n[j]
    pairs = a_n * b_n
    many = np.flatnonzero(pairs > FEW)
    for k in range(0, len(many), COLUMNS):
        some = many[k : k + COLUMNS]
        x, y = np.zeros((n, len(some)), np.float32), np.zeros((m, len(some)), np.float32)
        for made, side, at, count in ((x, left, a_at[some], a_n[some]), (y, right, b_at[some], b_n[some])):
            made[side[0][_places(at, count)], np.repeat(np.arange(len(some)), count)] = 1
        out += x @ y.T
    few = np.flatnonzero(pairs <= FEW)
    step = np.cumsum(pairs[few]) // (1 << 20)
    for some in np.split(few, np.flatnonzero(np.diff(step)) + 1) if len(few) else ():
        # Each left row of a bigram with each of its right rows.
        rows, by = left[0][_places(a_at[some], a_n[some])], np.repeat(b_n[some], a_n[some])
        met = np.repeat(rows, by) * m + right[0][_places(np.repeat(b_at[some], a_n[some]), by)]
        out += np.bincount(met, minlength=n * m).reshape(n, m)
    return out


def _places(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each of ``at`` on, as many as ``count`` says."""
    return np.arange(count.sum()) + np.repeat(at - np.cumsum(count) + count, count)


class _Side:
    """Titles that are compared in one product: their texts, bigrams, how many bigrams each has, numbers of equal texts, and where they begin in the tile."""

    def __init__(self, cores: list[str], at: int, kinds: dict[str, int]):
        self.cores, self.at, self.grams = cores, at, _bigrams(cores)
        self.sizes = np.bincount(self.grams[0], minlength=len(cores))
        self.kinds = np.array([kinds.setdefault(v, len(kinds)) for v in cores])
        self.lengths = np.array([len(v) for v in cores])


def _sides(cores: list[str], kinds: dict[str, int]) -> list[_Side]:
    """A tile's titles, about ``TILE_ROWS`` titles and ``TILE_CHARS`` characters at a time."""
    ends, many = np.cumsum([len(v) for v in cores]), max(1, round(len(cores) / TILE_ROWS))
    part = np.arange(len(cores)) * many // len(cores) + ends // TILE_CHARS
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(cores)]
    return [_Side(cores[i:j], i, kinds) for i, j in zip(at[:-1], at[1:], strict=True)]


def _alike(x: _Side, y: _Side) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the similar pairs of unlike cores of two sides, or of one with itself, each once, by the rule of ``similar_titles``."""
    shared = _shared(x.grams, y.grams, len(x.cores), len(y.cores))
    a, b = x.sizes.astype(np.float32), y.sizes.astype(np.float32)

    def unlike(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of places in ``shared`` those of unlike cores, once each; their row and column, and if enough bigrams are shared."""
        i, j = np.divmod(found, len(y.cores))
        taken = x.kinds[i] != y.kinds[j]
        if x is y:
            taken &= i < j
        found, i, j = found[taken], i[taken], j[taken]
        n, k, m = x.sizes[i], shared.ravel()[found].astype(np.float64), y.sizes[j]
        least = np.minimum(n, m)
        return found, i, j, (k >= least * 0.5) & (k / least >= SMALLER) & (k / (n + m - k) >= LARGER)

    # k / (a + b - k) >= LARGER where k >= (a + b) * LARGER / (1 + LARGER): a bound with some room in single precision, the rule itself for what it leaves.
    room = LARGER / (1 + LARGER)
    found, _, _, close = unlike(np.flatnonzero(shared >= (a * np.float32(room) - np.float32(0.1))[:, None] * np.float32(0.9999) + (b * np.float32(room * 0.9999))[None, :]))
    found = found[close]
    # Bigrams of a part are all in the whole, so texts are searched only then, and only where that tells another result.
    open_, i, j, close = unlike(np.flatnonzero((shared == a[:, None]) | (shared == b[None, :])))
    long = np.minimum(x.lengths[i], y.lengths[j]) >= CONTAINED
    other = long != close
    open_, i, j, long = open_[other], i[other], j[other], long[other]
    within = np.array([u in v if len(u) < len(v) else v in u for u, v in ((x.cores[p], y.cores[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True))], bool)
    if len(within) and (within & ~long).any():
        found = found[~np.isin(found, open_[within & ~long])]
    return np.divmod(np.concatenate([found, open_[within & long]]), len(y.cores))


def _pairs(batches: Iterator[pa.RecordBatch], timed: bool) -> Iterator[pa.RecordBatch]:
    """(x, t, y, t2) of the similar pairs of a cell's two tiles, or of one with itself; (x, y) if not ``timed``."""
    cell = pa.Table.from_batches(batches)
    second = cell.column("second").to_numpy()
    alone = cell.column("a")[0] == cell.column("b")[0]
    left, right = (cell.filter(pa.array(side)).select(["id", "core", *(["t"] if timed else [])]).combine_chunks() for side in (~second, second))
    if not left.num_rows or not (alone or right.num_rows):
        return
    kinds: dict[str, int] = {}
    ours = _sides(left.column("core").to_pylist(), kinds)
    right, theirs = (left, ours) if alone else (right, _sides(right.column("core").to_pylist(), kinds))
    left, right = left.drop_columns("core"), right.drop_columns("core")
    for k, x in enumerate(ours):
        for y in theirs[k:] if alone else theirs:
            i, j = _alike(x, y)
            for at in range(0, len(i), 1 << 16):
                u, v = left.take(pa.array(i[at : at + (1 << 16)] + x.at)), right.take(pa.array(j[at : at + (1 << 16)] + y.at))
                told = {"x": u["id"], "t": u["t"], "y": v["id"], "t2": v["t"]} if timed else {"x": u["id"], "y": v["id"]}
                yield from pa.table(told).combine_chunks().to_batches()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _pairs(batches, True)


def _met_ever(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _pairs(batches, False)


def _cells(rows: DataFrame, *also: str) -> DataFrame:
    """Rows (tile, meets, id, core) once for each cell (a, b) of two tiles that meet; ``meets`` lists a tile's partners, itself too."""
    other = F.col("other")
    each = rows.select("tile", F.explode("meets").alias("other"), "id", "core", *also)
    return each.select(F.least("tile", other).alias("a"), F.greatest("tile", other).alias("b"), (F.col("tile") > other).alias("second"), "id", "core", *also)


def _similar(rows: DataFrame) -> DataFrame:
    """(x, t, y, t2): the similar pairs of rows (tile, meets, id, core, t) of tiles that meet."""
    kind = rows.schema["id"].dataType.simpleString()
    return _cells(rows, "t").groupBy("a", "b").applyInArrow(_met, f"x {kind}, t long, y {kind}, t2 long")


def _tiles(n: Column, chars: Column) -> Column:
    """How many tiles so many titles of so many characters go to."""
    return F.greatest(F.lit(1), F.ceil(n / TILE_ROWS), F.ceil(chars / TILE_CHARS)).cast("long")


def _whole_tiles(size: int, chars: int) -> int:
    """How many tiles titles go to that all meet. A text goes to a cell for each tile, so tiles widen once there are enough cells."""
    least = max(1, -(-size // TILE_ROWS), -(-chars // TILE_CHARS))
    return max(min(least, WHOLE_TILES), -(-least // WIDE))


def near_duplicates_within(rows: DataFrame, doc_id: str, core: str, at: str, span: int) -> DataFrame:
    """(doc_a, doc_b, relation): rows with similar cores at most ``span`` apart in ``at`` (a whole number of some unit).

    A row with the core of an earlier one in reach is ``equal`` to the last such row, so copies make a chain
    and not all pairs; rows of different cores are compared by the rule of ``near_duplicates``, each with those
    in its own block of time and the blocks beside it. Empty cores and null times take no part; repeated rows of one id, core
    and time count once.
    """
    taken = rows.select(F.col(doc_id).alias("doc_id"), F.col(core).alias("core"), F.col(at).cast("long").alias("t")).where("core <> '' AND t IS NOT NULL AND doc_id IS NOT NULL").distinct()
    # Cores are made once, as every join below reads them.
    base = checkpointed(taken)
    order = Window.partitionBy("core").orderBy("t", "doc_id")
    before = base.select("doc_id", "t", F.lag(F.struct("doc_id", "t")).over(order).alias("p")).where(F.col("t") - F.col("p.t") <= span)
    equal = before.select(F.least("doc_id", "p.doc_id").alias("doc_a"), F.greatest("doc_id", "p.doc_id").alias("doc_b"), F.lit("equal").alias("relation"))

    # Rows of one time go to the tiles of their block, which meet one another and those of the blocks beside it.
    blocks = base.withColumn("block", F.floor(F.col("t") / max(span, 1)))
    sizes = blocks.groupBy("block").agg(_tiles(F.count("*"), F.sum(F.length("core"))).alias("n"))
    beside = lambda k: sizes.select((F.col("block") + k).alias("block"), F.col("n").alias(f"n_{k + 1}"))
    around = sizes.join(beside(-1), "block", "left").join(beside(1), "block", "left")
    named = lambda k, n: F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), lambda i: F.struct((F.col("block") + k).alias("block"), i.alias("n")))
    own = F.struct("block", F.pmod(F.xxhash64("doc_id", "core", "t"), F.col("n")).alias("n"))
    meets = F.concat(named(1, F.col("n_0")), named(0, F.col("n")), named(-1, F.col("n_2")))
    met = _similar(blocks.join(around, "block").select(own.alias("tile"), meets.alias("meets"), F.col("doc_id").alias("id"), "core", "t"))
    near = met.where((F.col("x") != F.col("y")) & (F.abs(F.col("t") - F.col("t2")) <= span))
    return near.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.lit("similar").alias("relation")).union(equal)


def near_duplicates(rows: DataFrame, doc_id: str, title: str) -> DataFrame:
    """(doc_a, doc_b, relation): similar pairs of distinct cores, each told by its smallest id, and who has which core.

    ``equal`` and ``short`` give a member of a core after its smallest id; a core under 8 characters is no
    near-duplicate of its own copies, but its members have its similar pairs. Empty cores take no part. All
    pairs of cores are compared, so the work grows with their square, as the similar pairs do.
    """
    cores = rows.select(F.col(doc_id).alias("doc_id"), T.title_core(F.col(title)).alias("core")).where("core <> ''")
    heads = checkpointed(cores.groupBy("core").agg(F.min("doc_id").alias("head")))
    size, chars = heads.agg(F.count("*"), F.coalesce(F.sum(F.length("core")), F.lit(0))).first()
    n = _whole_tiles(size, chars)
    tile, every = F.pmod(F.xxhash64("core"), F.lit(n)), F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    cells = _cells(heads.select(tile.alias("tile"), every.alias("meets"), F.col("head").alias("id"), "core"))
    # Cells cost their pairs and not their bytes, so tasks are dealt by pairs.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * size // (2 * TASK_PAIRS)))
    kind = heads.schema["head"].dataType.simpleString()
    met = cells.repartition(min(tasks, n * (n + 1) // 2), "a", "b").groupBy("a", "b").applyInArrow(_met_ever, f"x {kind}, y {kind}")
    similar = met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.lit("similar").alias("relation"))
    relation = F.when(F.length("core") < CONTAINED, "short").otherwise("equal").alias("relation")
    members = cores.join(heads, "core").where(F.col("doc_id") != F.col("head")).select("head", "doc_id", relation)
    return similar.union(members)
