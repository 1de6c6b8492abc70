"""Exact top-k inner-product search with M-trees.

Vectors of integers are embedded into a metric space in which a larger inner product is a smaller
distance: every vector gets one more coordinate that brings all to the same norm, queries get zero.
Blocks of rows become M-trees: pages of entries, each entry with its distance to the page's routing
vector, each page with a covering radius. A search goes best first through the pages; an entry
whose stored parent distance and the triangle inequality already rule it out is never computed.

Equal vectors are first merged, in each partition and then over all, keeping the smallest ids that
any query could return (of distinct ids, as a query leaves its own out), so a vector that fills a third of the table is one entry. Blocks are bounded,
as are the query blocks they meet; the stated query set meets every block, in blocks. A bounded
sample of rows gives each query a score that its k-th best surely reaches, with which it starts.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do rows with a null id; of repeated ids every row but those with the query's own id is a
candidate, and the rows of one query id share one ranking; vectors meet only vectors of their own length; ties go to the smaller id; an empty table
gives an empty table; other columns are ignored. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, entries of a page, queries of a query block, and rows of the starting sample at most.
BLOCK_ROWS, PAGE, QUERY_ROWS, SAMPLE_ROWS = 8192, 512, 512, 2048
_EPS = 1e-6


def scaled(df: DataFrame, id_col: str, vector_col: str, factor: int = 256) -> DataFrame:
    """(id, v): components as floor(factor * x), of rows that take part."""
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(factor) * e.cast("double")).cast("long"))
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def merged(vectors: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors with the rows of their ``keep`` smallest distinct ids, of each id ``keep`` rows at most.

    Whichever id a query takes out as its own, ``keep - 1`` of the smallest other rows are left.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault(tuple(v), [])
                ids.append(i)
                if len(ids) > 2 * keep * keep:
                    ids[:] = _smallest(ids, keep)
            if len(held) >= BLOCK_ROWS:
                yield _merged_batch(held, keep)
                held = {}
        if held:
            yield _merged_batch(held, keep)

    once = vectors.select("id", "v").mapInArrow(local, "v array<bigint>, ids array<bigint>")
    rows = once.groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("rows"))
    smallest = F.slice(F.array_sort(F.array_distinct("rows")), 1, keep)
    return rows.select("v", F.flatten(F.transform(smallest, lambda i: F.slice(F.filter("rows", lambda x: x == i), 1, keep))).alias("ids"))


def _smallest(ids: list[int], keep: int) -> list[int]:
    """The rows of the ``keep`` smallest distinct ids in order, of each id ``keep`` rows at most."""
    return [i for i, n in sorted(Counter(ids).items())[:keep] for _ in range(min(n, keep))]


def _merged_batch(held: dict[tuple, list[int]], keep: int) -> pa.RecordBatch:
    kind = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([_smallest(x, keep) for x in held.values()], kind)], names=["v", "ids"])


class MTree:
    """An M-tree of one block: leaf pages of entries below pages of routing vectors below a root page."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors.astype(np.int64)
        self.values = vectors.astype(np.float64)
        square = (self.values**2).sum(1)
        self.top = float(square.max()) if len(square) else 0.0
        self.lift = np.sqrt(np.maximum(self.top - square, 0))
        rng = np.random.default_rng(len(vectors))
        self.leaves = self._pages(np.arange(len(vectors)), rng)
        self.largest = float(np.abs(self.values).max()) if vectors.size else 0.0
        short = self.largest**2 * max(1, vectors.shape[1]) < 2**24
        self.leaf_values = [self.values[p[1]].astype(np.float32 if short else np.float64) for p in self.leaves]
        routes = np.array([p[0] for p in self.leaves], np.int64)
        #: Each inner page: routing row, its leaves, their distances to it, its radius over all below.
        self.inner = []
        for route, members, distance, _ in self._pages(routes, rng, positions=True):
            radius = max(d + self.leaves[m][3] for m, d in zip(members.tolist(), distance.tolist(), strict=True))
            self.inner.append((route, members, distance, radius))
        self.route_rows = np.array([p[0] for p in self.inner], np.int64)
        self.route_radius = np.array([p[3] for p in self.inner])
        self.leaf_route = routes
        self.leaf_radius = np.array([p[3] for p in self.leaves])

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        a, b = self.values[rows], self.values[to]
        square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T + (self.lift[rows][:, None] - self.lift[to][None, :]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def _pages(self, rows: np.ndarray, rng: np.random.Generator, positions: bool = False) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
        """Pages (routing row, members, distances, radius) of at most PAGE members, near ones together."""
        if not len(rows):
            return []
        pivots = rows[rng.choice(len(rows), max(1, min(len(rows), 2 * len(rows) // PAGE)), replace=False)]
        distance = self._distances(rows, pivots)
        near = distance.argmin(1)
        out = []
        for k in np.unique(near).tolist():
            at = np.flatnonzero(near == k)
            at = at[np.argsort(distance[at, k], kind="stable")]
            for start in range(0, len(at), PAGE):
                part = at[start : start + PAGE]
                d = distance[part, k]
                out.append((int(pivots[k]), part if positions else rows[part], d, float(d.max())))
        return out

    def search(self, query: np.ndarray, k: int, floor: float, ids: list[list[int]], own: int) -> list[tuple[int, int]]:
        """The k best (score, id) of this block that reach ``floor``, ids smaller first among equals."""
        q = query.astype(np.float64)
        base = float(q @ q) + self.top
        # Sums of floats are those of integers while they fit the mantissa.
        reach_of = self.largest * float(np.abs(q).max()) * len(q)
        exact = reach_of < 2**24 or reach_of < 2**53 and self.leaf_values[0].dtype == np.float64
        asked = q.astype(self.leaf_values[0].dtype)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first

        def limit() -> float:
            """Entries farther than this cannot matter."""
            worst = max(floor, best[0][0]) if len(best) == k else floor
            return np.sqrt(max(base - 2 * worst, 0.0)) + _EPS * (1 + np.sqrt(base)) if base >= 2 * worst else -1.0

        to_route = np.sqrt(np.maximum(base - 2 * (self.values[self.route_rows] @ q), 0))
        queue = [(lower, 0, i) for i, lower in enumerate(np.maximum(to_route - self.route_radius, 0).tolist())]
        heapq.heapify(queue)
        while queue:
            lower, kind, i = heapq.heappop(queue)
            far = limit()
            if lower > far:
                break
            if kind == 0:
                _, members, parent, _ = self.inner[i]
                radius = self.leaf_radius[members]
                members = members[np.abs(to_route[i] - parent) - radius <= far]  # stored distances first
                if len(members):
                    d = np.sqrt(np.maximum(base - 2 * (self.values[self.leaf_route[members]] @ q), 0))
                    for m, distance, low in zip(members.tolist(), d.tolist(), np.maximum(d - self.leaf_radius[members], 0).tolist(), strict=True):
                        if low <= far:
                            heapq.heappush(queue, (low, 1 + distance, m))
                continue
            _, rows, parent, _ = self.leaves[i]
            near = np.abs((kind - 1) - parent) <= far
            n_near = np.count_nonzero(near)
            if not n_near:
                continue
            values = self.leaf_values[i]
            if n_near < len(rows):  # what the stored distance rules out is not computed
                rows, values = rows[near], values[near]
            scores = values @ asked if exact else self.vectors[rows] @ query
            reach = max(floor, best[0][0]) if len(best) == k else floor
            for at in np.flatnonzero(scores >= reach).tolist():
                score = int(scores[at])
                for x in ids[int(rows[at])]:
                    if x == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -x))
                    elif (score, -x) > best[0]:
                        heapq.heapreplace(best, (score, -x))
                    else:
                        break  # ids rise
        return sorted(((s, -x) for s, x in best), key=lambda r: (-r[0], r[1]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def top_k(df: DataFrame, queries_if, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """The ``k`` rows with the largest integer inner product, for each row that ``queries_if(id)`` selects."""
    spark = df.sparkSession
    vectors = scaled(df, id_col, vector_col, factor)
    distinct = merged(vectors, k + 1)
    n_rows = vectors.count()
    n_blocks = max(1, -(-n_rows // BLOCK_ROWS))
    # A block is a number by hash and a vector length; equal vectors are one row, so blocks are even.
    blocks = distinct.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int"))
    sample = spark.sparkContext.broadcast([(r.v, r.ids) for r in distinct.orderBy(F.xxhash64("v", F.lit(1)), "v").limit(SAMPLE_ROWS).collect()])
    asked = vectors.where(queries_if(F.col("id")))
    n_asked = max(1, -(-asked.count() // QUERY_ROWS))
    lot = F.pmod(F.xxhash64("id"), F.lit(n_asked)).cast("int")

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the k-th best score of the sample, which its k-th best of all reaches."""
        by_length: dict[int, list] = {}
        for v, ids in sample.value:
            by_length.setdefault(len(v), []).append((v, ids))
        held = {n: (np.array([v for v, _ in rows], np.int64), [ids for _, ids in rows]) for n, rows in by_length.items()}
        for batch in batches:
            floors = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, ids = held.get(len(v), (np.zeros((0, len(v)), np.int64), []))
                scores = rows @ np.array(v, np.int64)
                found: list[int] = []
                for at in np.argsort(-scores, kind="stable")[: k + 1].tolist():
                    found += [int(scores[at])] * sum(x != i for x in ids[at])
                floors.append(found[k - 1] if len(found) >= k else -(2**62))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors, pa.int64())], names=["id", "v", "floor"])

    query_rows = asked.mapInArrow(with_floor, "id long, v array<bigint>, floor long")
    lots = query_rows.groupBy(lot.alias("lot"), F.size("v").alias("n")).agg(F.collect_list(F.struct("id", "v", "floor")).alias("queries"))
    trees = blocks.groupBy("block", F.size("v").alias("n")).agg(F.collect_list(F.struct("v", "ids")).alias("rows"))
    # Each block is followed by every query block of its vector length; a task holds one of each.
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    met = (
        trees.select("block", "n", F.lit(-1).alias("lot"), "rows")
        .unionByName(lots.select(every, "n", "lot", "queries"), allowMissingColumns=True)
        .repartition(max(1, min(n_blocks, 4096)), "block").sortWithinPartitions("block", "n", "lot")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, ids = None, None, []
        for batch in batches:
            for block, n, lot_number, rows, queries in zip(*batch.columns, strict=True):
                if lot_number.as_py() < 0:
                    key, tree, ids = (block.as_py(), n.as_py()), MTree(_matrix(rows.values.field("v"))), rows.values.field("ids").to_pylist()
                    continue
                if key != (block.as_py(), n.as_py()):
                    continue  # no vector of this length in the block
                asked_ids, floors = queries.values.field("id").to_pylist(), queries.values.field("floor").to_pylist()
                out = []
                for i, floor, v in zip(asked_ids, floors, _matrix(queries.values.field("v")), strict=True):
                    out += [(i, x, s) for s, x in tree.search(v, k, floor, ids, i)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = met.select("block", "n", "lot", "rows", "queries").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
