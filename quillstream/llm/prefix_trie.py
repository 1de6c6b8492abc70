"""Conversation prefix trie: chained SHA-256 digests of turns, one node a (depth, digest), sums over subtrees.

The digest of a prefix is SHA-256 of the digest before it and of the turn's own digest, from SHA-256 of
nothing at the root. Each conversation streams through its task in turn order, a digest of 32 bytes a
turn, and yields a row for each prefix; an aggregation with a partial step in each task makes the nodes,
so that a prefix that all conversations share costs a row a task.

Sums over subtrees: every node sends its value to all its ancestors. A node is told by its smallest
member, and the nodes that one conversation tells lie on its path from some depth down to its end, so
their values are summed along that path first (a window of one conversation) and each prefix of the
conversation sends one row, in place of a row for every pair of node and ancestor.

The ids of conversations that end at a node are joined in blocks of 65,536 consecutive ids; the blocks of
a node then stream in order through one running SHA-256, so that no list of ids is ever held whole.

Defined results: turns go by number, nulls first, and equal numbers by the digest of the turn, so repeated
rows are turns of their own. A null role or text is the empty one. Rows without a conversation id belong
to none. ``conversations`` names conversations that may have no turns; they end at the root. Extra
columns are ignored; no conversations give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.shared import written

#: Conversation ids of one block share all bits but the last so many.
BLOCK_BITS = 16
ROOT = hashlib.sha256(b"").digest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def paths(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, digest, parent, chars, last): a row for every prefix of every conversation, the empty one with it."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.lit(1).alias("kind"), F.col(turn_col).alias("turn"),
        turn_digest(F.col(role_col), F.col(text_col)).alias("own"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("chars"),
    )
    ids = rows.select("conv_id")
    if conversations is not None:
        ids = ids.unionByName(conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id")))
    starts = ids.distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema[turn_col].dataType).alias("turn"), F.lit(None).cast("binary").alias("own"), F.lit(0).cast("long").alias("chars"))
    ordered = rows.unionByName(starts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last prefix; whether its conversation goes on is known from the next row
        for batch in batches:
            out = []
            for conv, own, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    out.append((*held, conv != held[0]))
                if own is None:
                    held = (conv, 0, ROOT, None, 0)
                else:
                    held = (conv, held[1] + 1, hashlib.sha256(held[2] + own).digest(), held[2], chars)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, True), kinds, strict=True)], names=names)

    names = ["conv_id", "depth", "digest", "parent", "chars", "last"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    return ordered.select("conv_id", "own", "chars").mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, chars long, last boolean")


def _end_digests(prefixes: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of the nodes at which conversations end."""
    block = F.shiftright("conv_id", BLOCK_BITS)
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")))
    blocks = prefixes.where("last").groupBy("depth", "digest", block.alias("block")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "digest", "ends_sha256"])

        for batch in batches:
            out = []
            for depth, digest, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, digest) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256(ids.encode())
            if out:
                yield told(out)
        if node is not None:
            yield told([(*node, state.hexdigest())])

    ordered = blocks.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "block").select("depth", "digest", "ids")
    return ordered.mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def nodes(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    prefixes = written(paths(turns, conversations, conv_col, turn_col, role_col, text_col), "prefixes")
    made = prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("parent").alias("parent"))
    made = written(made, "trie")
    below = made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    made = written(made.join(below, ["depth", "digest"], "left").na.fill(0, ["n_children"]), "nodes")

    # A conversation's nodes on its own path, summed from its end up, so that every prefix tells one row.
    values = made.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = prefixes.select("conv_id", "depth", "digest").join(values, ["conv_id", "depth"], "left")
    told = path.select("depth", "digest", F.sum("leaf").over(upwards).alias("leaf"), F.sum("saved").over(upwards).alias("saved")).where("leaf IS NOT NULL")
    sums = told.groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    above = made.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = made.join(sums, ["depth", "digest"]).join(_end_digests(prefixes), ["depth", "digest"], "left").join(above, ["depth", "parent"], "left")
    return found.select(
        "conv_id", "depth", F.hex("digest").alias("digest"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )
