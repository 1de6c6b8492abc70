"""The corpus pipeline: five stages, each on all that the one before kept.

Quality classifier, line de-duplication, near-duplicate removal, benchmark decontamination, byte-level
BPE. Every stage but the last returns the columns of ``documents``; each is written as Parquet and read
again. Nulls, empty and very long texts, ties, empty tables and extra columns have the results that the
operators define; of repeated rows of one id and text the third stage keeps one, but for those without words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import byte_bpe, line_windows, linear_text, phrase_index, prob_minhash
from quillstream.llm.queries import quality_model
from quillstream.llm.shared import written
from quillstream.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more), as they are."""
    return linear_text.accepted(docs, quality_model(docs, table(spark, sf_dir, "labels")), 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those of which nothing is left go."""
    kept = line_windows.dedupe(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed)
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each near-duplicate class."""
    return prob_minhash.first_of_classes(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hit = phrase_index.alignments(docs, table(spark, sf_dir, "benchmark")).select("key", "copy").distinct()
    here = docs.select("doc_id", F.xxhash64("text").alias("text_copy"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    clean = here.join(hit, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("text_copy") == F.col("copy")), "left_anti")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of token ids, and digests of the ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate), ("byte_bpe", tokens)]

#: The classifier and the hashes of the sketches are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
