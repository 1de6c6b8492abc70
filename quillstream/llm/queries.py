"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import automaton_dedup, byte_bpe, clause_grammar, line_windows, linear_text, metric_tree, phrase_index, prefix_trie, prob_minhash, secret_scan, suffix_dedup, warc_archive, word_runs
from quillstream.llm.oracles import ORACLES as ORACLES
from quillstream.llm.shared import fresh_path, remainder
from quillstream.session import table


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc_archive.write(warc_archive.with_revisits(table(spark, sf_dir, "pages")), folder)
    return warc_archive.page_records(spark, folder)


def op2_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedupe(table(spark, sf_dir, "documents"), with_text=False)


def quality_model(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """The quality model of the labelled documents that are not held out."""
    learn_if = remainder(F.col("doc_id"), 3) != 1
    return linear_text.train(linear_text.labelled_sample(documents, labels, "quality", learn_if))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = linear_text.score(documents, quality_model(documents, table(spark, sf_dir, "labels")))
    held_out = remainder(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.classes(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_windows.dedupe(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learn_if = remainder(F.col("doc_id"), 4) != 2
    sample = linear_text.labelled_sample(documents, table(spark, sf_dir, "labels"), "toxic", learn_if, clause_grammar.SAMPLE_ROWS)
    scored = clause_grammar.score(documents, clause_grammar.train(sample))
    held_out = remainder(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal doc_id and g = h div 10, where h % 10 = 0 the n words from number g % n on repeat
    the first p of them, p = 1 + (n - g % n) div (3 + g % 8). A null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.repeats(with_planted_periods(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = found.withColumn("best", word_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the first h turns of conversation c - c % 100, then those of c after its own first h.

    h is crc32 of the decimal conv_id modulo 6, so at most five turns of a conversation are copied, to at most 199 others.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    placed = turns.where("conv_id IS NOT NULL").select("conv_id", (F.row_number().over(order) - 1).alias("place"), "role", "text")
    share = remainder(F.col("conv_id"), 6)
    own = placed.where(F.col("place") >= share)
    heirs = turns.where("conv_id IS NOT NULL").select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), share.alias("h"))
    lent = placed.where("place < 5").withColumnRenamed("conv_id", "base")
    taken = heirs.where("h > 0").join(lent, "base").where("place < h").select("conv_id", "place", "role", "text")
    return own.unionByName(taken).withColumnRenamed("place", "turn")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.nodes(rebuilt_conversations(turns), turns).drop("digest")


def op13_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.dedupe(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {
    "op1_warc_archive": op1_warc_archive,
    "op2_metric_tree": op2_metric_tree,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_phrase_index": op5_phrase_index,
    "op6_prob_minhash": op6_prob_minhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_line_windows": op8_line_windows,
    "op9_toxicity_grammar": op9_toxicity_grammar,
    "op10_secret_scan": op10_secret_scan,
    "op11_word_runs": op11_word_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_automaton_dedup": op13_automaton_dedup,
}
