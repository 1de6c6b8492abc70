"""What is shown of decisions and deliveries, and small updates of stored rows, as new rows.

Decisions are structs: ``action``, ``brief_reason``, ``reason``, ``rule_hits`` of (rule_id, decision_action, brief_reason, reason, evidence of (evidence_id, quote),
related_targets of (name, code), affected_targets) and ``related_targets``. Null structs, lists and texts count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

TARGET = "struct<name:string,code:string>"
HIT = f"struct<rule_id:string,decision_action:string,brief_reason:string,reason:string,evidence:array<struct<evidence_id:string,quote:string>>,related_targets:array<{TARGET}>,affected_targets:array<string>>"
DECISION = f"struct<action:string,brief_reason:string,reason:string,rule_hits:array<{HIT}>,related_targets:array<{TARGET}>>"
#: What is shown at most: reasons, assessments, references, characters of reasons, quotes, ids and errors, values of a rule's field.
REASONS, ASSESSMENTS, REFERENCES, REASON_CHARS, QUOTE_CHARS, ERROR_CHARS, VALUES = 4, 32, 3, 800, 300, 1000, 40
#: What a duplicate delivery is told as, by the rule of its identity.
DUPLICATE_LABELS = {
    "intraday_market_move": "同一盘中行情事件跨来源去重", "macro_data_preview": "同一美国宏观/政策催化事件跨来源去重", "macro_data_release": "同一美国宏观/政策催化事件跨来源去重", "macro_market_reaction": "同一美国宏观/政策催化事件跨来源去重",
    "fed_policy_market_reaction": "同一美国宏观/政策催化事件跨来源去重", "ai_compute_supply_demand": "同一AI算力供需催化事件跨来源去重", "industry_fact_dedup": "同一产业事实跨来源去重", "investment_bank_report_dedup": "同一投行个股评级/目标价报告跨来源去重",
    "company_event_dedup": "同一公司事件事实跨来源去重",
}
DUPLICATE_DEFAULT = "同一规则观点跨来源去重"


def _list(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(f"array<{kind}>"))


def _once(texts: Column) -> Column:
    """The texts that are not empty, white space folded, each once whatever its case, in first spelling."""
    return T.distinct_ignoring_case(texts)


def basis_reasons(decision: Column, most: int = REASONS) -> Column:
    """(reasons, omitted): what the hits of the winning action say, each once; without any the decision's own reason."""
    hits = F.filter(_list(decision["rule_hits"], HIT), lambda h: T.strip(T.text_of(h["decision_action"])) == T.strip(T.text_of(decision["action"])))
    told = _once(F.transform(hits, lambda h: T.first_non_empty(h["brief_reason"], h["reason"])))
    own = _once(F.array(T.first_non_empty(decision["brief_reason"], decision["reason"])))
    # The reasons are an array of one element here, so that they are made once and not for each use.
    return T.once(T.once(told, lambda t: F.when(F.size(t) > 0, t).otherwise(own)), lambda all_: F.struct(F.slice(all_, 1, most).alias("reasons"), F.greatest(F.size(all_) - most, F.lit(0)).alias("omitted")))


def target_labels(decision: Column) -> Column:
    """The targets of the hits, named and affected, and those of the decision, as ``name code``, each once in this order."""
    label = lambda t: F.concat_ws(" ", T.non_empty(T.strip(T.text_of(t["name"]))), T.non_empty(T.strip(T.text_of(t["code"]))))
    of_hit = lambda h: F.concat(F.transform(_list(h["related_targets"], TARGET), label), F.transform(_list(h["affected_targets"], "string"), lambda x: T.strip(T.text_of(x))))
    named = F.concat(F.flatten(F.transform(_list(decision["rule_hits"], HIT), of_hit)), F.transform(_list(decision["related_targets"], TARGET), label))
    return F.array_distinct(F.filter(named, lambda x: x != ""))


def rule_only_interpretation(title: Column, summary: Column, decision: Column) -> Column:
    """(core_content, brief_reason, model) of an item that no model interprets."""
    return F.struct(T.first_non_empty(summary, title).alias("core_content"), T.first_non_empty(decision["brief_reason"], decision["reason"]).alias("brief_reason"), F.lit("rule_only").alias("model"))


def decision_view(decision: Column) -> Column:
    """A decision as it is shown: at most 32 assessments of three quotes each, texts cut; null without a decision."""
    cut = lambda c, n: F.substring(T.strip(T.text_of(c)), 1, n)
    quotes = lambda h: F.filter(F.transform(F.slice(_list(h["evidence"], "struct<evidence_id:string,quote:string>"), 1, REFERENCES), lambda e: F.struct(cut(e["evidence_id"], 40).alias("evidence_id"), cut(e["quote"], QUOTE_CHARS).alias("quote"))), lambda e: e["quote"] != "")
    shown = F.transform(F.slice(_list(decision["rule_hits"], HIT), 1, ASSESSMENTS), lambda h: F.struct(cut(h["rule_id"], 120).alias("rule_id"), cut(h["decision_action"], 30).alias("action"), cut(h["reason"], REASON_CHARS).alias("reason"), quotes(h).alias("evidence")))
    return F.when(decision.isNotNull(), F.struct(cut(decision["action"], 30).alias("action"), cut(T.first_non_empty(decision["brief_reason"], decision["reason"]), REASON_CHARS).alias("reason"), shown.alias("rule_assessments")))


def duplicate_label(rule: Column) -> Column:
    """What a delivery that was left out as a duplicate is told as."""
    return F.coalesce(*[F.when(rule == r, F.lit(label)) for r, label in DUPLICATE_LABELS.items()], F.lit(DUPLICATE_DEFAULT))


def shown_values(values: Column, most: int = VALUES) -> Column:
    """(values, count, truncated): the values of a rule's field that are not blank, trimmed, the first ``most`` of them."""
    told = F.filter(F.transform(_list(values, "string"), lambda v: T.strip(T.text_of(v))), lambda v: v != "")
    return F.struct(F.slice(told, 1, most).alias("values"), F.size(told).alias("count"), (F.size(told) > most).alias("truncated"))


def restored(ledger: DataFrame, source: str, reason: str, error: str, now: Column) -> DataFrame:
    """``ledger`` with the live rows of a source that ended for want of a detail open again, and ``restored``."""
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    open_ = is_("source", source) & is_("collection_class", "live") & is_("processability_status", "failed_terminal") & is_("processability_reason", reason) & is_("admission_status", "not_applicable") & is_("processing_status", "not_applicable")
    changes = {"processability_status": F.lit("failed_retryable"), "processability_reason": F.lit(error), "admission_status": F.lit("pending"), "processed_at": F.lit(None).cast(ledger.schema["processed_at"].dataType), "lifecycle_updated_at": now}
    marked = ledger.withColumn("restored", open_)
    return marked.withColumns({c: F.when(F.col("restored"), v).otherwise(F.col(c)) for c, v in changes.items()})


def delivery_attempts(posts: DataFrame, attempts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``posts`` (keys) with status, error, attempts and delivered_at after the ``attempts`` (keys, status, error, at) on them.

    Status and error are those of the last attempt, the error cut; the time is that of the last one that was sent and stays when a later one fails.
    """
    place = F.struct(*order)
    sent = F.max(F.when(F.col("status") == "sent", F.col("at")))
    made = attempts.groupBy(*keys).agg(F.max_by("status", place).alias("delivery_status"), F.substring(F.coalesce(F.max_by(F.coalesce("error", F.lit("")), place), F.lit("")), 1, ERROR_CHARS).alias("delivery_error"), F.count("*").alias("delivery_attempts"), sent.alias("delivered_at"))
    return posts.select(*keys).join(made, list(keys), "left").na.fill(0, ["delivery_attempts"])


def holdings_saved(stored: DataFrame, sent: DataFrame) -> DataFrame:
    """(symbol, name, enabled, aliases, state): holdings as saved, a row a sent one; state is ``saved`` or ``refused`` (neither symbol nor name).

    A field that is not sent (null) keeps what is stored; the name defaults to the symbol; lists are told once each.
    """
    old = stored.groupBy(F.col("symbol").alias("_symbol")).agg(*[F.max(c).alias(f"_{c}") for c in ("name", "enabled")], F.max("aliases").alias("_aliases"))
    symbol, name = T.strip(T.text_of(F.col("symbol"))), T.strip(T.text_of(F.col("name")))
    both = sent.select(F.upper(symbol).alias("symbol"), name.alias("name"), "enabled", "aliases").join(old, F.col("symbol") == F.col("_symbol"), "left")
    named = T.first_non_empty(F.col("name"), F.col("_name"), F.col("symbol"))
    return both.select(
        "symbol", named.alias("name"), F.coalesce("enabled", "_enabled", F.lit(True)).alias("enabled"), T.distinct_texts(F.coalesce("aliases", "_aliases", F.array().cast("array<string>"))).alias("aliases"), F.when(named == "", "refused").otherwise("saved").alias("state")
    )


def process_order(items: DataFrame, published: str, tie: str) -> DataFrame:
    """``items`` with ``turn``: in order of the published text, empty first, then by ``tie``; within each batch of a source when ``source`` is there.

    The order is of texts, as the times of sources are texts.
    """
    by = ["source"] if "source" in items.columns else []
    return items.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(T.text_of(F.col(published)), tie)))


def latest_decisions(rows: DataFrame, at: str, review: str, status: str | None = None, most: int = 500) -> DataFrame:
    """The ``most`` latest decisions, by time and then review id, of one status if asked for. The limit is the feature, 500 at most."""
    chosen = rows if status is None else rows.where(F.col("status") == status)
    return chosen.orderBy(F.desc_nulls_last(at), F.desc(review)).limit(max(1, min(most, 500)))
