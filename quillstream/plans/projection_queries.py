"""What is shown of decisions and deliveries, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import projections as P
from quillstream.plans.event_queries import _events
from quillstream.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions: a line is the hit of a rule, with a target by part and one by supplier."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    flag = F.col("l_returnflag")
    target = F.struct(F.when(F.col("l_partkey") % 3 > 0, text("P", F.col("l_partkey") % 9)).alias("name"), F.when(F.col("l_partkey") % 2 == 0, text(F.col("l_suppkey") % 5)).alias("code"))
    one = F.struct(
        text("r", F.col("l_linenumber")).alias("rule_id"), F.when(flag == "R", "push").when(flag == "A", "daily").otherwise("archive").alias("decision_action"), F.when(F.col("l_linenumber") % 2 == 0, text(" Why  ", F.col("l_partkey") % 4)).alias("brief_reason"),
        text("why ", F.col("l_suppkey") % 3).alias("reason"), F.array(F.struct(F.lit("T1").alias("evidence_id"), F.repeat(F.lit("q"), (F.col("l_partkey") % 400).cast("int")).alias("quote"))).alias("evidence"),
        F.array(target).alias("related_targets"), F.array(text("S", F.col("l_suppkey") % 4)).alias("affected_targets"),
    )
    rank = F.when(flag == "R", 3).when(flag == "A", 2).otherwise(1)
    made = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(rank).alias("top"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", one.alias("hit")))).alias("hits"))
    action = F.element_at(F.array(F.lit("archive"), F.lit("daily"), F.lit("push")), F.col("top"))
    whole = F.struct(action.alias("action"), F.lit(None).cast("string").alias("brief_reason"), F.lit("own").alias("reason"), F.transform("hits", lambda h: h["hit"]).alias("rule_hits"), F.array(F.struct(F.lit("All").alias("name"), F.lit(None).cast("string").alias("code"))).alias("related_targets"))
    return made.select("l_orderkey", whole.cast(P.DECISION).alias("d"))


@query(
    "decision_views",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rank FROM lineitem),
    t AS (SELECT l_orderkey AS k, max(rank) AS top FROM l GROUP BY 1),
    r AS (SELECT k, min(n) AS n, arg_min(said, n) AS said FROM (SELECT l_orderkey AS k, n, CASE WHEN l_linenumber % 2 = 0 THEN 'Why ' || l_partkey % 4 ELSE 'why ' || l_suppkey % 3 END AS said FROM l JOIN t ON k = l_orderkey AND rank = top) GROUP BY k, lower(said)),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM r), a AS (SELECT k, string_agg(said, '|' ORDER BY n) FILTER (place <= 4) AS reasons, greatest(count(*) - 4, 0)::INT AS omitted FROM o GROUP BY k),
    g AS (SELECT l_orderkey AS k, 2 * n AS p, concat_ws(' ', CASE WHEN l_partkey % 3 > 0 THEN 'P' || l_partkey % 9 END, CASE WHEN l_partkey % 2 = 0 THEN (l_suppkey % 5)::VARCHAR END) AS x FROM l UNION ALL SELECT l_orderkey, 2 * n + 1, 'S' || l_suppkey % 4 FROM l UNION ALL SELECT DISTINCT l_orderkey, 1000, 'All' FROM l),
    h AS (SELECT k, string_agg(x, '|' ORDER BY p) AS targets FROM (SELECT k, x, min(p) AS p FROM g WHERE x <> '' GROUP BY ALL) GROUP BY k),
    v AS (SELECT l_orderkey AS k, sum(least(l_partkey % 400, 300))::BIGINT AS quote_chars, count(*) FILTER (l_partkey % 400 > 0)::BIGINT AS n_quotes FROM l GROUP BY 1)
    SELECT a.k AS l_orderkey, reasons, omitted, targets, quote_chars, n_quotes FROM a JOIN h USING (k) JOIN v USING (k)""",
)
def decision_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the winning action, targets, and what of the quotes is shown."""
    d = F.col("d")
    rows = decisions(spark, sf_dir).select("l_orderkey", P.basis_reasons(d).alias("b"), P.target_labels(d).alias("t"), P.decision_view(d).alias("v"))
    quotes = F.flatten(F.transform("v.rule_assessments", lambda a: F.transform(a["evidence"], lambda e: F.length(e["quote"]))))
    return rows.select("l_orderkey", F.array_join("b.reasons", "|").alias("reasons"), "b.omitted", F.array_join("t", "|").alias("targets"), F.aggregate(quotes, F.lit(0).cast("long"), lambda s, x: s + x).alias("quote_chars"), F.size(quotes).cast("long").alias("n_quotes"))


@query(
    "delivery_attempts",
    """WITH a AS (SELECT user_id, event_id % 60 AS post, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS status, CASE WHEN event_type = 'error' THEN props ELSE NULL END AS error, ts, event_id FROM events WHERE value < 60), p AS (SELECT DISTINCT user_id, event_id % 60 AS post FROM events)
    SELECT user_id, post, arg_max(status, struct_pack(a := ts, b := event_id)) AS delivery_status, CASE WHEN count(event_id) > 0 THEN coalesce(arg_max(coalesce(error, ''), struct_pack(a := ts, b := event_id)), '') END AS delivery_error, count(event_id)::BIGINT AS delivery_attempts, epoch_us(max(ts) FILTER (status = 'sent'))::BIGINT AS delivered_at FROM p LEFT JOIN a USING (user_id, post) GROUP BY ALL""",
)
def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("post", F.col("event_id") % 60)
    failed = F.col("event_type") == "error"
    tries = rows.where("value < 60").select("user_id", "post", F.when(failed, "failed").otherwise("sent").alias("status"), F.when(failed, F.col("props")).alias("error"), F.col("ts").alias("at"), "event_id")
    done = P.delivery_attempts(rows.select("user_id", "post").distinct(), tries, ["user_id", "post"], ["at", "event_id"])
    return done.withColumn("delivered_at", F.unix_micros("delivered_at"))


@query(
    "process_order",
    """WITH i AS (SELECT event_id, event_type AS source, CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(ts, '%d.%m.%Y %H') END AS published FROM events) SELECT event_id, row_number() OVER (PARTITION BY source ORDER BY published, event_id)::INT AS turn FROM i""",
)
def process_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the order of their times as texts, day first, source by source."""
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("source"), F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "dd.MM.yyyy HH")).alias("published"))
    return P.process_order(rows, "published", "event_id").select("event_id", "turn")


@query("latest_decisions", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 500")
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 latest decisions of one status; the limit is the feature."""
    return P.latest_decisions(_events(spark, sf_dir).withColumn("status", F.col("event_type")), "ts", "event_id", "purchase").select("event_id", "user_id")
