"""Event, version and read-model operators bound to the driver's tables, each with the SQL that says the same.

``events`` stands for reviews, deliveries, feedback clicks and the health log (user_id is the source or
operator, event_type the action, ts the time, props JSON); ``documents`` are the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import times
from quillstream.operators import events as ev
from quillstream.operators import versions as ver
from quillstream.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; their times are read as UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _failed() -> Column:
    return F.col("event_type") == "error"

def _sent() -> Column:
    return F.col("event_type") == "purchase"



@query(
    "item_upsert_latest",
    """SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS newest_value, arg_min(ts, struct_pack(a := ts, b := event_id)) AS first_seen,
    arg_max(props, struct_pack(l := length(coalesce(props, '')), a := ts, b := event_id)) AS longest_props,
    arg_max(CASE WHEN value > 50 THEN event_id::VARCHAR END, CASE WHEN value > 50 THEN struct_pack(a := ts, b := event_id) END) AS last_filled, count(*)::BIGINT AS n_versions
    FROM events GROUP BY user_id, event_type HAVING max(value) > 50""",
)
def item_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("filled", F.when(F.col("value") > 50, F.col("event_id").cast("string")).otherwise(F.lit("")))
    merged = ver.merge_versions(rows, ["user_id", "event_type"], ["ts", "event_id"], {"value": ver.NEWEST, "ts": ver.OLDEST, "props": ver.LONGEST, "filled": ver.FILLED})
    kept = merged.where("filled <> ''")
    return kept.select("user_id", "event_type", F.col("value").alias("newest_value"), F.col("ts").cast("timestamp_ntz").alias("first_seen"), F.col("props").alias("longest_props"), F.col("filled").alias("last_filled"), "n_versions")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews of documents: event n is of document n modulo their number."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n_docs"))
    return _events(spark, sf_dir).join(F.broadcast(n)).withColumn("doc_id", F.col("event_id") % F.col("n_docs")).drop("n_docs")


_REVIEWS = "reviews AS (SELECT *, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events)"


@query(
    "current_review_per_item",
    f"""WITH {_REVIEWS}, r AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT d.doc_id, d.source, r.event_id AS review_id, r.event_type AS decision_action FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""",
)
def current_review_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    joined = ver.with_current(docs, _reviews(spark, sf_dir), "doc_id", "doc_id", ["ts", "event_id"], ["event_id", "event_type"])
    return joined.select("doc_id", "source", F.col("event_id").alias("review_id"), F.col("event_type").alias("decision_action"))


@query(
    "latest_delivery_join",
    f"""WITH {_REVIEWS}, s AS (SELECT doc_id, arg_max(event_type, event_id) AS delivery_status, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS delivery_id,
    max(CASE WHEN event_type = 'purchase' THEN ts END) AS delivery_sent_at FROM reviews GROUP BY doc_id)
    SELECT d.doc_id, coalesce(delivery_status, '') AS delivery_status, delivery_id, delivery_sent_at FROM documents d LEFT JOIN s USING (doc_id)""",
)
def latest_delivery_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ver.delivery_summary(_reviews(spark, sf_dir), "doc_id", _sent(), "event_id", "ts", "event_type")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(summary, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("delivery_status", F.lit("")).alias("delivery_status"), "delivery_id", F.col("delivery_sent_at").cast("timestamp_ntz").alias("delivery_sent_at"))


@query("semi_delivered", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_semi")


@query("anti_undelivered", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "health_consecutive_failures",
    """WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r)
    SELECT user_id, arg_max(streak, struct_pack(a := ts, b := event_id))::BIGINT AS failures_now, max(streak)::BIGINT AS longest, count(*) FILTER (streak = 3)::BIGINT AS n_third FROM s GROUP BY user_id""",
)
def health_consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ev.failure_streaks(_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], _failed())
    return log.groupBy("user_id").agg(F.max_by("streak", F.struct("ts", "event_id")).alias("failures_now"), F.max("streak").alias("longest"), F.count_if(F.col("streak") == 3).alias("n_third"))


def _error_like() -> Column:
    return F.col("event_type").isin("error", "view", "click")



@query(
    "health_alerts",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, event_type IN ('error', 'view', 'click') AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (
        SELECT user_id, event_id, ts, k, CASE WHEN f THEN 1 ELSE 0 END AS n, NULL::TIMESTAMP AS last, '' AS kind FROM o WHERE k = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.ts, o.k, CASE WHEN o.f THEN w.n + 1 ELSE 0 END,
               CASE WHEN o.f AND w.n + 1 >= 3 AND (w.last IS NULL OR o.ts - w.last >= INTERVAL 60 MINUTE) THEN o.ts ELSE w.last END,
               CASE WHEN o.f AND w.n + 1 >= 3 AND (w.last IS NULL OR o.ts - w.last >= INTERVAL 60 MINUTE) THEN 'failure'
                    WHEN NOT o.f AND w.n >= 3 AND w.last IS NOT NULL AND o.ts - w.last >= INTERVAL 60 MINUTE THEN 'recovery' ELSE '' END
        FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1
    ) SELECT user_id, event_id, kind FROM w WHERE kind <> ''""",
)
def health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.alerts(_events(spark, sf_dir), ["user_id"], "ts", "event_id", _error_like()).select("user_id", "event_id", "kind")


@query(
    "greedy_lookback_dedup",
    """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
    w AS (
        SELECT user_id, event_type, event_id, k, ts AS anchor, false AS duplicate FROM o WHERE k = 1
        UNION ALL
        SELECT o.user_id, o.event_type, o.event_id, o.k, CASE WHEN o.ts - w.anchor <= INTERVAL 2880 MINUTE THEN w.anchor ELSE o.ts END, o.ts - w.anchor <= INTERVAL 2880 MINUTE
        FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.k = w.k + 1
    ) SELECT user_id, event_type, event_id, duplicate, anchor FROM w""",
)
def greedy_lookback_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ev.look_back(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 48 * 60)
    return done.select("user_id", "event_type", "event_id", "duplicate", F.col("anchor").cast("timestamp_ntz").alias("anchor"))


@query(
    "fact_set_dedup",
    """WITH RECURSIVE f AS (SELECT DISTINCT event_id, ts, unnest([user_id % 20, 100 + (event_id % 30)]) AS fact FROM events WHERE ts IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY ts, event_id) AS k FROM f),
    w AS (
        SELECT fact, event_id, k, ts AS anchor, false AS covered FROM o WHERE k = 1
        UNION ALL
        SELECT o.fact, o.event_id, o.k, CASE WHEN o.ts - w.anchor <= INTERVAL 720 MINUTE THEN w.anchor ELSE o.ts END, o.ts - w.anchor <= INTERVAL 720 MINUTE
        FROM w JOIN o ON o.fact = w.fact AND o.k = w.k + 1
    ) SELECT event_id, count(*)::BIGINT AS n_facts, count(*) FILTER (covered)::BIGINT AS n_covered, bool_and(covered) AS duplicate FROM w GROUP BY event_id""",
)
def fact_set_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _events(spark, sf_dir).select("event_id", "ts", F.explode(F.array(F.col("user_id") % 20, 100 + F.col("event_id") % 30)).alias("fact"))
    return ev.fact_set_duplicates(facts, "event_id", "fact", "ts", 720)


def _label() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ev.LABELS]), (F.col("event_id") % 3 + 1).cast("int"))

_LABEL_SQL = "(['high_value', 'duplicate', 'invalid'])[event_id % 3 + 1]"


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _events(spark, sf_dir).where("event_type <> 'purchase'").select("user_id", (F.col("event_id") % 97).alias("item"), "ts", "event_id", _label().alias("label"), F.array().cast("array<string>").alias("reasons"))
    return ev.feedback_state(clicks, ["item", "user_id"], ["ts"], "event_id", "label", "reasons")


_ACTIVE = f"""c AS (SELECT event_id % 97 AS item, user_id, {_LABEL_SQL} AS label, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
    active AS (SELECT item, user_id, bool_or(label = 'high_value' AND n % 2 = 1) AS hv, bool_or(label = 'duplicate' AND n % 2 = 1) AS du, bool_or(label = 'invalid' AND n % 2 = 1) AS inv FROM c GROUP BY ALL)"""


@query(
    "feedback_toggle_fold",
    f"""WITH {_ACTIVE} SELECT item, user_id, concat_ws(',', CASE WHEN hv THEN 'high_value' END, CASE WHEN du THEN 'duplicate' END, CASE WHEN inv THEN 'invalid' END) AS active_labels FROM active""",
)
def feedback_toggle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback(spark, sf_dir).select("item", "user_id", F.array_join("active_labels", ",").alias("active_labels"))


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered items (document, operator) with the labels the operator left active; two rules for each, one for some."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("item"), "source", "doc_id")
    labels = _feedback(spark, sf_dir).where("size(active_labels) > 0").groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("active_labels")))).alias("labels"))
    rules = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 2 == 0, F.array(F.lit("r1"), F.lit("r2"))).otherwise(F.array(F.lit("r3")))
    # Every third item counts as without feedback.
    few = labels.where("item % 3 <> 0")
    return docs.join(few, "item", "left").withColumn("rules", rules)


_DELIVERED = f"""{_ACTIVE}, lab AS (SELECT item, bool_or(hv) AS hv, bool_or(du) AS du, bool_or(inv) AS inv FROM active WHERE (hv OR du OR inv) AND item % 3 <> 0 GROUP BY item),
    dl AS (SELECT d.doc_id, d.source, coalesce(hv, false) AS hv, coalesce(du, false) AS du, coalesce(inv, false) AS inv,
           CASE WHEN doc_id % 5 = 0 THEN ['no_rule'] WHEN doc_id % 2 = 0 THEN ['r1', 'r2'] ELSE ['r3'] END AS rules FROM documents d LEFT JOIN lab ON lab.item = d.doc_id % 97)"""


def _quality_sql(key: str, source: str = "dl") -> str:
    return f"""WITH {_DELIVERED}, q AS (SELECT {key} AS key, count(*)::BIGINT AS delivered, count(*) FILTER (hv OR du OR inv)::BIGINT AS labelled, count(*) FILTER (hv)::BIGINT AS high_value,
        count(*) FILTER (du)::BIGINT AS duplicate, count(*) FILTER (inv)::BIGINT AS invalid FROM {source} GROUP BY 1)
        SELECT *, round(labelled / delivered, 4) AS coverage, labelled < 5 AS low_sample, CASE WHEN labelled > 0 THEN round(high_value / labelled, 4) ELSE 0 END AS high_value_rate,
        CASE WHEN labelled > 0 THEN round(duplicate / labelled, 4) ELSE 0 END AS duplicate_rate, CASE WHEN labelled > 0 THEN round(invalid / labelled, 4) ELSE 0 END AS invalid_rate FROM q"""


def _primary() -> Column:
    return F.coalesce(F.get("rules", 0), F.lit("no_rule"))



@query("feedback_quality_all", _quality_sql("'all'"))
def feedback_quality_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.quality(_delivered(spark, sf_dir), F.lit("all"), "labels")


@query("feedback_quality_by_source", _quality_sql("coalesce(source, 'unknown')"))
def feedback_quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.quality(_delivered(spark, sf_dir), F.col("source"), "labels")


@query("feedback_quality_by_primary_rule", _quality_sql("rules[1]"))
def feedback_quality_by_primary_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.quality(_delivered(spark, sf_dir), _primary(), "labels")


@query("feedback_quality_by_rule", _quality_sql("rule", "(SELECT *, unnest(rules) AS rule FROM dl)"))
def feedback_quality_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _delivered(spark, sf_dir).withColumn("rule", F.explode_outer("rules"))
    return ev.quality(each, F.coalesce("rule", F.lit("no_rule")), "labels")


@query("feedback_quality_by_source_rule", _quality_sql("coalesce(source, 'unknown') || ' x ' || rules[1]"))
def feedback_quality_by_source_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.quality(_delivered(spark, sf_dir), F.concat(F.coalesce("source", F.lit("unknown")), F.lit(" x "), _primary()), "labels")


@query(
    "overview_counts",
    """SELECT (SELECT count(*) FROM documents)::BIGINT AS n_items, count(*) FILTER (event_type = 'purchase')::BIGINT AS n_sent, count(*) FILTER (event_type = 'error')::BIGINT AS n_failed,
    count(DISTINCT user_id)::BIGINT AS n_sources, count(DISTINCT event_type)::BIGINT AS n_actions FROM events""",
)
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).agg(F.count_if(_sent()).alias("n_sent"), F.count_if(_failed()).alias("n_failed"), F.count_distinct("user_id").alias("n_sources"), F.count_distinct("event_type").alias("n_actions"))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_items")).join(counts)


@query("count_by_source", "SELECT CASE WHEN coalesce(source, '') = '' THEN 'unknown' ELSE source END AS source, count(*)::BIGINT AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 12")
def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")
    return table(spark, sf_dir, "documents").groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


def _rank() -> Column:
    return F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)



@query(
    "digest_ranked",
    """SELECT event_id, event_type, rank, row_number() OVER (ORDER BY rank, ts DESC, event_id DESC)::INT AS place
    FROM (SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS rank FROM events
          WHERE ts >= TIMESTAMP '2024-01-10 16:00:00' AND ts < TIMESTAMP '2024-01-11 16:00:00' AND event_type <> 'purchase') QUALIFY place <= 40""",
)
def digest_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One local day's undelivered rows, 40 at most: ranked actions first, then newest."""
    start, end = times.local_day_range("2024-01-11", "2024-01-11")
    day = _events(spark, sf_dir).where((F.col("ts") >= start) & (F.col("ts") < end) & ~_sent()).withColumn("rank", _rank())
    top = day.select("event_id", "event_type", "rank", "ts").orderBy("rank", F.desc("ts"), F.desc("event_id")).limit(40)
    place = F.row_number().over(Window.orderBy("rank", F.desc("ts"), F.desc("event_id")))
    return top.withColumn("place", place).select("event_id", "event_type", "rank", "place")


@query(
    "information_center_topk",
    f"""WITH {_REVIEWS}, r AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT d.doc_id, d.source, r.event_id AS review_id, r.event_type AS action FROM documents d JOIN r USING (doc_id)
    WHERE (contains(lower(d.source), 'src1') OR contains(lower(d.source), 'src2')) AND r.event_type IN ('click', 'view', 'error') AND contains(lower(d.lang || ' ' || d.source), 'e')
    ORDER BY r.ts DESC, d.doc_id DESC LIMIT 100""",
)
def information_center_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters before the limit, as a reader expects; the limit is the feature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    low = F.lower("source")
    wanted = docs.where((low.contains("src1") | low.contains("src2")) & F.lower(F.concat_ws(" ", "lang", "source")).contains("e"))
    joined = ver.with_current(wanted, _reviews(spark, sf_dir), "doc_id", "doc_id", ["ts", "event_id"], ["event_id", "event_type", "ts"], "inner")
    kept = joined.where(F.col("event_type").isin("click", "view", "error"))
    top = kept.orderBy(F.desc("ts"), F.desc("doc_id")).limit(100)
    return top.select("doc_id", "source", F.col("event_id").alias("review_id"), F.col("event_type").alias("action"))


_CUT = "2024-01-15"


@query(
    "incremental_watermark",
    f"""WITH w AS (SELECT event_type, max(ts) AS watermark FROM events WHERE ts < TIMESTAMP '{_CUT}' GROUP BY event_type)
    SELECT e.event_id, e.event_type FROM events e LEFT JOIN w USING (event_type) WHERE e.ts >= TIMESTAMP '{_CUT}' AND (w.watermark IS NULL OR e.ts > w.watermark)""",
)
def incremental_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    before, now = rows.where(F.col("ts") < F.lit(_CUT).cast("timestamp")), rows.where(F.col("ts") >= F.lit(_CUT).cast("timestamp"))
    state = before.groupBy("event_type").agg(F.max("ts").alias("watermark"))
    return ver.beyond_watermark(now, state, "event_type", "ts").select("event_id", "event_type")


@query(
    "first_run_baseline",
    """WITH d AS (SELECT *, ts::DATE AS day, min(ts::DATE) OVER (PARTITION BY user_id) AS first_day FROM events)
    SELECT user_id, count(*) FILTER (day = first_day)::BIGINT AS n_baseline, count(*) FILTER (day > first_day)::BIGINT AS n_live, min(first_day)::VARCHAR AS first_day FROM d GROUP BY user_id""",
)
def first_run_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's first day is its baseline; counts per day first, so the shuffle carries days, not events."""
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    firsts = F.min("day").over(Window.partitionBy("user_id"))
    marked = days.withColumn("first_day", firsts)
    return marked.groupBy("user_id").agg(F.sum(F.when(F.col("day") == F.col("first_day"), F.col("n")).otherwise(0)).alias("n_baseline"), F.sum(F.when(F.col("day") > F.col("first_day"), F.col("n")).otherwise(0)).alias("n_live"), F.min("first_day").cast("string").alias("first_day"))


@query(
    "ledger_new_items",
    f"""WITH l AS (SELECT DISTINCT user_id, props FROM events WHERE ts < TIMESTAMP '{_CUT}'), s AS (SELECT DISTINCT user_id FROM l),
    f AS (SELECT DISTINCT user_id, props FROM events WHERE ts >= TIMESTAMP '{_CUT}')
    SELECT f.user_id, f.props, s.user_id IS NULL AS is_baseline FROM f LEFT JOIN s ON s.user_id = f.user_id WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = f.user_id AND l.props = f.props)""",
)
def ledger_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "props", "ts")
    cut = F.lit(_CUT).cast("timestamp")
    ledger, found = rows.where(F.col("ts") < cut).select("user_id", "props"), rows.where(F.col("ts") >= cut).select("user_id", "props").distinct()
    return ver.admit_new(found, ledger, ["user_id", "props"], "user_id", F.lit(False)).select("user_id", "props", "is_baseline")


@query(
    "interval_audit_join",
    """WITH a AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT * FROM events WHERE event_type = 'error')
    SELECT a.event_id, count(b.event_id)::BIGINT AS n_audits, min(b.event_id) AS first_audit FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 6 HOUR GROUP BY a.event_id""",
)
def interval_audit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of the same user within six hours; both sides meet in six-hour blocks, so the join has an equality beyond the user."""
    rows = _events(spark, sf_dir)
    span = 6 * 3600
    block = F.floor(F.unix_timestamp("ts") / span)
    a = rows.where("event_type = 'click'").select("event_id", "user_id", "ts", F.explode(F.array(block, block + 1)).alias("block"))
    b = rows.where("event_type = 'error'").select(F.col("event_id").alias("audit"), "user_id", F.col("ts").alias("at"), block.alias("block"))
    met = a.join(b, ["user_id", "block"]).where((F.col("at") >= F.col("ts")) & (F.col("at") < F.col("ts") + F.expr("INTERVAL 6 HOURS")))
    found = met.groupBy("event_id").agg(F.count("*").alias("n_audits"), F.min("audit").alias("first_audit"))
    clicks = rows.where("event_type = 'click'").select("event_id")
    return clicks.join(found, "event_id", "left").select("event_id", F.coalesce("n_audits", F.lit(0)).alias("n_audits"), "first_audit")


@query("business_day_rollup", "SELECT (ts + INTERVAL 8 HOUR)::DATE::VARCHAR AS business_day, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users, (ts + INTERVAL 2 HOUR)::DATE = (ts + INTERVAL 8 HOUR)::DATE AS same_session FROM events GROUP BY ALL")
def business_day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, session = times.business_day(F.col("ts")), times.reaction_session(F.col("ts"))
    return _events(spark, sf_dir).groupBy(day.cast("string").alias("business_day"), (day == session).alias("same_session")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    "portfolio_diff",
    """WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) - 1 AS top FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' WHEN o.n = n.n AND o.top = n.top THEN 'same' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.o_custkey = n.o_custkey""",
)
def portfolio_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")

    def half(odd: int) -> DataFrame:
        return orders.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.count("*").alias("n"), (F.max("o_orderkey") - odd).alias("top"))

    return ver.difference(half(0), half(1), "o_custkey", ["n", "top"])


@query(
    "action_rank_max",
    """SELECT l_orderkey, arg_max(action, rank) AS action, count(*)::BIGINT AS n_rules FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'push' WHEN 'A' THEN 'daily' ELSE 'archive' END AS action,
    CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS rank FROM lineitem) GROUP BY l_orderkey""",
)
def action_rank_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(rank).alias("rank"), F.count("*").alias("n_rules"))
    return best.select("l_orderkey", F.element_at(F.array(F.lit("archive"), F.lit("daily"), F.lit("push")), F.col("rank") + 1).alias("action"), "n_rules")


@query(
    "wildcard_health_join",
    """WITH p AS (SELECT r_regionkey AS profile, unnest([r_name, CASE WHEN r_regionkey % 2 = 0 THEN '*' ELSE left(r_name, 1) || '*' END]) AS pattern FROM region)
    SELECT p.profile, p.pattern, count(n_nationkey)::BIGINT AS n_rows FROM p LEFT JOIN nation ON n_name = p.pattern OR p.pattern = '*' OR (p.pattern LIKE '%*' AND starts_with(n_name, left(p.pattern, length(p.pattern) - 1))) GROUP BY ALL""",
)
def wildcard_health_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys, prefixes and wildcards of a profile table; keys of each kind meet by an equality.

    A prefix meets the beginning of its own length, so no pair of rows is tried that cannot match.
    """
    name = F.col("r_name")
    pattern = F.explode(F.array(name, F.when(F.col("r_regionkey") % 2 == 0, "*").otherwise(F.concat(F.substring(name, 1, 1), F.lit("*")))))
    profiles = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("profile"), pattern.alias("pattern"))
    is_prefix = F.col("pattern").endswith("*")
    keyed = profiles.select("profile", "pattern", is_prefix.alias("prefix"), F.when(is_prefix, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern")).alias("k")).withColumn("size", F.when(F.col("prefix"), F.length("k")).otherwise(-1))
    nations = table(spark, sf_dir, "nation").select("n_name")
    sizes = keyed.select("size").distinct()
    offered = nations.join(sizes).select(F.col("size"), F.when(F.col("size") < 0, F.col("n_name")).otherwise(F.expr("left(n_name, size)")).alias("k"))
    hits = keyed.join(offered.groupBy("size", "k").agg(F.count("*").alias("n_rows")), ["size", "k"], "left")
    return hits.select("profile", "pattern", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("json_props_extract", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(
    "pages_until_known",
    """WITH p AS (SELECT *, max(CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met FROM conversations)
    SELECT conv_id, turn FROM p WHERE coalesce(met, 0) = 0""",
)
def pages_until_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ver.until_known(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", F.col("turn") % 4 == 3)


@query(
    "basis_reasons",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS reason FROM lineitem),
    f AS (SELECT l_orderkey, reason, min(l_linenumber) AS line FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, reason) AS k FROM f)
    SELECT l_orderkey, string_agg(reason, ',' ORDER BY line, reason) FILTER (k <= 4) AS reasons, greatest(count(*) - 4, 0)::BIGINT AS n_omitted FROM o GROUP BY l_orderkey""",
)
def basis_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct reasons in first-seen order, four at most, and how many more there were."""
    entry = F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("reason"))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["reason"])).alias("r"))
    return listed.select("l_orderkey", F.array_join(F.slice("r", 1, 4), ",").alias("reasons"), F.greatest(F.size("r") - 4, F.lit(0)).cast("long").alias("n_omitted"))
