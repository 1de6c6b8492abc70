"""Event identities bound to texts made of the columns of ``orders``, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import company_events, macro_events, reservations
from quillstream.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


MACRO = macro_events.MacroConfig(
    country="US", country_terms=("u.s.",), indicators={"CPI": ("cpi",), "NONFARM": ("payrolls",)}, market_terms=("stocks",), direction_terms=("rose", "fell"), surprise_terms=("above expectations",),
    correction_terms=("correction",), counted=("NONFARM",), rate_terms=("year on year",), change_terms=("added",), forecast_terms=("forecast",), released_terms=("shock",), speaker_terms=("chair",), speech_verbs=("said",), impulses={"easing": ("cut",), "tightening": ("hike",)},
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note an order: a month, a gap of up to 69 characters, an indicator, and what the status says; urgent ones have a second claim."""
    month = F.date_format("o_orderdate", "MMMM")
    tail = F.when(F.col("o_orderstatus") == "F", " year on year 3.2%").when(F.col("o_orderstatus") == "O", " is due, stocks fell").otherwise(" above expectations, stocks rose")
    indicator = F.when(F.col("o_custkey") % 4 == 0, "payrolls").otherwise("CPI")
    second = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("; U.S. "), F.date_format(F.add_months("o_orderdate", 1), "MMM"), F.lit(" 2023 CPI year on year 1.0%"))).when(F.col("o_orderpriority") == "2-HIGH", "; correction").otherwise("")
    title = F.concat(F.lit("U.S. "), month, F.lit(" "), F.repeat(F.lit("-"), (F.col("o_orderkey") % 70).cast("int")), F.lit(" "), indicator, tail, second)
    return table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS 20 HOURS")).alias("published_at"))


@query(
    "macro_identities",
    """WITH n AS (SELECT o_orderkey, o_orderdate AS d, o_orderdate + INTERVAL 30 DAY + INTERVAL 20 HOUR AS p, o_orderstatus AS s, o_orderpriority = '1-URGENT' AS more, CASE WHEN o_custkey % 4 = 0 THEN 'NONFARM' ELSE 'CPI' END AS ind,
        length(strftime(o_orderdate, '%B')) + o_orderkey % 70 + 2 <= 48 AS near FROM orders WHERE o_orderpriority <> '2-HIGH'),
    f AS (SELECT *, CASE WHEN near THEN strftime(make_date((year(p) - CASE WHEN month(d) > month(p) + 1 THEN 1 ELSE 0 END)::BIGINT, month(d), 1), '%Y-%m') END AS own, '2023-' || strftime(d + INTERVAL 1 MONTH, '%m') AS other,
        near AND s = 'F' AND ind = 'CPI' AS own_value FROM n),
    g AS (SELECT *, CASE WHEN own_value THEN own WHEN more THEN other ELSE own END AS period, CASE WHEN own_value OR (near AND NOT more) THEN ind WHEN more THEN 'CPI' WHEN near THEN ind END AS indicator, own_value OR more AS actual,
        s <> 'F' AS reaction FROM f),
    h AS (SELECT *, reaction AND (actual OR s = 'P') AS released FROM g),
    x AS (SELECT o_orderkey, CASE WHEN released THEN 'market_reaction' WHEN period IS NULL THEN NULL WHEN actual THEN 'release' ELSE 'preview' END AS phase, CASE WHEN period IS NULL THEN ind ELSE indicator END AS indicator,
        CASE WHEN period IS NULL THEN strftime(date_trunc('month', p) - INTERVAL 1 MONTH, '%Y-%m') ELSE period END AS period, p FROM h)
    SELECT o_orderkey, phase, indicator, period, CASE WHEN phase = 'market_reaction' THEN strftime(p + INTERVAL 2 HOUR, '%Y-%m-%d') END AS session, 'macro:' || phase || ':US:' || indicator || ':' || period AS dedup_key,
        CASE WHEN phase = 'market_reaction' THEN array_to_string(list_transform([0, 1, 2], lambda k: 'macro:market_reaction:US:' || indicator || ':' || strftime(p + INTERVAL 2 HOUR - to_days(k::INTEGER), '%Y-%m-%d')), ',') ELSE '' END AS aliases, 129600::BIGINT AS minutes
    FROM x WHERE phase IS NOT NULL""",
)
def macro_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = macro_events.identities(notes(spark, sf_dir), MACRO, "o_orderkey", ("title",))
    return found.withColumn("aliases", F.array_join("aliases", ",")).drop("quote")


COMPANY = company_events.CompanyConfig(
    families={"price_change": ("price cut", "price hike"), "buyback": ("buyback",), "contract_order": ("contract",)}, metric_terms=("net profit",), forecast_terms=("guidance",), result_terms=("results",), correction_terms=("corrected",),
    stages={"terminated": ("terminated",), "completed": ("completed",)}, proposed_terms=("plans to",), turns={"price_change": (("price cut",), "down", "up")}, action_terms=("announces",), object_terms=("GPU", "SSD"),
    legal_forms=(" inc.", " corp"), no_names=("Firm7",), broad=("buyback",), short=("price_change",),
)


def company_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims an order: a firm with what the priority and the status say, and another firm's buyback."""
    p, s, k = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")
    what = F.when(p == "1-URGENT", "net profit guidance for the first half").when(p == "2-HIGH", F.when(k % 2 == 0, "price cut on SSD and GPU").otherwise("price hike")).when(p == "3-MEDIUM", F.concat(F.lit("contract worth "), (k % 3).cast("string"), F.lit("元, 5% more")))
    tail = F.when(s == "F", ", corrected").when(s == "P", ", completed").otherwise("")
    firm = F.concat(F.lit("Firm"), (F.col("o_custkey") % 40).cast("string"), F.when(k % 4 == 0, " Inc.").otherwise(""))
    title = F.concat(firm, F.lit(" announces "), F.coalesce(what, F.lit("nothing")), tail)
    other = F.concat(F.lit("Firm"), (k % 30).cast("string"), F.lit(" corp announces buyback"))
    return table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), other.alias("summary"), F.col("o_orderdate").alias("published_at"))


@query(
    "company_identities",
    """WITH n AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, 'Firm' || o_custkey % 40 AS firm, 'Firm' || o_orderkey % 30 AS other, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y') || '-H1' AS half FROM orders),
    a AS (SELECT k, firm AS company, CASE p WHEN '1-URGENT' THEN 'earnings' WHEN '2-HIGH' THEN 'price_change' ELSE 'contract_order' END AS family, CASE WHEN p = '1-URGENT' THEN half ELSE day END AS reference,
        CASE WHEN p = '1-URGENT' THEN '' WHEN p = '2-HIGH' THEN 'gpu|ssd' ELSE (k % 3) || '元|5%' END AS scope, s, p, k % 2 AS odd FROM n WHERE p IN ('1-URGENT', '3-MEDIUM') OR (p = '2-HIGH' AND k % 2 = 0)),
    b AS (SELECT *, CASE WHEN s = 'F' THEN 'revision-' || substr(sha256(CASE WHEN p = '3-MEDIUM' THEN scope ELSE lower(company) || CASE WHEN k % 4 = 0 THEN ' inc.' ELSE '' END || ' announces ' || CASE WHEN p = '1-URGENT' THEN 'net profit guidance for the first half' ELSE 'price cut on ssd and gpu' END || ', corrected' END), 1, 10)
        WHEN s = 'P' THEN 'completed' WHEN p = '1-URGENT' THEN 'forecast' WHEN p = '2-HIGH' THEN 'down' ELSE 'announced' END AS stage FROM a),
    u AS (SELECT k, company, family, reference, stage, scope FROM b UNION SELECT k, other, 'buyback', day, 'announced', '' FROM n)
    SELECT k AS o_orderkey, company, family, reference, stage, scope, 'company_event:' || lower(company) || ':' || family || ':' || reference || ':' || CASE WHEN scope = '' THEN 'general' ELSE substr(sha256(scope), 1, 12) END || ':v:' || stage AS dedup_key,
        (CASE WHEN family = 'price_change' THEN 43200 ELSE 129600 END)::BIGINT AS minutes FROM u WHERE company <> 'Firm7'""",
)
def company_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = company_events.identities(company_notes(spark, sf_dir), COMPANY, "o_orderkey", ("title", "summary"))
    return found.select("o_orderkey", "company", "family", "reference", "stage", F.array_join("scope", "|").alias("scope"), "dedup_key", "minutes")


@query(
    "company_fact_sets",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS k, 'Firm' || o_orderkey % 30 AS other, epoch_us(o_orderdate) AS t, date_trunc('day', o_orderdate + INTERVAL 8 HOUR) AS day FROM orders WHERE o_orderkey % 30 <> 7),
    f AS (SELECT k, other, day, row_number() OVER (PARTITION BY other, day ORDER BY t, k::VARCHAR) AS n FROM n)
    SELECT k AS o_orderkey, CASE WHEN n = 1 THEN 'reserved' ELSE 'duplicate' END AS status, CASE WHEN n > 1 THEN first_value(k) OVER (PARTITION BY other, day ORDER BY n) END AS first_event FROM f""",
)
def company_fact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's second claim alone: its identities go to the reservations as one set of facts."""
    notes_ = company_notes(spark, sf_dir)
    found = company_events.identities(notes_, COMPANY, "o_orderkey", ("summary",))
    hits = found.groupBy("o_orderkey").agg(F.collect_list(reservations.hit(F.lit(company_events.RULE), F.col("dedup_key"), F.array().cast("array<string>"), F.col("minutes"))).alias("hits"))
    items = hits.join(notes_.select("o_orderkey", "published_at"), "o_orderkey").withColumn("outcome", F.lit("sent"))
    return reservations.reserve_sets(items, "published_at", "o_orderkey", "hits", "outcome").select("o_orderkey", "status", "first_event")
