"""Record readers, overlays and probes bound to the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import records as R
from quillstream.operators import item_mapping
from quillstream.operators import readmodels as M
from quillstream.plans.event_queries import _events
from quillstream.plans.text_queries import _SENTENCES, ITEMS, any_sql, items
from quillstream.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query(
    "report_title_metadata",
    r"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand || ' -' || p_name END || CASE WHEN p_partkey % 3 = 0 THEN ' 20240' || (1 + p_partkey % 9) || '15' ELSE '' END
        || CASE p_partkey % 5 WHEN 0 THEN ' 上调 buy' WHEN 1 THEN ' Initiating' WHEN 2 THEN ' 【' || p_size || '页】' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN ' target price to $ ' || p_size || '.5' ELSE '' END AS title FROM part)
    SELECT p_partkey, CASE WHEN contains(title, '-') AND trim(string_split(title, '-')[1]) <> '' THEN trim(string_split(title, '-')[1]) ELSE 'unknown' END AS institution,
        CASE WHEN regexp_matches(title, '20\d{6}') THEN regexp_replace(regexp_extract(title, '20\d{6}'), '(\d{4})(\d{2})(\d{2})', '\1-\2-\3') ELSE 'unknown' END AS report_date, regexp_extract(title, '【(\d+)页】', 1) AS pages,
        coalesce(nullif(replace(regexp_extract(title, '(?i)(?:目标价|target price|PT|tp)[^0-9€$￥¥]{0,16}([€$￥¥]?\s*\d+(?:\.\d+)?)', 1), ' ', ''), ''), 'unknown') AS target_price,
        CASE WHEN contains(lower(title), 'buy') THEN 'buy' WHEN contains(title, '上调') THEN 'upgrade' WHEN contains(lower(title), 'initiating') THEN 'initiate' ELSE 'unknown' END AS research_action FROM t""",
)
def report_title_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.concat(
        F.when(key % 4 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit(" -"), "p_name")), F.when(key % 3 == 0, F.concat(F.lit(" 20240"), (1 + key % 9).cast("string"), F.lit("15"))).otherwise(""),
        F.when(key % 5 == 0, " 上调 buy").when(key % 5 == 1, " Initiating").when(key % 5 == 2, F.concat(F.lit(" 【"), F.col("p_size").cast("string"), F.lit("页】"))).otherwise(""),
        F.when(key % 2 == 0, F.concat(F.lit(" target price to $ "), F.col("p_size").cast("string"), F.lit(".5"))).otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", R.report_title(text).alias("m")).select("p_partkey", "m.*")


@query(
    "author_targets",
    """SELECT c_custkey, 'c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',n' || c_nationkey ELSE '' END AS codes, (1 + (c_custkey % 2 = 0)::INT)::INT AS n FROM customer""",
)
def author_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, nation = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    value = F.concat(code, F.lit("@@"), F.col("c_name"), F.lit("## @@none##"), code, F.lit(" @@again"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("##"), nation)).otherwise(""))
    listed = table(spark, sf_dir, "customer").select("c_custkey", R.author_targets(value).alias("a"))
    return listed.select("c_custkey", F.array_join(F.transform("a", lambda x: x["code"]), ",").alias("codes"), F.size("a").alias("n"))


@query(
    "json_recovery",
    """SELECT event_id, CASE event_id % 9 WHEN 4 THEN NULL WHEN 6 THEN '{"s":"}{ \\"' || event_type || '", "p":' || props || '}' WHEN 7 THEN NULL WHEN 8 THEN '{"a":' || props || '}' ELSE props END AS found FROM events""",
)
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects alone, in fenced blocks, between other words, cut off, followed by others, with braces in strings, after a false start, and nested."""
    p, k, kind = F.col("props"), F.col("event_id") % 9, F.col("event_type")
    text = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("so:\n```json\n"), p, F.lit("\n```\nend"))).when(k == 2, F.concat(F.lit("```"), p, F.lit("``` }")))
        .when(k == 3, F.concat(F.lit("the answer is "), p, F.lit(" as said"))).when(k == 4, F.expr("left(props, length(props) - 1)")).when(k == 5, F.concat(F.lit("note "), p, F.lit(' then {"b":2} and more')))
        .when(k == 6, F.concat(F.lit('see {"s":"}{ \\"'), kind, F.lit('", "p":'), p, F.lit("} {"))).when(k == 7, F.concat(F.lit("x {a} y "), p, F.lit(" z"))).otherwise(F.concat(F.lit('it is {"a":'), p, F.lit("}!")))
    )
    return _events(spark, sf_dir).select("event_id", R.json_object(text).alias("found"))


_LINE_TERMS = ("apache", "queando", "nicht")


@query(
    "relevant_lines",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS raw, unnest(range(1, 1 + len(string_split(coalesce(text, ''), E'\n')))) AS k FROM documents),
    m AS (SELECT doc_id, trim(raw, E' \t\r\x0b\x0c 　') AS x, k FROM l WHERE {any_sql('raw', _LINE_TERMS)}), f AS (SELECT doc_id, lower(x) AS y, min(k) AS k FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM f)
    SELECT doc_id, coalesce(c, 0)::INT AS n_lines, h AS lines_hash FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c, sha256(string_agg(y, E'\n' ORDER BY n)) AS h FROM r WHERE n <= 6 GROUP BY doc_id) USING (doc_id)""",
)
def relevant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", R.relevant_lines(F.col("text"), _LINE_TERMS).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n_lines"), F.when(F.size("x") > 0, F.sha2(F.lower(F.array_join("x", "\n")), 256)).alias("lines_hash"))


_SAID = (("the", "der"), ("is", "ist", "es"), ("not", "nicht"))


@query(
    "attributed_sentences",
    f"""WITH {ITEMS}, {_SENTENCES} SELECT doc_id, len(list_filter(sentences, lambda x: ({any_sql('x', _SAID[0])}) AND ({any_sql('x', _SAID[1])}) AND NOT ({any_sql('x', _SAID[2])})))::INT AS n_sentences FROM s""",
)
def attributed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("doc_id", F.size(R.attributed_sentences(F.col("rule_text"), *_SAID)).alias("n_sentences"))


@query("display_time", """SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || ' (UTC+8; ' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC)' AS shown FROM events""")
def display_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", R.display_time(F.col("ts")).alias("shown"))


@query(
    "hit_precedence",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'explicit' WHEN event_type = 'error' THEN 'macro' WHEN event_id % 3 = 0 THEN 'move' WHEN value > 80 THEN 'bank' ELSE 'none' END AS kind FROM events""",
)
def hit_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity that a delivery is known by: the first kind that has one."""
    kinds = {"explicit": F.when(F.col("event_id") % 7 == 0, F.lit("key")), "macro": F.col("event_type") == "error", "move": F.col("event_id") % 3 == 0, "bank": F.col("value") > 80}
    return _events(spark, sf_dir).select("event_id", M.first_kind(kinds).alias("kind"))


@query(
    "detail_backfill",
    """WITH d AS (SELECT user_id, arg_max(props, struct_pack(a := ts, b := event_id)) FILTER (coalesce(props, '') <> '') AS fresh FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND fresh IS NOT NULL THEN fresh WHEN c_custkey % 3 = 0 THEN '-' ELSE c_name END AS title FROM customer LEFT JOIN d ON user_id = c_custkey""",
)
def detail_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored titles that are placeholders get the last detail that was read; others stay."""
    details = _events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("c_custkey"), F.col("props").alias("title"), "ts", "event_id")
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(F.col("c_name")).alias("title"))
    return M.backfilled(stored, details, "c_custkey", "title", ["ts", "event_id"])


@query(
    "profile_overlay",
    """WITH o AS (SELECT n_nationkey AS nk, 'over ' || n_name AS label, n_nationkey % 4 = 0 AS off FROM nation WHERE n_nationkey % 2 = 0)
    SELECT r_name AS category, count(*)::BIGINT AS n, count(*) FILTER (coalesce(off, false))::BIGINT AS n_disabled, min(coalesce(label, n_name)) AS first_label FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON nk = n_nationkey GROUP BY r_name""",
)
def profile_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with their overrides laid over them, counted by category."""
    base = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("category"), F.col("n_name").alias("label"))
    over = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.lit("over "), "n_name").alias("label"), (F.col("n_nationkey") % 4 == 0).alias("disabled"))
    laid = M.overlaid(base, over, "n_nationkey", ["label"])
    return laid.groupBy("category").agg(F.count("*").alias("n"), F.count_if("disabled").alias("n_disabled"), F.min("label").alias("first_label"))


@query(
    "delivered_rules",
    """WITH d AS (SELECT user_id, event_type AS rule, min(struct_pack(a := ts, b := event_id)) AS place FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value > 20 GROUP BY ALL)
    SELECT user_id, string_agg(rule, ',' ORDER BY place) AS rules FROM d GROUP BY user_id""",
)
def delivered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ids of what was delivered since a cut, each once, in the order of their first delivery."""
    rows = _events(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("value") > 20))
    return M.ordered_distinct(rows, ["user_id"], "event_type", ["ts", "event_id"], "rules").select("user_id", F.array_join("rules", ",").alias("rules"))


_CROSS = """WITH a AS (SELECT doc_id AS i, source AS s, trim(string_split(coalesce(text, ''), E'\\n')[1]) AS title, CASE WHEN n_chars % 9 < 4 THEN 'u' || n_chars ELSE '' END AS url, doc_id % 500 AS h FROM documents)"""
_EARLIER = "b.s <> a.s AND (b.h < a.h OR (b.h = a.h AND b.i < a.i))"


def _told_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of an hour, with addresses that some share."""
    url = F.when(F.col("n_chars") % 9 < 4, F.concat(F.lit("u"), F.col("n_chars").cast("string"))).otherwise("")
    hour = F.timestamp_seconds((F.col("doc_id") % 500) * 3600)
    return items(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", url.alias("url")), "doc_id").select("doc_id", "source", "title", "url", hour.alias("at"))


@query(
    "cross_source_duplicates",
    f"""{_CROSS}, u AS (SELECT a.i, arg_min(b.i, struct_pack(h := b.h, i := b.i)) AS d FROM a JOIN a b ON b.url = a.url AND a.url <> '' AND {_EARLIER} GROUP BY a.i),
    t AS (SELECT a.i, arg_min(b.i, struct_pack(h := b.h, i := b.i)) AS d FROM a JOIN a b ON b.title = a.title AND a.title <> '' AND {_EARLIER} GROUP BY a.i)
    SELECT a.i AS doc_id, coalesce(u.d, t.d) AS duplicate_of, CASE WHEN u.d IS NOT NULL THEN 'url' WHEN t.d IS NOT NULL THEN 'title' END AS by FROM a LEFT JOIN u ON u.i = a.i LEFT JOIN t ON t.i = a.i""",
)
def cross_source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first earlier item of another source with the same address, or else the same title."""
    return M.cross_source(_told_items(spark, sf_dir), "doc_id", "source", "title", "url", "at")


@query(
    "cross_source_within",
    f"""{_CROSS}, u AS (SELECT a.i, arg_max(b.i, struct_pack(h := b.h, i := b.i)) AS d, max(struct_pack(h := b.h, i := b.i)).h AS h FROM a JOIN a b ON b.url = a.url AND a.url <> '' AND {_EARLIER} AND a.s IN ('src1', 'src2', 'src3') AND b.s IN ('src1', 'src2', 'src3') GROUP BY a.i),
    t AS (SELECT a.i, arg_max(b.i, struct_pack(h := b.h, i := b.i)) AS d, max(struct_pack(h := b.h, i := b.i)).h AS h FROM a JOIN a b ON b.title = a.title AND a.title <> '' AND {_EARLIER} AND a.s IN ('src1', 'src2', 'src3') AND b.s IN ('src1', 'src2', 'src3') GROUP BY a.i)
    SELECT a.i AS doc_id, CASE WHEN a.h - u.h <= 72 THEN u.d WHEN a.h - t.h <= 72 THEN t.d END AS duplicate_of, CASE WHEN a.h - u.h <= 72 THEN 'url' WHEN a.h - t.h <= 72 THEN 'title' END AS by FROM a LEFT JOIN u ON u.i = a.i LEFT JOIN t ON t.i = a.i""",
)
def cross_source_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same between three sources, the last one at most 72 hours back."""
    return M.cross_source(_told_items(spark, sf_dir), "doc_id", "source", "title", "url", "at", ("src1", "src2", "src3"), 72)


@query(
    "holding_items",
    """WITH h AS (SELECT l_orderkey AS item, l_suppkey AS symbol, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)
    SELECT item, count(*)::BIGINT AS n_symbols, string_agg(symbol::VARCHAR, ',' ORDER BY line, symbol) AS symbols FROM h GROUP BY item""",
)
def holding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item that several holdings' pages list is one item with all their symbols, in listing order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("symbol"), F.col("l_linenumber").alias("line"))
    listed = M.ordered_distinct(rows, ["item"], "symbol", ["line"], "symbols")
    return listed.select("item", F.size("symbols").cast("long").alias("n_symbols"), F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols"))


@query(
    "nearest_preceding",
    """WITH e AS (SELECT event_id, user_id, event_type, ts, max(CASE WHEN event_type = 'view' THEN struct_pack(a := ts, b := event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events)
    SELECT event_id, CASE WHEN ts - p.a <= INTERVAL 48 HOUR THEN p.b END AS view_id FROM e WHERE event_type = 'purchase'""",
)
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each purchase the nearest view before it, if it is at most 48 hours back: an as-of join as one window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    p = F.last(F.when(F.col("event_type") == "view", F.struct("ts", "event_id")), ignorenulls=True).over(w)
    rows = _events(spark, sf_dir).select("event_id", "event_type", "ts", p.alias("p")).where("event_type = 'purchase'")
    return rows.select("event_id", F.when(F.col("ts") - F.col("p.ts") <= F.expr("INTERVAL 48 HOURS"), F.col("p.event_id")).alias("view_id"))


@query(
    "usage_by_provider",
    """SELECT event_type AS provider, count(*)::BIGINT AS attempts, count(*) FILTER (value > 95)::BIGINT AS failed, sum(event_id % 1000)::BIGINT AS tokens, CASE WHEN count(*) FILTER (value > 95) = 0 THEN 'ok' WHEN count(*) FILTER (value > 95) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY event_type""",
)
def usage_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.usage(_events(spark, sf_dir).withColumnRenamed("event_type", "provider"), ["provider"], F.col("value") > 95, F.col("event_id") % 1000)

@query(
    "mapped_items",
    """WITH p AS (SELECT page_id AS k, url, 'src' || page_id % 4 AS s FROM pages),
    m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'r' || k WHEN k % 3 = 1 THEN 'i' || k ELSE url END AS id FROM p)
    SELECT k AS page_id, s AS source, CASE WHEN k % 5 = 0 THEN 'own' WHEN s = 'src0' THEN 'news_media' WHEN s = 'src1' THEN 'official' WHEN s = 'src2' THEN 'portfolio_stock_news' ELSE '' END AS source_category, id AS item_id, 's ' || k AS title,
        CASE WHEN k % 2 = 0 THEN 'sum ' || k ELSE 'body' END AS summary, url, CASE WHEN k % 7 = 0 THEN 'A,B' ELSE '' END AS symbols, CASE WHEN k % 11 = 0 THEN 'given' || k ELSE s || ':' || id END AS dedupe_key, CASE s WHEN 'src0' THEN 'rss' WHEN 'src1' THEN 'api' ELSE s END AS collector FROM m""",
)
def mapped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw JSON rows of four sources, two with a profile and one with a default category."""
    k = F.col("page_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    raw = F.to_json(F.struct(
        F.when(k % 3 != 2, text("i", k)).alias("id"), F.when(k % 3 == 0, F.struct(text("r", k).alias("id"))).alias("raw"), text("  s  ", k).alias("title"), F.when(k % 2 == 0, text("sum ", k)).otherwise("").alias("summary"), F.lit("body").alias("content"), "url",
        F.when(k % 7 == 0, F.array(F.lit("A"), F.lit("B "), F.lit("A"))).alias("related_symbols"), F.when(k % 11 == 0, text("given", k)).alias("dedupe_key"), F.when(k % 5 == 0, "own").alias("source_category"),
    ))
    rows = table(spark, sf_dir, "pages").select("page_id", text("src", k % 4).alias("source"), raw.alias("raw"))
    profiles = spark.createDataFrame([("src0", "news_media", None, "rss"), ("src1", "official", "company", "api")], "source string, category string, role string, fetcher string")
    done = item_mapping.mapped_items(rows, "source", "raw", profiles, {"src2": "portfolio_stock_news"})
    return done.select("page_id", "source", "source_category", "item_id", "title", "summary", "url", F.array_join("symbols", ",").alias("symbols"), "dedupe_key", "collector")


@query(
    "stock_items",
    r"""WITH h AS (SELECT DISTINCT upper(s_name) AS symbol, 'N' || s_suppkey AS name FROM supplier), r AS (SELECT page_id, 'SUPPLIER#' || lpad((1 + page_id % 30)::VARCHAR, 9, '0') AS sym, url, CASE WHEN page_id % 3 = 0 THEN ' text ' || page_id ELSE '' END AS art FROM pages),
    j AS (SELECT r.*, name FROM r JOIN h ON symbol = sym)
    SELECT page_id, sym AS symbol, name || '（' || sym || '）相关新闻：P' || page_id AS summary, CASE WHEN trim(art) <> '' THEN trim(art) ELSE name || '（' || sym || '）相关新闻：P' || page_id END AS full_text, trim(art) <> '' AS fetched FROM j""",
)
def stock_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the news of suppliers: one item a row and holding."""
    k = F.col("page_id")
    symbol = F.concat(F.lit("Supplier#"), F.lpad((k % 30 + 1).cast("string"), 9, "0"))
    news = table(spark, sf_dir, "pages").select(symbol.alias("symbol"), F.concat(F.lit("P"), k.cast("string")).alias("title"), "url", F.lit("2024-01-01").alias("published_at"), F.when(k % 3 == 0, F.concat(F.lit(" text "), k.cast("string"))).alias("article_text"))
    held = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("symbol"), F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("name"))
    found = item_mapping.stock_items(news, held)
    return found.select(F.substring("title", 2, 20).cast("long").alias("page_id"), F.get("symbols", F.lit(0)).alias("symbol"), "summary", "full_text", "fetched")
