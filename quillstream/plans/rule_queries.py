"""Rule columns and table rules bound to the driver's tables, each with its SQL.

Inputs that the tables lack are made from their columns by an expression that both sides share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import market as M
from quillstream.functions import rules as U
from quillstream.operators import readmodels
from quillstream.plans.event_queries import _events
from quillstream.plans.text_queries import ITEMS, items
from quillstream.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_ARTICLE = "CASE event_id % 5 WHEN 0 THEN 'comos:' || user_id WHEN 1 THEN 'https://a.example/doc-ik' || user_id || '.shtml' WHEN 2 THEN ' detail-i' || user_id || 'z.d.html?x=1' WHEN 3 THEN '' ELSE ' ' || event_type || ' ' END"


@query(
    "article_id",
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN 'k' || user_id WHEN 2 THEN user_id || 'z' ELSE trim({_ARTICLE}) END AS article FROM events""",
)
def article_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", U.article_id(F.expr(_ARTICLE)).alias("article"))


_PDF = "CASE WHEN event_id % 3 = 1 THEN 'https://a.example/d/' || event_id || '.PDF?v=2' ELSE 'https://a.example/x.pdf' END"


@query(
    "disclosure_identity",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'announcement:' || user_id WHEN event_id % 3 = 1 THEN 'announcement:' || regexp_extract({_PDF}, '/(\\d+)\\.PDF', 1)
        ELSE 'disclosure:' || left(sha256('S' || user_id || E'\\n' || 'the ' || event_type || E'\\n' || '2024-01-01'), 32) END AS identity FROM events""",
)
def disclosure_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By official id, by the number of the PDF, or by symbol, title and day."""
    official = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string")))
    symbol, title = F.concat(F.lit("s"), F.col("user_id").cast("string")), F.concat(F.lit(" The  "), F.upper("event_type"), F.lit(" "))
    return _events(spark, sf_dir).select("event_id", U.disclosure_identity(official, F.expr(_PDF), symbol, title, F.lit("2024-01-01")).alias("identity"))


_NAMES, _BUSINESS, _OUT = ("blush thistle", "Green"), ("blue", "lace"), ("red", "navajo")
_FLAT = "upper(replace(p_name, ' ', ''))"


def _flat_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({_FLAT}, '{w.replace(' ', '').upper()}')" for w in words) + ")"


@query(
    "holding_relevance",
    f"""SELECT p_partkey, r AS reason, r IN ('direct_mention', 'business_keyword') AS relevant FROM (SELECT p_partkey,
        CASE WHEN {_flat_sql(_NAMES)} THEN 'direct_mention' WHEN {_flat_sql(_OUT)} THEN 'excluded_keyword' WHEN {_flat_sql(_BUSINESS)} THEN 'business_keyword' ELSE 'needs_llm_relevance' END AS r FROM part)""",
)
def holding_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.relevance(F.col("p_name"), "600000", _NAMES, _BUSINESS, _OUT)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.reason", "f.relevant")


_NOTICE = "CASE p_partkey % 5 WHEN 0 THEN ' Brand X： ' || p_name WHEN 1 THEN 'brandx:' || p_name WHEN 2 THEN 'other：' || p_name || ' BRANDX:' WHEN 3 THEN p_name || ' 年报' ELSE p_name END"


@query("announcement_like", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS announcement FROM part")
def announcement_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", U.announcement_like(F.expr(_NOTICE), ("Brand X",), ("公告", "年报")).alias("announcement"))


@query("generated_content", "SELECT doc_id, doc_id % 3 = 0 AS generated FROM documents")
def generated_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with a note at their end, across tags and blanks, or with a note that lacks a word."""
    note = F.when(F.col("doc_id") % 3 == 0, "<p>内容 由<b>ai</b>　生成</p>").otherwise("<p>内容由 人 生成</p>")
    return table(spark, sf_dir, "documents").select("doc_id", U.generated(F.concat(F.coalesce("text", F.lit("")), note)).alias("generated"))


_POST = "CASE event_id % 6 WHEN 0 THEN ' https://X.com/a/status/' || event_id || '/photo/1' WHEN 1 THEN 'https://www.twitter.com/b/status/' || event_id || '/?s=20' WHEN 2 THEN 'https://x.com/c' WHEN 3 THEN 'https://y.com/c/status/1' WHEN 4 THEN 'x.com/c/status/1' ELSE '' END"


@query("post_link_kind", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x_photo' WHEN 1 THEN 'x_status' ELSE '' END AS kind FROM events")
def post_link_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", U.post_link_kind(F.expr(_POST)).alias("kind"))


_ERROR = "CASE event_id % 7 WHEN 0 THEN 'Timed out' WHEN 1 THEN 'HTTP 403 and a timeout' WHEN 2 THEN 'errno 111' WHEN 3 THEN 'Connection Reset by peer' WHEN 4 THEN 'Maximum allowed connection limit' ELSE event_type END"
_CODE = "CASE WHEN event_id % 11 = 0 THEN 429 WHEN event_id % 11 = 1 THEN 503 WHEN event_id % 11 = 2 THEN 200 END"


@query(
    "stream_errors",
    f"""WITH e AS (SELECT lower({_ERROR}) AS x, coalesce({_CODE}, 0) AS c FROM events), k AS (SELECT CASE WHEN c = 429 OR contains(x, 'maximum allowed') THEN 'too_many_connections' WHEN contains(x, 'http 403') THEN 'auth'
        WHEN contains(x, 'errno 111') THEN 'proxy_refused' WHEN contains(x, 'timed out') THEN 'timeout' WHEN c = 503 THEN 'x_api_unavailable' WHEN contains(x, 'connection reset') THEN 'connection_reset' ELSE 'connect_error' END AS kind FROM e)
    SELECT kind, kind IN ('too_many_connections', 'auth') AS immediate, count(*)::BIGINT AS n FROM k GROUP BY ALL""",
)
def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(U.stream_error(F.expr(_ERROR), F.expr(_CODE), "connect").alias("e")).select("e.*")
    return rows.groupBy("kind", "immediate").agg(F.count("*").alias("n"))


@query(
    "article_url",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://a.example/' || user_id WHEN 1 THEN 'https://b.example/' || user_id WHEN 2 THEN 'https://c.example/' || event_id || '?os=web' ELSE '' END AS url FROM events""",
)
def article_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address that a row has, else one made of its id, else none."""
    k, user, event = F.col("event_id") % 4, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    addresses = (F.when(k == 0, F.concat(F.lit(" https://a.example/"), user)).otherwise(" "), F.when(k < 2, F.concat(F.lit("https://b.example/"), user)))
    return _events(spark, sf_dir).select("event_id", U.article_url(addresses, F.when(k == 2, event), "https://c.example/", "?os=web").alias("url"))


@query(
    "context_line",
    f"""WITH {ITEMS}, w AS (SELECT doc_id, lang, list_filter(string_split(title, ' '), lambda x: x <> '')[1:8] AS names FROM items)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN len(names) > 0 THEN '涉及标的：' || array_to_string(names, '、') END, CASE WHEN doc_id % 2 = 0 AND lang <> '' THEN '标签：' || lang END], lambda x: x IS NOT NULL), '；') AS line FROM w""",
)
def context_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lists of names, eight each."""
    groups = (("涉及标的", F.split("title", " ")), ("专题", F.lit(None).cast("array<string>")), ("标签", F.when(F.col("doc_id") % 2 == 0, F.array("lang"))))
    return items(spark, sf_dir).select("doc_id", U.context_line(groups).alias("line"))


_THEMES = {"colour": ("blue", "lace", "green"), "metal": ("steel", "brass", "tin"), "size": ("p", "lemon chiffon")}


def _theme_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9]){w}($|[^a-z0-9])')" if " " not in w else f"contains(lower(p_name || ' ' || p_type), '{w}')" for w in words) + ")"


@query(
    "theme_detect",
    f"""SELECT p_partkey, concat_ws(',', CASE WHEN c THEN 'colour' END, CASE WHEN m AND (NOT c OR b) THEN 'metal' END, CASE WHEN s THEN 'size' END) AS themes
    FROM (SELECT p_partkey, {_theme_sql(_THEMES['colour'])} AS c, {_theme_sql(_THEMES['metal'])} AS m, {_theme_sql(_THEMES['size'])} AS s, {_theme_sql(('brass',))} AS b FROM part)""",
)
def theme_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the theme of colours, metals count only with brass."""
    found = U.themes(F.concat_ws(" ", "p_name", "p_type"), _THEMES, ("colour", "metal", ("brass",)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("themes"))


_POLICY = "CASE event_id % 4 WHEN 0 THEN 'A Rate Cut would boost gold' WHEN 1 THEN 'Dovish talk may support gold and bonds' WHEN 2 THEN 'rate hike' ELSE 'lower rates: a tailwind' END || CASE event_id % 3 WHEN 0 THEN ' correction' WHEN 1 THEN '' ELSE ' ' || event_type END"


@query(
    "policy_transmission",
    f"""SELECT event_id, event_id % 4 < 2 AND event_id % 3 > 0 AND event_type <> 'error' OR event_id % 4 < 2 AND event_id % 3 = 1 AS matched, CASE event_id % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'gold,bonds' ELSE '' END AS assets,
        CASE event_id % 4 WHEN 0 THEN 'Rate Cut would boost' WHEN 1 THEN 'Dovish talk may support' WHEN 2 THEN '' ELSE 'lower rates: a tailwind' END AS quote,
        concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'correction' END, CASE WHEN event_id % 3 = 2 AND event_type = 'error' THEN 'error' END) AS exceptions FROM events""",
)
def policy_transmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(_POLICY)
    impulse = M.impulse(text, ("rate cut", "lower rates", "dovish"), ("rate hike", "hawkish"))
    relation = r"(?:rate cuts?|lower rates|monetary easing|dovish).{0,48}(?:benefit|boost|support|bullish|tailwind|weigh on)"
    found = U.transmission(text, impulse, ("gold", "bonds"), (relation,), (("correction", "correction|corrected"), ("error", "error")))
    rows = _events(spark, sf_dir).select("event_id", found.alias("t"))
    return rows.select("event_id", "t.matched", F.array_join("t.assets", ",").alias("assets"), "t.quote", F.array_join("t.exceptions", ",").alias("exceptions"))


@query(
    "link_summary",
    f"""WITH {ITEMS}, b AS (SELECT doc_id, trim(title, E' \\t\\r\\x0b\\x0c 　') AS t, trim(body, E' \\n\\t\\r\\x0b\\x0c 　') AS b FROM items), s AS (SELECT doc_id, '链接 1: https://a.example/' || doc_id || CASE WHEN t <> '' THEN E'\\n标题：' || t ELSE '' END || CASE WHEN b <> '' THEN E'\\n正文摘录：' || CASE WHEN length(b) > 2200 THEN left(b, 2197) || '...' ELSE b END ELSE '' END
        || CASE WHEN doc_id % 2 = 0 THEN E'\\n\\n链接 2: \\n抓取状态：unknown；' || CASE WHEN doc_id % 4 = 0 THEN 'timeout' ELSE '无正文' END ELSE '' END AS x FROM b)
    SELECT doc_id, length(x)::INT AS n_chars, sha256(CASE WHEN length(x) > 9000 THEN left(x, 8997) || '...' ELSE x END) AS summary_hash FROM s""",
)
def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link with its title and text, and for every second item one that could not be read."""
    kind = "array<struct<url:string,title:string,description:string,text:string,status:string,error:string>>"
    none = F.lit(None).cast("string")
    link = lambda url, title, text, status, error: F.struct(url.alias("url"), title.alias("title"), none.alias("description"), text.alias("text"), status.alias("status"), error.alias("error"))
    read = link(F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string")), F.col("title"), F.col("body"), F.lit("ok"), none)
    failed = link(none, none, none, none, F.when(F.col("doc_id") % 4 == 0, "timeout"))
    links = F.when(F.col("doc_id") % 2 == 0, F.array(read, failed)).otherwise(F.array(read)).cast(kind)
    whole = items(spark, sf_dir).select("doc_id", U.link_summary(links, total=1_000_000_000).alias("whole"), U.link_summary(links).alias("cut"))
    return whole.select("doc_id", F.length("whole").alias("n_chars"), F.sha2("cut", 256).alias("summary_hash"))


@query(
    "preview_selector",
    """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN 'retry' WHEN doc_id % 5 IN (2, 3) THEN 'unpushed' ELSE 'done' END AS state FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, state ORDER BY doc_id) AS n FROM d) SELECT doc_id, state FROM r WHERE state IN ('new', 'retry') OR state = 'unpushed' AND n <= 30 OR doc_id = 9""",
)
def preview_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items, those to retry, the first 30 unpushed ones of each source, and the one that was asked for."""
    k = F.col("doc_id") % 5
    state = F.when(k == 0, "new").when(k == 1, "retry").when(k.isin(2, 3), "unpushed").otherwise("done")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", state.alias("state"))
    return readmodels.preview_selection(docs, "doc_id", "source", "state", 30, [9])


@query(
    "missing_securities",
    """SELECT n_nationkey, count(*)::BIGINT AS n_symbols, count(*) FILTER (s_suppkey IS NULL)::BIGINT AS n_missing, min(c_custkey) FILTER (s_suppkey IS NULL) AS first_missing
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey % 2 = 0 GROUP BY n_nationkey""",
)
def missing_securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes looked up in a cache of securities, and what the cache lacks."""
    cache = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("c_custkey"))
    held = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    return readmodels.missing(held, cache, "c_custkey", ["n_nationkey"])


@query(
    "config_equality",
    """WITH c AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS nk FROM supplier WHERE s_suppkey % 10 <> 0)
    SELECT CASE WHEN k IS NULL THEN 'only_table' WHEN s.s_name = c.s_name AND s_nationkey IS NOT DISTINCT FROM nk THEN 'equal' ELSE 'differs' END AS state, count(*)::BIGINT AS n FROM supplier s LEFT JOIN c ON s_suppkey = k GROUP BY 1""",
)
def config_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stored table says what the configuration says, row by row and null-safe."""
    stored = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    config = stored.where("s_suppkey % 10 <> 0").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")))
    return readmodels.compared(stored, config, "s_suppkey", ["s_name", "s_nationkey"]).groupBy("state").agg(F.count("*").alias("n"))


_RAW = "p_name || CASE p_partkey % 3 WHEN 0 THEN ' *_x ' WHEN 1 THEN '   ' ELSE '' END || p_type"


@query(
    "card_text",
    f"""WITH t AS (SELECT p_partkey, trim(regexp_replace({_RAW}, ' +', ' ', 'g')) AS x FROM part) SELECT p_partkey, replace(replace(CASE WHEN length(x) > 40 THEN left(x, 37) || '...' ELSE x END, '*', '\\*'), '_', '\\_') AS card FROM t""",
)
def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut for a card, then escaped."""
    return table(spark, sf_dir, "part").select("p_partkey", U.card_escape(U.shortened(F.expr(_RAW), 40)).alias("card"))


@query(
    "post_normalize",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id END::VARCHAR AS id, CASE event_id % 3 WHEN 0 THEN '@u' || user_id WHEN 1 THEN 'N ' || event_type ELSE 'X' END AS author,
        left(props || CASE WHEN event_id % 4 = 0 THEN E'\n\n引用推文：' || event_type || '；other' ELSE '' END, 20) AS summary FROM events WHERE event_id % 5 > 0 AND trim(coalesce(props, '')) <> ''""",
)
def post_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as items; those without address or text give none."""
    e, k = F.col("event_id"), F.col("event_id") % 3
    url = F.when(e % 5 > 0, F.concat(F.lit("https://x.com/a/status/"), e.cast("string")))
    user, name = F.when(k == 0, F.concat(F.lit(" @u"), F.col("user_id").cast("string"))), F.when(k == 1, F.concat(F.lit("N  "), F.col("event_type")))
    quoted = F.when(e % 4 == 0, F.array(F.col("event_type"), F.lit(" other "), F.col("event_type"), F.lit("")))
    found = U.post_item(url, F.when(e % 2 == 0, F.col("user_id").cast("string")), F.col("props"), user, name, quoted, 20)
    return _events(spark, sf_dir).select("event_id", found.alias("p")).where("p IS NOT NULL").select("event_id", "p.id", "p.author", "p.summary")


@query(
    "feedback_examples",
    """WITH l AS (SELECT user_id, event_type, max(ts) AS newest FROM events WHERE value > 30 GROUP BY ALL)
    SELECT user_id, string_agg(CASE WHEN event_type = 'error' THEN 'invalid (late)' ELSE event_type END, ', ' ORDER BY event_type) AS labels, strftime(max(newest), '%Y-%m-%d %H:%M:%S') AS feedback_at FROM l GROUP BY user_id ORDER BY max(newest) DESC, user_id LIMIT 100""",
)
def feedback_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred items with the newest feedback and their labels, one of them with its reason."""
    label = F.when(F.col("event_type") == "error", "invalid (late)").otherwise(F.col("event_type"))
    top = readmodels.recent_examples(_events(spark, sf_dir).where("value > 30"), "user_id", "event_type", label, "ts")
    return top.select("user_id", F.array_join("labels", ", ").alias("labels"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("feedback_at"))


@query(
    "profile_counts",
    """WITH p AS (SELECT c_mktsegment AS category, count(*)::BIGINT AS n, count(*) FILTER (c_custkey % 4 = 0)::BIGINT AS n_disabled, count(*) FILTER (c_acctbal < 0)::BIGINT AS n_failing FROM customer GROUP BY 1)
    SELECT k AS place, c AS category, coalesce(n, 0) AS n, coalesce(n_disabled, 0) AS n_disabled, coalesce(n_failing, 0) AS n_failing FROM (VALUES (0, 'MACHINERY'), (1, 'BUILDING'), (2, 'NONE')) o(k, c) LEFT JOIN p ON c = category""",
)
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles, disabled and failing ones by category, in a fixed order of categories, also those without profiles."""
    flags = {"n_disabled": F.col("c_custkey") % 4 == 0, "n_failing": F.col("c_acctbal") < 0}
    return readmodels.counts_by_category(table(spark, sf_dir, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING", "NONE"], flags)