"""Text operators bound to the tables ``documents`` and ``pages``, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import web
from quillstream.operators import admission, titles
from quillstream.operators.admission import Corridor, Holding, RuleConfig
from quillstream.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: The configuration of the bound queries: terms that the synthetic texts hold.
CONFIG = RuleConfig(
    version="bound-1",
    topics=("licensed", "ouan", "stion", "version 2.0"),
    title_topics=("ouan",),
    indicators=("and", "und"),
    contexts=("shorn", "token", "password"),
    policy_terms=("apache", "cc by"),
    corridors=(Corridor("main", ("the",), ("thion", "anthe"), ("by-nc",)),),
    trade_actions=("is", "under"),
    excluded=("trash", "scum"),
    holdings=(Holding("ES.1", ("queando", "apache license"), ("para", "con"), ("los",)), Holding("DE.2", ("nicht",), ("eine",), ("der",))),
    holding_only_sources=("src7", "src8"),
    official_sources=("src3",),
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, the rest the body."""
    docs = table(spark, sf_dir, "documents")
    text = T.text_of(F.col("text"))
    title = F.split(text, "\n")[0]
    body = F.substr(text, F.length(title) + 2)
    return docs.select("doc_id", "source", "lang", title.alias("title"), body.alias("body")).withColumn("rule_text", T.rule_text(F.col("title"), F.col("body")))


ITEMS = """items AS (
    SELECT doc_id, source, lang, string_split(coalesce(text, ''), E'\\n')[1] AS title,
           substr(coalesce(text, ''), length(string_split(coalesce(text, ''), E'\\n')[1]) + 2) AS body
    FROM documents
), i AS (SELECT *, array_to_string(list_filter([title, body], lambda x: x <> ''), E'\\n') AS rule_text FROM items)"""


@query("normalize_text", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g')) AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("normalized"))


@query("content_hash", r"""SELECT doc_id, sha256(array_to_string(list_filter([trim(coalesce(source, ''), E' \n\t\r'), trim(coalesce(text, ''), E' \n\t\r')], lambda x: x <> ''), E'\n')) AS content_hash FROM documents""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query(
    "dedupe_key",
    r"""SELECT page_id, 'pages:' || CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR WHEN page_id % 3 = 1 THEN url
        ELSE substr(sha256(concat_ws(E'\n', 'pages', 'html', coalesce(url, ''), '')), 1, 24) END AS dedupe_key FROM pages""",
)
def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id") % 3
    item_id, url = F.when(n == 0, F.col("page_id").cast("string")), F.when(n == 1, F.col("url"))
    return pages.select("page_id", T.dedupe_key(F.lit("pages"), item_id, url, F.lit("html"), F.col("url"), F.lit("")).alias("dedupe_key"))


_PARTS = r"""p AS (
    SELECT page_id, coalesce(url, '') AS u, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(u, '://([^/?#]*)', 1) AS host,
           regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS q, regexp_extract(u, '#(.*)$', 1) AS frag,
           list_transform(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) AS pairs
    FROM pages
)"""


@query(
    "canonical_url_a",
    f"""WITH {_PARTS}, k AS (SELECT *, array_to_string(list_filter(pairs, lambda x: string_split(x, '=')[1] NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'from')), '&') AS kept FROM p)
    SELECT page_id, lower(scheme) || '://' || host || path || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || CASE WHEN frag = '' THEN '' ELSE '#' || frag END AS canonical FROM k""",
)
def canonical_url_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_a(F.col("url")).alias("canonical"))


@query(
    "canonical_url_b",
    f"""WITH {_PARTS}, k AS (SELECT *, array_to_string(list_filter(pairs, lambda x: NOT regexp_matches(lower(string_split(x, '=')[1]), '^(utm_.*|spm.*|from|source|cre|mod|loc|r|sec|sudaref|display|retcode)$')), '&') AS kept FROM p)
    SELECT page_id, lower(scheme) || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM k""",
)
def canonical_url_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_b(F.col("url")).alias("canonical"))


@query(
    "canonical_url_c",
    f"""WITH {_PARTS} SELECT page_id, lower(scheme) || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM p""",
)
def canonical_url_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_c(F.col("url")).alias("canonical"))


@query(
    "url_item_id",
    f"""WITH {_PARTS} SELECT page_id, trim(path, '/') AS path_id, regexp_extract(trim(path, '/'), '([^/]*)$', 1) AS last_segment, regexp_extract(path, '(\\d{{4,}})(?:\\D*)$', 1) AS page_number, lower(host) AS host FROM p""",
)
def url_item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", web.path_id(u).alias("path_id"), web.last_segment(u).alias("last_segment"), web.number_in_path(u).alias("page_number"), web.host(u).alias("host"))


_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&#39;', ''''), '&#x27;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _strip_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<script.*?</script>|<style.*?</style>', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', E'\\n', 'g'), '(?i)</p>', E'\\n\\n', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]+>', '', 'g')"
    return f"regexp_replace({_UNESCAPE.format(x)}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _collapsed_sql(x: str) -> str:
    return f"trim(regexp_replace({_strip_sql(x)}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _meta_sql(name: str) -> str:
    tag = f"regexp_extract(coalesce(html, ''), '(?is)<meta\\b[^>]*\\b(?:name|property)\\s*=\\s*[\"'']{name}[\"''][^>]*>')"
    return f"regexp_extract({tag}, '(?is)\\bcontent\\s*=\\s*[\"'']([^\"'']*)', 1)"


@query(
    "html_title",
    f"""SELECT page_id, coalesce({', '.join(f"nullif({_collapsed_sql(x)}, '')" for x in (_meta_sql('og:title'), _meta_sql('twitter:title'), "regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)", "regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1)"))}, '') AS title FROM pages""",
)
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query("html_strip", f"SELECT page_id, sha256({_strip_sql("coalesce(html, '')")}) AS text_sha256 FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(web.strip_tags(F.col("html")), 256).alias("text_sha256"))


@query(
    "html_paragraph_body",
    f"""WITH p AS (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {_strip_sql("x")}) AS ps FROM pages),
    k AS (SELECT page_id, list_filter(ps, lambda x: length(x) > 40 AND NOT regexp_matches(lower(x), '^(copyright|related|for more information)') AND NOT contains(lower(x), 'cookie')) AS kept FROM p)
    SELECT page_id, len(kept)::BIGINT AS n_paragraphs, sha256(array_to_string(kept, E'\\n\\n')) AS body_sha256 FROM k""",
)
def html_paragraph_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = web.paragraphs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(kept).cast("long").alias("n_paragraphs"), F.sha2(F.array_join(kept, "\n\n"), 256).alias("body_sha256"))


@query(
    "html_links",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?href=["''](?:[^"'']*)["''][^>]*>(?:.*?)</a>', 0)) AS x FROM pages)
    SELECT page_id, count(DISTINCT regexp_extract(x, '(?is)href=["'']([^"'']*)["'']', 1))::BIGINT AS n_links FROM a GROUP BY page_id""",
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.size(web.links(F.col("html"))).cast("long").alias("n_links"))
    return found.where("n_links > 0")


def term_sql(text: str, term: str) -> str:
    """RE2 has no look-behind; for existence a neighbour of another class or an end says the same."""
    import re

    word = term.casefold()
    if re.fullmatch(r"[a-z0-9_.+-]+", word):
        return f"regexp_matches(lower({text}), '(^|[^a-z0-9]){re.escape(word)}([^a-z0-9]|$)')"
    return f"contains(lower({text}), '{word}')"


def any_sql(text: str, terms) -> str:
    return "(" + (" OR ".join(term_sql(text, t) for t in terms) or "false") + ")"


_TERMS = ("the", "apache", "cc by-nc 4.0", "2.0", "token", "ouan")


@query("keyword_boundary_match", "SELECT doc_id, " + ", ".join(f"{term_sql("coalesce(text, '')", t)} AS t{k}" for k, t in enumerate(_TERMS)) + " FROM documents")
def keyword_boundary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[T.contains_term(F.col("text"), t).alias(f"t{k}") for k, t in enumerate(_TERMS)])


_SENTENCES = r"""s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(rule_text, '([。！？!?；;])', E'\\1\n', 'g'), E'\n'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS sentences FROM i)"""


@query("sentence_split", f"WITH {ITEMS}, {_SENTENCES} SELECT doc_id, len(sentences)::BIGINT AS n_sentences, sha256(array_to_string(sentences, '|')) AS sentences_sha256 FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.sentences(F.col("rule_text"))
    return items(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.sha2(F.array_join(found, "|"), 256).alias("sentences_sha256"))


def _admission_sql() -> str:
    c = CONFIG
    in_title = any_sql("title", c.title_topics)
    in_text = any_sql("rule_text", [t for t in c.topics if t not in c.title_topics])
    direct = " OR ".join(any_sql("rule_text", (*h.names, h.symbol)) for h in c.holdings)
    related = " OR ".join(f"({any_sql('rule_text', h.related)} AND NOT {any_sql('rule_text', h.excluded)})" for h in c.holdings)
    corridor = " OR ".join(f"({any_sql('x', k.joint)} OR ({any_sql('x', k.one_side)} AND {any_sql('x', k.other_side)}))" for k in c.corridors)
    sources = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
    return f"""WITH {ITEMS}, {_SENTENCES}, f AS (
        SELECT doc_id, source, rule_text, ({direct}) AS direct, ({related}) AS related,
               {any_sql('rule_text', c.indicators)} AND {any_sql('rule_text', c.contexts)} AS macro_data, {any_sql('rule_text', c.policy_terms)} AS fed_policy,
               {in_title} OR {in_text} AS semiconductor_ai, coalesce(source, '') IN {sources(c.official_sources)} AS official,
               len(list_filter(sentences, lambda x: ({corridor}) AND {any_sql('x', c.trade_actions)})) > 0 AS in_sentence,
               {any_sql('rule_text', c.excluded)} AS out_word, coalesce(source, '') IN {sources(c.holding_only_sources)} AS holding_only
        FROM s
    ), g AS (SELECT *, direct OR related AS holding, official OR in_sentence AS trade_policy FROM f),
    h AS (SELECT *, CASE WHEN rule_text = '' THEN 'empty_rule_text' WHEN out_word AND NOT direct THEN 'global_exclude'
                WHEN NOT (holding OR macro_data OR fed_policy OR semiconductor_ai OR trade_policy) THEN 'out_of_scope'
                WHEN holding_only AND NOT holding THEN 'holding_scope_required_for_source' WHEN holding_only THEN 'holding_scope_match' ELSE 'content_scope_match' END AS reason_code FROM g)"""


@query(
    "range_admission",
    _admission_sql()
    + """ SELECT doc_id, reason_code, CASE WHEN reason_code LIKE '%_match' THEN 'admitted' ELSE 'excluded' END AS status,
        CASE WHEN reason_code = 'holding_scope_match' THEN 'holding' WHEN reason_code = 'content_scope_match' THEN concat_ws(',', CASE WHEN holding THEN 'holding' END,
        CASE WHEN macro_data THEN 'macro_data' END, CASE WHEN fed_policy THEN 'fed_policy' END, CASE WHEN semiconductor_ai THEN 'semiconductor_ai' END, CASE WHEN trade_policy THEN 'trade_policy' END) ELSE '' END AS families FROM h""",
)
def range_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = admission.admit(items(spark, sf_dir), CONFIG)
    return done.select("doc_id", "admission.reason_code", "admission.status", F.array_join("admission.matched_families", ",").alias("families"))


@query("source_boundary", _admission_sql() + " SELECT source, reason_code, count(*)::BIGINT AS n FROM h WHERE holding_only GROUP BY ALL")
def source_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = admission.admit(items(spark, sf_dir).where(F.col("source").isin(*CONFIG.holding_only_sources)), CONFIG)
    return done.groupBy("source", F.col("admission.reason_code").alias("reason_code")).agg(F.count("*").alias("n"))


_POLICY = CONFIG.policy_terms


@query(
    "admission_evidence",
    f"""WITH {ITEMS}, {_SENTENCES} SELECT doc_id, substr(coalesce(list_filter(sentences, lambda x: {any_sql('x', _POLICY)})[1], rule_text), 1, 300) AS evidence_quote,
        concat_ws(',', {', '.join(f"CASE WHEN {term_sql('rule_text', t)} THEN 'term:' || substr(sha256('{t}'), 1, 12) END" for t in _POLICY)}) AS term_ids
        FROM s WHERE {any_sql('rule_text', _POLICY)}""",
)
def admission_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("rule_text")
    told = admission.evidence("fed_policy", "fed_policy_scope", text, _POLICY)
    rows = items(spark, sf_dir).where(T.matches_any(text, _POLICY)).select("doc_id", told.alias("e"))
    return rows.select("doc_id", "e.evidence_quote", F.array_join("e.matched_term_ids", ",").alias("term_ids"))


_WINDOW = {"anchors": ("the", "der"), "stops": ("licensed",), "signals": (("of", "und"), ("and", "die"), ("is", "ein"))}


@query(
    "sentence_window_signal",
    f"""WITH {ITEMS}, {_SENTENCES}, e AS (SELECT doc_id, sentences, unnest(range(1, len(sentences) + 1)) AS k FROM s),
    a AS (SELECT doc_id, k, sentences[k] AS x, list_slice(sentences, k + 1, k + 6) AS rest FROM e WHERE {any_sql('sentences[k]', _WINDOW['anchors'])}),
    b AS (SELECT *, list_position(list_transform(rest, lambda x: {any_sql('x', _WINDOW['stops'])}), true) AS stop FROM a),
    w AS (SELECT doc_id, k, array_to_string(list_concat([x], CASE WHEN stop > 0 THEN list_slice(rest, 1, stop - 1) ELSE rest END), ' ') AS t FROM b),
    n AS (SELECT doc_id, k, t, {' + '.join(f"{any_sql('t', g)}::INT" for g in _WINDOW['signals'])} AS n_signals FROM w)
    SELECT doc_id, (k - 1)::INT AS at_sentence, n_signals, substr(t, 1, 300) AS quote FROM n WHERE n_signals >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1""",
)
def sentence_window_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = admission.sentence_window(items(spark, sf_dir), "doc_id", "rule_text", **_WINDOW)
    return found.withColumnRenamed("index", "at_sentence")


_LEADER = {"anchors": ("the", "la"), "stops": ("licensed",), "signals": (("of", "und"), ("and", "de"), ("is", "que")), "also": (("in", "les", "to"),)}


@query(
    "leader_judgement",
    f"""WITH {ITEMS}, {_SENTENCES}, e AS (SELECT doc_id, sentences, unnest(range(1, len(sentences) + 1)) AS k FROM s),
    a AS (SELECT doc_id, k, sentences[k] AS x, list_slice(sentences, k + 1, k + 6) AS rest FROM e WHERE {any_sql('sentences[k]', _LEADER['anchors'])} AND {any_sql('sentences[k]', _LEADER['also'][0])}),
    b AS (SELECT *, list_position(list_transform(rest, lambda x: {any_sql('x', _LEADER['stops'])}), true) AS stop FROM a),
    w AS (SELECT doc_id, k, array_to_string(list_concat([x], CASE WHEN stop > 0 THEN list_slice(rest, 1, stop - 1) ELSE rest END), ' ') AS t FROM b),
    n AS (SELECT doc_id, k, t, {' + '.join(f"{any_sql('t', g)}::INT" for g in _LEADER['signals'])} AS n_signals FROM w)
    SELECT doc_id, (k - 1)::INT AS at_sentence, n_signals, substr(t, 1, 300) AS quote FROM n WHERE n_signals >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1""",
)
def leader_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence that names an institution and a role whose window has two of three signals."""
    found = admission.sentence_window(items(spark, sf_dir), "doc_id", "rule_text", **_LEADER)
    return found.withColumnRenamed("index", "at_sentence")


@query(
    "evidence_segments",
    r"""WITH u AS (
        SELECT doc_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([。！？!?\n])', E'\\1\x01', 'g'), '(^|[^.])\.([\s\p{Z}]|$)', E'\\1.\x01\\2', 'g'), '\x01+', E'\x01', 'g'), E'\x01'), lambda x: x <> '')) AS unit FROM documents
    ) SELECT doc_id, sum(ceil(length(unit) / 300.0))::BIGINT AS n_segments, max(least(length(unit), 300))::BIGINT AS longest FROM u GROUP BY doc_id""",
)
def evidence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = T.evidence_segments(F.col("text"), "B")
    rows = table(spark, sf_dir, "documents").select("doc_id", segments.alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.array_max(F.transform("s", lambda x: F.length(x["text"]))).cast("long").alias("longest"))


_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"


@query(
    "near_duplicate_titles",
    rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(upper(translate(replace(string_split(coalesce(text, ''), E'\n')[1], 'ß', 'SS'), '{_LATIN}', '{_HAN}')), '\d+(?:\.\d+)?%?', '', 'g'), '[A-Z]{{2,}}', '', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g') AS core FROM documents),
    c AS (SELECT doc_id, core, CASE WHEN length(core) < 2 THEN [core] ELSE list_distinct(list_transform(range(1, length(core)), lambda k: substr(core, k, 2))) END AS grams FROM t WHERE core <> ''),
    p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.core AS x, b.core AS y, a.grams AS ga, b.grams AS gb, len(list_intersect(a.grams, b.grams)) AS shared FROM c a JOIN c b ON a.doc_id < b.doc_id AND b.doc_id <= a.doc_id + 48 AND a.core <> b.core),
    e AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY core ORDER BY doc_id) AS before FROM c)
    SELECT doc_a, doc_b, 'similar' AS relation FROM p WHERE CASE WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) >= 8
        ELSE shared / least(len(ga), len(gb)) >= 0.65 AND shared / (len(ga) + len(gb) - shared) >= 0.45 END
    UNION ALL SELECT before, doc_id, 'equal' FROM e WHERE doc_id - before <= 48""",
)
def near_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles, told apart as the rule tells Chinese ones (Latin letters stand for signs here), within 48 hours; document n is of hour n."""
    core = T.title_core(F.translate(F.col("title"), _LATIN, _HAN), T.TITLE_NOISE, abbreviations=False)
    rows = items(spark, sf_dir).select("doc_id", core.alias("core"), F.col("doc_id").alias("hour"))
    return titles.near_duplicates_within(rows, "doc_id", "core", "hour", 48)


@query(
    "near_duplicate_titles_whole",
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(upper(replace(string_split(coalesce(text, ''), E'\n')[1], 'ß', 'SS')), '\d+(?:\.\d+)?%?', '', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS core FROM documents),
    c AS (SELECT core, min(doc_id) AS head, CASE WHEN length(core) < 2 THEN [core] ELSE list_distinct(list_transform(range(1, length(core)), lambda k: substr(core, k, 2))) END AS grams FROM t WHERE core <> '' GROUP BY core),
    p AS (SELECT a.head AS h, b.head AS i, a.core AS x, b.core AS y, a.grams AS ga, b.grams AS gb, len(list_intersect(a.grams, b.grams)) AS shared FROM c a JOIN c b ON a.core < b.core)
    SELECT least(h, i) AS doc_a, greatest(h, i) AS doc_b, 'similar' AS relation FROM p WHERE CASE WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) >= 8
        ELSE shared / least(len(ga), len(gb)) >= 0.65 AND shared / (len(ga) + len(gb) - shared) >= 0.45 END
    UNION ALL SELECT head, doc_id, CASE WHEN length(core) < 8 THEN 'short' ELSE 'equal' END FROM t JOIN c USING (core) WHERE doc_id <> head""",
)
def near_duplicate_titles_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles against all, of any length, beginning and language; see titles.near_duplicates."""
    return titles.near_duplicates(items(spark, sf_dir), "doc_id", "title")
