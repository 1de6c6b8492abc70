"""Raw rows of sources as items: fields by precedence of their names, profiles laid over them, identities and hashes.

Raw rows are JSON objects, a text each. A field takes the first name that is not empty. Defined results: broken or null
JSON has no fields; empty texts count as absent; lists keep their order, each value once; a source without a profile
keeps what the row says. Repeated rows are items of their own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import rules as U
from quillstream.functions import text as T
from quillstream.functions import web

#: Categories whose items come from news media if nobody says otherwise, and characters of a text that a hash covers.
MEDIA_CATEGORIES, HASHED = ("news_media", "portfolio_stock_news"), 2000


def pick(raw: Column, names: Sequence[str]) -> Column:
    """The first of the fields that is not empty, trimmed; empty if none is."""
    return T.first_non_empty(*[T.strip(F.get_json_object(raw, f"$.{n}")) for n in names])


def pick_list(raw: Column, names: Sequence[str]) -> Column:
    """The first of the list fields that is not empty, its texts each once."""
    lists = [F.from_json(F.get_json_object(raw, f"$.{n}"), "array<string>") for n in names]
    return T.distinct_texts(F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>")))


def nfkc(column: Column) -> Column:
    """Compatibility form without white space; no built-in function folds characters so."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()))

    return folded(T.text_of(column))


def mapped_items(rows: DataFrame, source: str, raw: str, profiles: DataFrame | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """The columns of an item for every raw row, with its source's profile (source, category, role, fetcher).

    What the row says goes before the profile, and that before the source's default category; media categories make the publisher
    ``news_media``. The key is the row's id, else its URL or title, after the source; without any a hash.
    """
    base = rows.withColumn("_source", T.collapse(F.col(source)))
    if profiles is None:
        laid = base.withColumns({f"_p_{c}": F.lit(None).cast("string") for c in ("category", "role", "fetcher")})
    else:
        one = profiles.groupBy(F.col("source").alias("_profile")).agg(*[F.max(c).alias(f"_p_{c}") for c in ("category", "role", "fetcher")])
        laid = base.join(one, F.col("_source") == F.col("_profile"), "left").drop("_profile")
    j = F.col(raw)
    default = F.coalesce(*[F.when(F.col("_source") == s, F.lit(c)) for s, c in (defaults or {}).items()], F.lit(""))
    category = T.first_non_empty(pick(j, ["source_category"]), F.col("_p_category"), default)
    role = T.first_non_empty(pick(j, ["publisher_role"]), F.col("_p_role"), F.when(category.isin(*MEDIA_CATEGORIES), "news_media"))
    item_id = T.first_non_empty(pick(j, ["raw.id"]), pick(j, ["id", "item_id", "url", "title"]))
    title, published, url, kind = T.collapse(pick(j, ["title"])), T.collapse(pick(j, ["published_at"])), pick(j, ["url"]), T.first_non_empty(T.collapse(pick(j, ["content_type"])), F.lit("unknown"))
    key = T.first_non_empty(pick(j, ["dedupe_key"]), T.dedupe_key(F.col("_source"), item_id, url, kind, title, published))
    made = {
        "source": F.col("_source"), "source_category": T.collapse(category), "publisher_role": T.collapse(role), "collector": T.collapse(T.first_non_empty(pick(j, ["collector"]), F.col("_p_fetcher"), F.col("_source"))), "content_type": kind,
        "item_id": item_id, "title": title, "summary": T.collapse(pick(j, ["summary", "content"])), "full_text": pick(j, ["full_text"]), "url": url, "published_at": published, "first_seen_at": T.collapse(pick(j, ["first_seen_at"])),
        "symbols": pick_list(j, ["symbols", "related_symbols"]), "themes": pick_list(j, ["themes"]), "dedupe_key": key, "access_note": T.collapse(pick(j, ["access_note"])),
    }
    return laid.select(*[c for c in rows.columns if c not in (source, raw)], *[c.alias(n) for n, c in made.items()])


def brief_items(rows: DataFrame, raw: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, item_id, url, title, summary, published): rows of a brief feed by their several names; rows without title and address go."""
    j = F.col(raw)
    title, address = pick(j, ["newcontent", "title", "LiveTitle"]), pick(j, ["ShareUrl", "url", "link"])
    made = rows.select(
        *keep, T.first_non_empty(pick(j, ["LiveID"]), address, title).alias("item_id"), web.canonical_a(address).alias("url"), title.alias("title"),
        web.strip_tags(pick(j, ["LiveContent", "summary", "description", "newcontent"])).alias("summary"), pick(j, ["CreateDate", "published_at", "pubDate"]).alias("published"),
    )
    return made.where("title <> '' OR url <> ''")


def disclosure_items(records: DataFrame) -> DataFrame:
    """Items of disclosure records (company_name, symbol, title, published_at, content_kind, document_url, identity, full_text)."""
    relation = F.col("content_kind") == "relation"
    told = F.when(relation, "投资者关系活动记录").otherwise("公司公告")
    text = lambda c: T.text_of(F.col(c))
    name = F.trim(F.concat(text("company_name"), F.lit(" "), text("symbol")))
    summary = F.concat(F.lit("股票："), name, F.lit("；标题："), text("title"), F.lit("；发布时间："), text("published_at"), F.lit("；披露类型："), told)
    return records.select(
        F.col("identity").alias("item_id"), F.lit("company_official").alias("publisher_role"), F.when(relation, "investor_relations_record").otherwise("announcement").alias("content_type"), text("title").alias("title"), summary.alias("summary"),
        text("full_text").alias("full_text"), text("document_url").alias("url"), text("published_at").alias("published_at"), F.array(F.col("symbol")).alias("symbols"), F.array(F.when(relation, told).otherwise("公司公告")).alias("themes"),
        T.content_hash(F.col("identity"), F.col("title"), F.col("published_at"), F.substring(text("full_text"), 1, HASHED)).alias("content_hash"), (text("full_text") != "").alias("has_text"),
    )


def stock_items(rows: DataFrame, holdings: DataFrame, source: str = "stock_news") -> DataFrame:
    """Items of stock-news rows (symbol, title, url, published_at, article_text) of holdings (symbol, name), one a row and holding."""
    named = holdings.select(F.upper("symbol").alias("_symbol"), "name").dropDuplicates(["_symbol"])
    both = rows.join(named, F.upper("symbol") == F.col("_symbol"))
    article, url = T.strip(T.text_of(F.col("article_text"))), T.text_of(F.col("url"))
    summary = F.concat(T.text_of(F.col("name")), F.lit("（"), "_symbol", F.lit("）相关新闻："), T.text_of(F.col("title")))
    full, canonical = T.first_non_empty(article, summary), web.canonical_c(url)
    digest = T.content_hash(F.lit(source), canonical, F.col("title"), F.substring(full, 1, HASHED))
    item = F.concat("_symbol", F.lit(":"), U.article_id(url))
    return both.select(item.alias("item_id"), T.text_of(F.col("title")).alias("title"), summary.alias("summary"), full.alias("full_text"), url.alias("url"), canonical.alias("canonical_url"), T.text_of(F.col("published_at")).alias("published_at"), F.array("_symbol").alias("symbols"), (article != "").alias("fetched"), digest.alias("content_hash"))


def universe_match(text: Column, macro: Column, excluded: Column, holding: Column, keyword: Column, power: Column, infrastructure: Column) -> Column:
    """(matched, tag): the first that holds of an empty text, macro, exclusion, holding, keyword, and power with or without its context; else outside."""
    yes = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    tag = (
        F.when(T.strip(T.text_of(text)) == "", "").when(yes(macro), "macro_policy").when(yes(excluded), "media_keyword_excluded").when(yes(holding), "holding_match").when(yes(keyword), "semiconductor_ai")
        .when(yes(power) & yes(infrastructure), "ai_power_infra").when(yes(power), "generic_power_filtered").otherwise("outside_universe")
    )
    return F.struct(tag.isin("macro_policy", "holding_match", "semiconductor_ai", "ai_power_infra").alias("matched"), tag.alias("tag"))
