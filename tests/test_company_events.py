import datetime as dt
import hashlib

from pyspark.sql import functions as F

from quillstream.operators import company_events as C
from quillstream.operators import reservations

CONFIG = C.CompanyConfig(
    families={"acquisition": ("收购", "acquire"), "price_change": ("涨价", "降价"), "buyback": ("buyback",), "contract_order": ("中标", "contract")},
    metric_terms=("净利润", "net profit"), forecast_terms=("预计", "guidance"), result_terms=("实现", "results"), correction_terms=("更正", "corrected"),
    stages={"terminated": ("终止",), "completed": ("完成",), "approved": ("获批",)}, proposed_terms=("拟", "plans to"), turns={"price_change": (("降价",), "down", "up")},
    action_terms=("公告", "预计", "拟", "宣布", "中标", "完成", "终止", "announces"), object_terms=("GPU", "芯片"), party_patterns=(r"收购([一-鿿A-Za-z]{2,20}?)(?:控股权|股权)",),
    legal_forms=("股份有限公司", " inc.", " corp"), trailing=("股份",), leading=("其中",), canonical={"acme": "Acme Works"}, no_names=("公司", "市场", "更正"), no_parts=("同比", "公告"),
    broad=("buyback",), short=("price_change",), monthly=("price_change",),
)
AT = dt.datetime(2024, 3, 12, 1, 0)
ITEMS = "id long, title string, summary string, full_text string, published_at timestamp, targets array<struct<name:string,code:string>>"


def told(spark, *texts, at=AT, targets=None):
    df = spark.createDataFrame([(i, t, None, "", at, targets) for i, t in enumerate(texts)], ITEMS)
    return [(r.id, r.company, r.family, r.reference, r.stage, r.scope) for r in C.identities(df, CONFIG, targets="targets").orderBy("id", "place", "rank").collect()]


def test_earnings_by_period(spark):
    got = told(spark, "东方股份有限公司公告：预计2023年全年净利润增长", "华星预计上半年净利润5亿元", "华星宣布第一季度实现净利润", "华星宣布净利润", "华星宣布第一季度净利润")
    assert got[:3] == [(0, "东方", "earnings", "2023-FY", "forecast", []), (1, "华星", "earnings", "2024-H1", "forecast", []), (2, "华星", "earnings", "2024-Q1", "results", [])]
    assert len(got) == 3


def test_families_scopes_and_stages(spark):
    got = told(spark, "华星拟收购蓝海控股权", "华星公告：芯片涨价10%", "华星宣布5月起GPU降价", "华星宣布 buyback", "华星中标项目", "华星中标3亿元项目", "更正：华星宣布收购，作价3億元", "华星终止收购，2024年1月5日")
    assert got[0] == (0, "华星", "acquisition", "2024-03-12", "proposed", ["蓝海"])
    assert got[1] == (1, "华星", "price_change", "2024-03-12", "up", ["芯片"])
    assert (2, "华星", "price_change", "2024-05", "down", ["gpu"]) in got
    assert (3, "华星", "buyback", "2024-03-12", "announced", []) in got
    assert [g for g in got if g[0] in (4, 5)] == [(5, "华星", "contract_order", "2024-03-12", "announced", ["3亿元"])]  # no scope, no identity
    assert [g[4] for g in got if g[0] == 6][0] == "revision-" + hashlib.sha256("3亿元".encode()).hexdigest()[:10]
    assert got[-1][0] != 7 or got[-1][3:5] == ("2024-01-05", "terminated")


def test_companies_of_a_claim(spark):
    got = told(spark, "其中星河（600001.SH）与市场宣布 buyback", "acme announces buyback", "市场宣布 buyback", "快讯 buyback of Beta", targets=[("Beta", "B.1"), (None, None)])
    assert [(g[0], g[1]) for g in got] == [(0, "星河"), (1, "Acme Works"), (3, "Beta")]


def test_markup_repeats_nulls_and_times(spark):
    assert told(spark, None, "", "nothing here") == []
    got = told(spark, "<b>华星</b>宣布 buyback<br/>华星宣布 BUYBACK; 华星宣布 buyback")
    assert [(g[1], g[2]) for g in got] == [("华星", "buyback")]
    assert told(spark, "华星宣布 buyback", at=None) == [] and told(spark, "华星宣布 buyback 2024-2-3", at=None)[0][3] == "2024-02-03"
    assert told(spark, "华星宣布 buyback", at=dt.datetime(2024, 3, 12, 17, 0))[0][3] == "2024-03-13"  # local day
    assert C.identities(spark.createDataFrame([], ITEMS), CONFIG).count() == 0


def test_events_feed_the_fact_sets(spark):
    df = spark.createDataFrame([(1, "华星宣布 buyback", None, "", AT, None), (2, "华星宣布 buyback；蓝海宣布 buyback", None, "", AT, None), (3, "蓝海宣布 buyback", None, "", AT, None)], ITEMS)
    hits = C.identities(df, CONFIG).groupBy("id").agg(F.collect_list(reservations.hit(F.lit(C.RULE), F.col("dedup_key"), F.array().cast("array<string>"), F.col("minutes"))).alias("hits"))
    rows = hits.join(df.select("id", (F.col("published_at") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t")), "id").withColumn("outcome", F.lit("sent"))
    assert {r.id: r.status for r in reservations.reserve_sets(rows, "t", "id", "hits", "outcome").collect()} == {1: "reserved", 2: "reserved", 3: "duplicate"}


def test_names_are_sought_once(spark):
    """No filter is inferred from the list of names, which would search for them again for each of its conditions."""
    df = spark.createDataFrame([(1, "Firm announces a buyback"), (2, "nothing")], "id int, title string").withColumn("at", F.lit(None).cast("timestamp"))
    rows = C.named(C.claims(df, "id", ("title",), "at", None), CONFIG)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{2,36}") == 1
    assert [(r.id, r.f.name) for r in rows.collect()] == [(1, "Firm")]
