import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.operators import macro_events as M

CONFIG = M.MacroConfig(
    country="US", country_terms=("u.s.", "美国"), indicators={"CPI": ("cpi", "消费者价格指数"), "NONFARM": ("payrolls", "非农")},
    market_terms=("stocks", "美股"), direction_terms=("rose", "fell", "下跌"), surprise_terms=("above expectations", "超预期"), correction_terms=("correction",),
    counted=("NONFARM",), rate_terms=("同比", "year on year"), change_terms=("新增", "added"), forecast_terms=("预期", "forecast"), released_terms=("公布后", "surprise"),
    speaker_terms=("Chair X",), speech_verbs=("said",), impulses={"easing": ("rate cut",), "tightening": ("rate hike",)},
)
AT = dt.datetime(2024, 3, 12, 20, 30)


def told(spark, *texts, at=AT, config=CONFIG, **options):
    df = spark.createDataFrame([(i, t, None, "", at) for i, t in enumerate(texts)], "id long, title string, summary string, full_text string, published_at timestamp")
    return {r.id: r for r in M.identities(df, config, **options).collect()}


def test_places_count_characters(spark):
    rows = spark.createDataFrame([("aXbbXX",), ("é漢X",), ("none",), ("",)], "t string").select(M.places(F.col("t"), "X").alias("p")).collect()
    assert [[(m.value, m["at"]) for m in r.p] for r in rows] == [[("X", 1), ("X", 4), ("X", 5)], [("X", 2)], [], []]


def test_release_preview_and_value_preferred(spark):
    got = told(
        spark,
        "美国2月CPI同比上涨3.2%",  # a published value
        "U.S. February CPI is due tonight",  # none yet
        "U.S. January CPI is due; U.S. February CPI year on year 3.2%",  # the claim with a value wins
        "U.S. CPI year on year 3.2%",  # no month
        "February CPI year on year 3.2%",  # no country
        "美国2月CPI预期同比3.1%",  # a forecast is no value
    )
    assert {k: (v.phase, v.dedup_key) for k, v in got.items()} == {
        0: ("release", "macro:release:US:CPI:2024-02"), 1: ("preview", "macro:preview:US:CPI:2024-02"),
        2: ("release", "macro:release:US:CPI:2024-02"), 5: ("preview", "macro:preview:US:CPI:2024-02"),
    }


def test_nearest_month_before_within_reach(spark):
    far = "U.S. May " + "x" * 45 + " CPI"
    got = told(spark, "U.S. May and June CPI, July payrolls", "U.S. CPI in May", far, "U.S. May " + "x" * 39 + " CPI", "美国12月非农", "美国2023年5月CPI", "美国5月3日CPI", "U.S. December 2022 CPI")
    assert {k: (v.indicator, v.period) for k, v in got.items()} == {
        0: ("CPI", "2023-06"), 3: ("CPI", "2023-05"), 4: ("NONFARM", "2023-12"), 5: ("CPI", "2023-05"), 7: ("CPI", "2022-12"),
    }


def test_reactions_sessions_and_aliases(spark):
    got = told(spark, "U.S. February CPI above expectations, stocks fell", "U.S. CPI surprise: stocks fell", "stocks fell above expectations", "stocks rose on a rate cut", "U.S. February CPI, stocks fell")
    assert {k: v.phase for k, v in got.items()} == {0: "market_reaction", 1: "market_reaction", 3: "fed_policy_market_reaction", 4: "preview"}
    assert got[0].dedup_key == "macro:market_reaction:US:CPI:2024-02" and got[1].period == "2024-02"
    assert got[0].session == "2024-03-12" and got[0].aliases == [f"macro:market_reaction:US:CPI:2024-03-{d}" for d in (12, 11, 10)]
    assert got[3].dedup_key == "macro:fed_policy_market_reaction:US:FED_POLICY:easing" and got[3].minutes == 14 * 1440 and got[0].minutes == 90 * 1440
    late = told(spark, "U.S. February CPI above expectations, stocks fell", at=dt.datetime(2024, 3, 12, 23, 0))
    assert late[0].session == "2024-03-13"  # 07:00 of the next day there
    assert told(spark, "U.S. February CPI above expectations, stocks fell", at=dt.datetime(2024, 3, 12, 21, 59))[0].session == "2024-03-12"
    assert told(spark, "U.S. CPI surprise: stocks fell", "U.S. 2024 CPI", at=None) == {}


def test_corrections_speeches_and_exceptions_have_no_identity(spark):
    assert told(spark, "Correction: U.S. February CPI", "Chair X said U.S. February CPI", "Chair X: U.S. February CPI", None, "") == {}
    df = spark.createDataFrame([(1, "U.S. February CPI", AT, True), (2, "U.S. February CPI", AT, False)], "id long, t string, published_at timestamp, apart boolean")
    assert [r.id for r in M.identities(df, CONFIG, parts=("t",), exceptions="apart").collect()] == [2]


@pytest.mark.parametrize("month, published, year", [(1, (2024, 1), 2024), (2, (2024, 1), 2024), (3, (2024, 1), 2023), (12, (2024, 1), 2023), (12, (2024, 11), 2024)])
def test_year_of_a_month_without_one(spark, month, published, year):
    got = told(spark, f"美国{month}月CPI", at=dt.datetime(*published, 15))
    assert got[0].period == f"{year}-{month:02d}"
