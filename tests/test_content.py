from pyspark.sql import functions as F

from quillstream.operators import content as C

CONFIG = C.ContentConfig(
    primary=("CPI", "payrolls"), scoped=("jobless claims",), context=("u.s. ", "美国"), surprise=(r"above (?:all )?forecasts?", "超预期"), expected=("in line",), large_move=(r"\d+% (?:drop|jump)",), preview=(r"due (?:on|at)",),
    reaction=("stocks", "美股"), explicit_reaction=("market repricing",), released=("rose to",), events=("fomc", "fed"), official_events=("fomc statement",), ignored=("retail sales",),
)


def told(spark, *texts):
    df = spark.createDataFrame([(i, *(t if isinstance(t, tuple) else (t, None, ""))) for i, t in enumerate(texts)], "id long, title string, summary string, full_text string")
    return [r.content.asDict() for r in C.features(df, CONFIG).orderBy("id").collect()]


def test_features_of_a_release(spark):
    a, b, c, d, e = told(spark, "CPI above forecast! Stocks 3% drop. Later note", "CPI above forecast! Quiet! Stocks 3% drop!", "U.S. jobless claims in line", "Jobless claims in line", "CPI due on Friday")
    assert a["primary_terms"] == ["CPI"] and a["surprise_evidence"] == "CPI above forecast! Stocks 3% drop. Later note" and a["attributable_reaction"] and a["direct_release"] and a["tags"] == ["primary_data", "market_reaction", "large_move", "surprise"]
    assert b["surprise_evidence"] == "CPI above forecast! Quiet!" and b["market_reaction"] and not b["attributable_reaction"]
    assert c["primary_terms"] == ["jobless claims"] and c["expected"] and c["direct_release"] and c["tier"] == "primary"
    assert not d["primary"] and not d["expected"] and d["tier"] == "" and e["preview"] and not e["direct_release"] and e["primary"]


def test_events_ignored_data_and_empty_texts(spark):
    a, b, c, d, e, f = told(spark, "fomc statement", "U.S. fed: 2% jump", "fed: 2% jump", "retail sales up", "retail sales and CPI", (None, None, None))
    assert a["event"] and a["tags"] == ["fed_event"] and b["event"] and not c["event"] and d["tier"] == "ignored" and d["tags"] == [] and e["tier"] == "primary" and f["tier"] == "" and f["surprise_evidence"] == ""
    long = told(spark, "CPI above forecast " + "x" * 2000 + "! next")[0]
    assert len(long["surprise_evidence"]) == 500
    assert told(spark, ("title", "CPI", "payrolls rose to 3"))[0]["primary_terms"] == ["CPI", "payrolls"]


def test_transmission_and_its_exceptions(spark):
    config = C.TransmissionConfig({"easing": ("cut",), "tightening": ("hike",)}, ("gold", "dollar", "gold"), (r"cut .{0,20}gold",), {"decision": (r"decided to",), "unexpected": (C.unexpected_relationship(["despite", "but"], ["fell", "rose"]),), "asset_move": (r"gold \d+%",)})
    say = lambda t: spark.range(1).select(C.transmission(F.lit(t), config).alias("x")).first().x
    assert say("A cut lifts Gold") == (True, "easing", ["gold"], "cut lifts Gold", [])
    assert say("A cut lifts gold, gold 3%; they decided to, but it fell").exceptions == ["decision", "unexpected", "asset_move"]
    assert say("A cut and a hike, gold").impulse == "" and not say("gold then a cut").matched and not say(None).matched
    assert say("a cut lifts gold but " + "." * 40 + "fell").matched


def test_industry_facts(spark):
    rules = [C.FactRule("a:shift", (("acme",), ("memory", "storage")), ((r"shift(?:s|ed)? .{0,9}toward",),), ("correction",), unless=(("supplier",), ("cuts",))), C.FactRule("b:hedge", (("bolt",), ("hedge",)), lacks_patterns=(r"said in a (?:reply|statement)",))]
    say = lambda t: spark.range(1).select(C.industry_fact(F.lit(t), rules)).first()[0]
    assert say("Acme shifts money toward Memory") == "industry_fact:a:shift" and say("Acme shifts money toward memory, correction") is None
    assert say("Acme shifted toward memory; supplier") == "industry_fact:a:shift" and say("Acme shifted toward memory; supplier cuts") is None
    assert say("bolt may hedge") == "industry_fact:b:hedge" and say("Bolt hedge, it said in a reply") is None and say("") is None and say(None) is None


def test_target_prices(spark):
    say = lambda t: spark.range(1).select(C.target_price(F.lit(t)).alias("x")).first().x
    assert say("目标价为港元 1,250.50") == ("HKD", "1250.5") and say("target price of $30") == ("USD", "30") and say("目标价 12.00元") == ("CNY", "12") and say("TP: 5") == ("UNKNOWN", "5")
    assert say("给出 88美元的目标价") == ("USD", "88") and say("no price") is None and say(None) is None and say("target price 1000") == ("UNKNOWN", "1000")


def test_report_identities(spark):
    config = C.ReportConfig({"ms": ("Big Bank", "BB"), "gs": ("Gold Firm",)}, (r"首次覆盖\s*([A-Za-z一-鿿 ]{2,20}?)(?=，|,|。)", r"coverage of ([A-Za-z ]{2,20}?)(?=,|\.)"), ("首次覆盖", "initiates coverage"), ("上调", "raises"), {"buy": ("买入", "buy")}, ("股份有限公司",), ("it",))
    say = lambda t, b="": spark.range(1).select(C.report_identity(F.lit(t), F.lit(b), config).alias("x")).first().x
    one = say("Big Bank首次覆盖星河股份有限公司，目标价30美元，买入")
    assert (one.institution, one.subject, one.action, one.rating, one.currency, one.price) == ("ms", "星河", "coverage_start", "buy", "USD", "30")
    assert one.dedup_key == say("BB首次覆盖星河，", "目标价30.00美元").dedup_key
    assert say("Big Bank and Gold Firm首次覆盖星河，目标价30美元") is None and say("Big Bank首次覆盖星河，目标价30") is None and say("Big Bank上调，首次覆盖星河，目标价30美元") is None
    assert say("Big Bank initiates coverage of it, target price $3") is None and say("首次覆盖星河，目标价30美元") is None and say(None, None) is None
    assert say("Big Bank on coverage of Star, coverage of Star Light, target price $3").subject == "Star Light" and say("Big Bank on coverage of Star, coverage of Moon, target price $3") is None


def test_patterns_know_the_case_of_all_letters_and_no_line_end_but_the_feed(spark):
    config = C.TransmissionConfig({"easing": ("cut",)}, ("gold",), ("de la [a-zé]+",), {"unexpected": (C.unexpected_relationship(("but",), ("fell",)),)})
    say = lambda t: spark.range(1).select(C.transmission(F.lit(t), config).alias("x")).first().x
    assert say("cut gold de la Éan").evidence_quote == "de la Éan" and say("cut gold DE LA É").matched
    assert say("cut gold but\rit\u2028fell").exceptions == ["unexpected"] and say("cut gold but\nit fell").exceptions == []
