from pyspark.sql import functions as F

from quillstream.sources import details as D

RULE = D.DetailRule(
    title_suffix=r"\s*[-_|]\s*Site\s*$", time_names=("bytedance:published_time", "article:published_time"), body_start=r"""<div\b[^>]*\bid\s*=\s*["']artibody["'][^>]*>""", body_ends=("<!-- end -->", '<div class="article-bottom'),
    dropped_starts=("Editor:",), dropped_words=("our APP",), cut_at=("Risk notice",),
)
LONG = "A paragraph that is long enough to count"


def told(spark, *pages):
    df = spark.createDataFrame([(i, f"https://X.org/p/{i}#f", h) for i, h in enumerate(pages)], "id int, url string, html string")
    return [r.detail for r in D.details(df, RULE).orderBy("id").collect()]


def test_titles_times_and_authors_by_precedence(spark):
    a, b, c, d = told(
        spark,
        '<meta property="og:title" content="Og - Site"><meta name="article:published_time" content="2024-01-02T03:04:05Z"><meta name="author" content="Ann &amp; Co"><meta property="og:url" content="HTTPS://y.org/a">',
        '<title>T | Site</title><time datetime="2024-02-03"></time>', '<h1>H</h1>{"display_time": 1704164645}', None,
    )
    assert (a.title, a.published, a.author, a.url) == ("Og", "2024-01-02T03:04:05Z", "Ann & Co", "https://y.org/a") and a.published_ts is not None
    assert (b.title, b.published, b.url) == ("T", "2024-02-03", "https://x.org/p/1") and (c.title, c.published[:19]) == ("H", "2024-01-02T03:04:05")
    assert (d.title, d.published, d.body, d.origin, d.ok) == ("", "", "", "none", False)


def test_bodies_by_precedence(spark):
    a, b, c, d, e = told(
        spark,
        f'<title>T</title><div class="x" id="artibody"><p>Editor: me</p><script>var p="<p>no</p>"</script><p>{LONG}</p><p>see our APP now</p><p>{LONG} too. Risk notice: none</p><!-- end --><p>after</p></div>',
        f'<div id="artibody">{LONG} without tags<div class="article-bottom">x</div></div>', f"<div>short</div><article><p>{LONG} in an article</p></article><main>m</main>",
        '<meta name="description" content="About it"><div>tiny</div>', '<title>T</title><div id="artibody"></div>',
    )
    assert (a.body, a.origin, a.ok) == (f"{LONG}\n\n{LONG} too.", "paragraphs", True)
    assert (b.body, b.origin, b.ok) == (f"{LONG} without tags", "region", False) and (c.body, c.origin) == (f"{LONG} in an article", "element")
    assert (d.body, d.origin) == ("About it", "description") and (e.body, e.ok) == ("", False)


def test_long_bodies_are_cut(spark):
    one = told(spark, f'<title>T</title><div id="artibody"><p>{"x" * 50_000}</p></div>')[0]
    assert len(one.body) == 40_000


def test_only_unseen_items_are_enriched(spark):
    items = spark.createDataFrame([(k, f"t{k}", "s", "2024") for k in range(1, 6)], "id int, title string, summary string, published_at string")
    seen = spark.createDataFrame([(1,), (1,)], "id int")
    good = f'<title>New</title><div id="artibody"><p>{LONG}</p></div>'
    fetched = spark.createDataFrame([(1, "u", good, None), (2, "u", good, None), (2, "v", "other", None), (3, "u", None, "timeout"), (4, "u", "<p>no title</p>", None)], "id int, url string, html string, error string")
    got = {r.id: (r.title, r.summary, r.full_text, r.published_at, r.detail_status) for r in D.enriched(items, seen, fetched, "id", RULE).collect()}
    assert got == {
        1: ("t1", "s", None, "2024", "seen"), 2: ("New", LONG, LONG, "2024", "ok"), 3: ("t3", "s", None, "2024", "failed"), 4: ("t4", "s", None, "2024", "failed"), 5: ("t5", "s", None, "2024", "missing"),
    }
    assert D.enriched(items.where(F.lit(False)), seen, fetched, "id", RULE).count() == 0
