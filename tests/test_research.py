"""Quick scans and research scores on small sites."""

from marketloom.operators import research as R
from pyspark.sql import functions as F

HOME = '<title>Acme lamps</title><meta name="description" content="The best lamps for careful people"><h1>Lamps</h1><p>Shop and buy a product. Trusted by every customer. Get started.</p><a href="/shipping-info">a</a><a href="/returns">b</a><a href="/deliveries">c</a><a href="https://www.instagram.com/a">d</a><a href="/blog">e</a><a href="mailto:x@y.z">f</a>'
PAGES = [(2, "https://acme.com/", HOME), (1, "https://acme.com/about", "<h1>Other</h1><a href='/privacy'>p</a>"), (3, "http://bare.com/x", None), (4, "http://bare.com/y", "<h1>Y</h1>")]


def test_scan_and_scores(spark):
    scans = R.site_scans(spark.createDataFrame(PAGES, "page_id int, url string, html string"))
    business = spark.createDataFrame([("acme.com", "lamps", "readers")], "site_id string, product_sold string, target_customers string")
    results = spark.createDataFrame([("acme.com", f"q{k % 4}", "Lamp brand", "growing demand") for k in range(8)], "site_id string, query string, title string, snippet string")
    rows = {r.site_id: r for r in R.research_scores(scans, business, results).withColumns({n: R.lines_of(n) for n in ("strengths", "risks", "actions")}).collect()}
    a, b = rows["acme.com"], rows["bare.com"]
    assert (a.h1, a.shipping_policy, a.return_policy, a.privacy_policy, a.about_page, a.social, a.blog_links) == ("Lamps", "https://acme.com/shipping-info", "https://acme.com/returns", "https://acme.com/privacy", "", 1, 1)
    assert (a.product_words, a.trust_words, a.action_words) == (3, 2, 4)
    assert (a.store_score, a.trust_score, a.content_score, a.offer_score, a.market_score) == (100, 35 + 12 + 12 + 10 + 9, 40 + 15 + 15 + 10, 100, 40 + 15 + 10 + 10 + 10 + 5)
    assert a.overall_score == int(100 * 0.22 + 78 * 0.22 + 80 * 0.18 + 100 * 0.18 + 90 * 0.2 + 0.5)
    assert a.strengths == ["Store uses HTTPS for secure browsing.", 'Clear homepage headline: "Lamps".', "Social profiles linked from the website.", "Shipping and return policy pages are discoverable.", "Clear product focus: lamps.", "Defined audience: readers."]
    assert (b.h1, b.store_score, b.trust_score) == ("", 55, 35) and len(b.risks) == 6 and b.actions[0].startswith("Add a clear H1")


def test_market_merge(spark):
    rows = spark.createDataFrame([(80.0, 60.0), (80.0, 0.0), (80.0, None)], "own double, web double")
    assert [r[0] for r in rows.select(R.market_merged(F.col("own"), F.col("web"))).collect()] == [76.0, 74.0, 74.0]
