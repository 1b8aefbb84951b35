"""Site kinds, structured products, caps, fix plans and chat facts on small tables."""

import json

from pyspark.sql import functions as F

from marketloom.operators import evidence


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def ld(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


def test_structured_products(spark):
    product = {"@type": "Product", "name": " Red  Cup ", "offers": {"lowPrice": "3.5"}, "image": ["a.png"]}
    rows = [
        (1, "https://a.example/", ld(product) + ld("{broken") + ld({"@graph": [{"@type": "Product", "name": "red cup", "offers": [{"price": 4}]}]})),
        (2, "https://a.example/l", ld({"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "Pan", "image": {"url": "p.png"}}}]})),
        (3, "https://a.example/g", ld([{"@type": "ProductGroup", "name": "Shirt", "hasVariant": [{"@type": "Product", "name": "Shirt S"}]}, {"@type": "Product", "name": ""}])),
        (4, "https://a.example/n", None), (5, "https://a.example/e", ""),
    ]
    got = {(r.page_id, r.name): (r.price, r.image, r.confidence) for r in evidence.structured_products(page(spark, rows)).collect()}
    assert got.pop((1, "red cup")) == ("4", None, 92)  # of two equally sure rows of one name, the greater
    assert got == {(2, "Pan"): (None, "p.png", 80), (3, "Shirt"): (None, None, 88), (3, "Shirt S"): (None, None, 80)}


def test_site_kinds(spark):
    cup = ld({"@type": "Product", "name": "Cup"})
    rows = [
        (1, "https://m.example/dp/1", "<p>Sold by us</p>"), (2, "https://s.example/", "<p>Get a quote today</p>"), (3, "https://shop.example/", "<link href='cdn.shopify.com'>"),
        (4, "https://shop2.example/", "<link href='cdn.shopify.com'><button>Book a visit</button>"), (5, "https://brand.example/", cup), (6, "https://c.example/", "<p>blog blog article</p>"), (7, "https://u.example/", None),
    ]
    got = {r.site_id: (r.kind, r.confidence) for r in evidence.site_classes(evidence.page_hints(page(spark, rows))).collect()}
    want = {"example": ("marketplace", 85), "s.example": ("service", 70), "shop.example": ("shopify_dtc", 80), "shop2.example": ("service", 68), "brand.example": ("single_brand_ecommerce", 75), "c.example": ("content_social", 65), "u.example": ("unknown", 40)}
    assert got == want  # m. is a prefix of hosts


def test_caps_and_fix_plan(spark):
    df = spark.createDataFrame([(90.0, True, True), (90.0, False, True), (20.0, True, True), (90.0, False, False)], "score double, a boolean, b boolean")
    score, names = evidence.capped(F.col("score"), {"unsafe": F.col("a"), "no_conversion_path": F.col("b")})
    both = ["unsafe", "no_conversion_path"]
    assert [tuple(r) for r in df.select(score, names).collect()] == [(30.0, both), (75.0, both[1:]), (20.0, both), (90.0, [])]
    events = spark.createDataFrame(
        [("s", 1, "content", 1, "page without title"), ("s", 1, "content", 1, "page without heading"), ("s", 2, "trust", 0, "page without https"), ("s", 3, "technical", 2, "page with many scripts"), ("s", 3, "other", 1, "Odd"), ("t", 1, "content", 2, "page with little text"), ("t", 2, "content", 2, "page with little text")],
        "site_id string, page_id long, category string, rank int, problem string",
    )
    got = [tuple(r) for r in evidence.fix_plan(events).orderBy("site_id", "position").collect()]
    assert got == [("s", 1, "secure_pages", "high", 1, "page without https"), ("s", 2, "name_pages", "medium", 1, "page without heading; page without title"), ("s", 3, "odd", "medium", 1, "Odd"), ("t", 1, "fill_pages", "low", 2, "page with little text")]


def test_chat_facts(spark):
    rows = [(1, 0, "My GOAL: sell more cups\nnext"), (1, 1, "we post on Instagram and facebook; customers include: young cooks"), (2, 0, "facebook only"), (2, 1, None), (2, 2, "Competitor: Pan Ltd")]
    got = sorted(tuple(r) for r in evidence.chat_facts(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect())
    assert got == [(1, 0, "goal", "primary_goal", "sell more cups"), (1, 1, "audience", "target_audience", "young cooks"), (1, 1, "platform", "platforms", "Instagram,Facebook"), (2, 2, "competitor", "mentioned_competitor", "Pan Ltd")]


def test_structured_products_of_any_depth(spark):
    node = {"@type": "Product", "name": "Deep lamp", "offers": {"price": 3}}
    for k in range(8):
        node = {"@graph": [node]} if k % 2 else {"@type": "ItemList", "itemListElement": [{"item": node}, {"item": {"@type": "Product", "name": f"Side {k}", "offers": [{"lowPrice": k}]}}]}
    group = {"@type": "ProductGroup", "name": "Set", "hasVariant": {"@type": "Product", "name": "One of it", "image": {"url": "/i.png"}}}
    pages = spark.createDataFrame([(1, ld(node)), (2, ld(group) + ld("{broken")), (3, None), (4, ld([]))], "page_id long, html string")
    rows = {(r.page_id, r.name): (r.price, r.confidence) for r in evidence.structured_products(pages).collect()}
    assert rows == {(1, "Deep lamp"): ("3", 80), **{(1, f"Side {k}"): (str(k), 80) for k in (0, 2, 4, 6)}, (2, "Set"): (None, 88), (2, "One of it"): (None, 80)}
