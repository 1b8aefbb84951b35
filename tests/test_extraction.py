"""Crawl rules, link resolution, chunks, boxes, contrast and score helpers on small tables."""

from pyspark.sql import functions as F

from marketloom.functions import columns
from marketloom.operators import extraction, layout, scores

BOX = "struct<left:double,top:double,width:double,height:double>"


def test_resolved_links(spark):
    base = "https://www.a.example/shop/list?x=1"
    cases = {"/b": "https://www.a.example/b", "c/d": "https://www.a.example/shop/c/d", "//b.example/x": "https://b.example/x", "http://b.example": "http://b.example", "mailto:x@y.example": None, "#top": None, "?p=2": "https://www.a.example/shop/list?p=2", "": None, "tel:1": None}
    rows = spark.createDataFrame([(k, base) for k in cases], "href string, base string").select("href", extraction.resolved(F.col("href"), F.col("base")).alias("to")).collect()
    assert {r.href: r.to for r in rows} == cases
    rows = spark.createDataFrame([("b", "https://a.example")], "href string, base string").select(extraction.resolved(F.col("href"), F.col("base")).alias("to")).collect()
    assert rows[0].to == "https://a.example/b"


def test_robots_and_sitemaps(spark):
    text = "# note\nUser-agent: *\nDisallow: /cart\nDisallow:\nDisallow: /admin\r\nSitemap: https://a.example/s.xml\nUser-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /late"
    rules = extraction.robots_rules(spark.createDataFrame([("a.example", text), ("b.example", "User-agent: *\nDisallow: /"), ("c.example", None)], "site_id string, text string"))
    assert sorted(map(tuple, rules.collect())) == [("a.example", "/admin"), ("a.example", "/cart"), ("b.example", "/")]
    targets = spark.createDataFrame([("a.example", "https://a.example/cart/1"), ("a.example", "https://a.example/x"), ("b.example", "https://b.example"), ("c.example", "https://c.example/y")], "site_id string, target string")
    assert sorted(r.target for r in extraction.allowed(targets, rules).collect()) == ["https://a.example/x", "https://c.example/y"]
    xml = "<urlset><url><loc> https://www.a.example/p </loc></url><url><loc>https://b.example/q</loc></url></urlset>"
    assert [tuple(r) for r in extraction.sitemap_urls(spark.createDataFrame([("a.example", xml)], "site_id string, xml string")).collect()] == [("a.example", "https://www.a.example/p", False)]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, None), (3, " \n "), (4, "x" * 9)], "doc_id long, text string")
    assert sorted(map(tuple, extraction.chunks(docs, 5).collect())) == [(1, 0, "aa bb"), (1, 1, "cc dd"), (4, 0, "x" * 9)]


def test_meta_in_either_order(spark):
    rows = [('<meta name="description" content="a b">',), ('<meta content="c" name="description"/>',), ("<p>",)]
    assert [r[0] for r in spark.createDataFrame(rows, "html string").select(extraction.meta_content(F.col("html"), "description")).collect()] == ["a b", "c", ""]


def test_boxes(spark):
    blocks = spark.createDataFrame([(1, 1, 10, (0.0, 0.0, 10.0, 10.0)), (1, 2, 5, (1.0, 1.0, 2.0, 2.0)), (1, 3, 5, (20.0, 0.0, 5.0, 5.0)), (2, 1, 5, (0.0, 0.0, 5.0, 5.0)), (2, 2, 5, (0.0, 0.0, 5.0, 5.0))], f"page_id long, block_id long, characters int, bbox {BOX}")
    assert sorted((r.page_id, r.block_id) for r in layout.leaf_blocks(blocks).collect()) == [(1, 1), (1, 3)]
    assert sorted(map(tuple, layout.overlapping(blocks).collect())) == [(1, 1), (2, 1)]
    images = spark.createDataFrame([(1, 1, "own", (0.0, 0.0, 4.0, 4.0)), (1, 2, "own", (90.0, 0.0, 4.0, 4.0)), (1, 3, None, (90.0, 0.0, 4.0, 4.0))], f"page_id long, image_id long, section_id string, bbox {BOX}")
    sections = spark.createDataFrame([(1, "hero", 0, (0.0, 0.0, 9.0, 9.0)), (1, "all", 1, (0.0, 0.0, 50.0, 50.0))], f"page_id long, id string, place int, bbox {BOX}")
    assert {r.image_id: r.section for r in layout.in_sections(images, sections).collect()} == {1: "hero", 2: "own", 3: "ungrouped"}


def test_contrast(spark):
    rows = [(1, "rgb(0, 0, 0)", "rgb(255, 255, 255)"), (1, "rgba(0,0,0,1)", None), (1, "rgb(255,255,255)", None), (1, "red", None)]
    (r,) = layout.contrast_statistics(spark.createDataFrame(rows, "page_id long, color string, background string")).collect()
    assert tuple(r) == (1, 21.0, 21.0, 21.0, 2, True)


def test_score_helpers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    none = F.lit(None).cast("double")
    assert value(scores.human_score(none, none, [F.lit(30.0), F.lit(33.0)])) == 12.6 and value(scores.human_score(F.lit(85.0), none, [none])) == 17.0
    assert [value(scores.level(F.lit(x))) for x in (20.0, 18.2, 15.9, 12.9)] == ["elite", "strong", "low", "major_issue"]
    assert [value(scores.ux_target(F.lit(x))) for x in (17.4, 16.9)] == [17.0, 15.0]
    assert value(scores.adjusted(F.lit(10.0), F.lit(17.0))) == 12.0 and value(scores.adjusted(F.lit(10.0), none)) == 10.0
    assert value(scores.blended(F.lit(16.0), F.lit(10.0), F.lit(True), none, none)) == 15.0
    assert [value(scores.truth(F.lit(x))) for x in ("true", "0", "no", "", None)] == [True, False, True, False, False]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert scores.matching(rows, x=None, y="b").count() == 1 and scores.matching(rows, x=None, y=None).count() == 2


def test_reports(spark, tmp_path):
    import json

    from marketloom.operators.association import category_breakdown, contingency, feature_summary
    from marketloom.sources.files import read_csv
    from marketloom.sources.reports import write_association_report, write_batch_results

    rows = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "x", 1), ("b", "y,z", 0)] * 5, "f string, g string, t int")
    table = contingency(rows, ["f", "g"], "t")
    write_association_report(rows.groupBy("t").count(), feature_summary(table), category_breakdown(table), str(tmp_path / "r"))
    assert {r.category for r in read_csv(spark, str(tmp_path / "r" / "categories"), ["feature_name", "category"]).collect()} == {"a", "b", "x", "y", "y,z"}
    nested = [json.loads(line) for p in (tmp_path / "r" / "features").glob("part-*") for line in p.read_text().splitlines()]
    assert {x["feature_name"]: [c["category"] for c in x["categories"]] for x in nested} == {"f": ["a", "b"], "g": ["x", "y", "y,z"]}
    write_batch_results(rows, ["f", "g"], str(tmp_path / "b"))
    assert {r.g: int(r.n) for r in read_csv(spark, str(tmp_path / "b" / "by_g"), ["g", "n"]).collect()} == {"x": 10, "y": 5, "y,z": 5}


def test_retention_advice(spark):
    columns = [*scores.ADD_ONS, "Contract", "PaperlessBilling"]
    rows = spark.createDataFrame([(True, *["No"] * 6, "Month-to-month", "No"), (False, *["Yes"] * 5, None, "Two year", "Yes")], "predicted_churn boolean, " + ", ".join(f"{c} string" for c in columns))
    first, second = (r.advice for r in scores.retention_advice(rows).collect())
    assert first == ["prioritize_retention", *(f"offer:{c}" for c in scores.ADD_ONS), "longer_contract"] and second == ["prevent_and_upsell", "targeted_offer", "review_tickets"]


def test_dots_are_folded(spark):
    urls = {"https://a.b/x/../y": "https://a.b/y", "https://a.b/x/./y/.": "https://a.b/x/y/", "https://a.b/../../y?q=../z": "https://a.b/y?q=../z", "https://a.b/x/y/..": "https://a.b/x/", "https://a.b/x/...": "https://a.b/x/...", "https://a.b": "https://a.b", "https://a.b/.well/x": "https://a.b/.well/x"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", columns.folded_dots(F.col("u")).alias("f")).collect()
    assert {r.u: r.f for r in rows} == urls


def test_wave_obeys_rules_and_reads_sitemaps(spark):
    pages = spark.createDataFrame([(1, "https://a.b/d/p", '<a href="../x"></a><a href="/x"></a><a href="./about"></a><a href="/private/z"></a><a href="/cart"></a>')], "page_id long, url string, html string")
    targets = extraction.link_targets(pages)
    assert sorted(r.target for r in targets.collect()) == ["https://a.b/cart", "https://a.b/d/about", "https://a.b/private/z", "https://a.b/x"]
    links = targets.groupBy("site_id", "target").agg(F.count("*").alias("pages")).withColumn("held", F.lit(False))
    rules = extraction.robots_rules(spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /private")], "site_id string, text string"))
    mapped = spark.createDataFrame([("a.b", "https://a.b/faq/"), ("a.b", "https://a.b/x")], "site_id string, url string")
    rows = extraction.crawl_wave(links, rules=rules, mapped=mapped).orderBy("position").collect()
    assert [(r.target, r.priority, r.pages) for r in rows] == [("https://a.b/d/about", 4, 1), ("https://a.b/faq", 7, 0), ("https://a.b/x", 50, 1)]


def test_wave_compiles(spark):
    plan = extraction.next_wave(spark, "/root/testdata/sf0.001")
    plan.collect()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan._jdf.queryExecution().executedPlan())
    sizes = [code.apply(k)._3().maxMethodCodeSize() for k in range(code.length())]
    assert sizes and all(0 < x < 65_536 for x in sizes)  # -1: a stage that fails to compile
