"""What kind of site it is, which structured products it lists, which limits hold its score down, and what to mend first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import matches, site_id, url_path, visible_text
from marketloom.functions.work import kept
from marketloom.operators.extraction import calls_to_action, platform
from marketloom.operators.sites import _PROFILE, _VIS, _oracle, page_signals, signals_of, site_profile, site_scores

# Wording and addresses that mark a kind of page.
MARKET_COPY = "sold by|fulfilled by amazon|compare with similar|ships from|seller information|marketplace seller|ad feedback"
MARKET_PATH = "/dp/|/itm/|/gp/product|/listing/"
SERVICE_COPY = r"/book\b|schedule a call|get a quote|our services|book now|consultation"
SERVICE_WORDS = ("/book", "schedule a call", "get a quote", "our services", "book now", "consultation")
SERVICE_ACTION = "quote|consultation|estimate|book"
CONTENT_COPY = "blog|article|read more"
# Highest total score where a fault is present, in the order in which they are listed.
CAPS = [("unsafe", 30), ("homepage_failed", 40), ("no_readable_content", 45), ("model_mismatch", 65), ("mobile_overflow", 70), ("no_conversion_path", 75)]
# Confidence of a structured product by the kind of its node.
PRODUCT_KINDS = {"Product": 92, "ProductGroup": 88}
LISTED = 80

#: What can be wrong with a page: category, rank of its priority (0 is most urgent), words, and when.
PROBLEMS = [("trust", 0, "page without https", "NOT https"), ("content", 1, "page without title", "title = ''"), ("content", 1, "page without heading", "h1 = ''"), ("content", 2, "page with little text", "text_chars < 700"), ("technical", 2, "page with many scripts", "script_heavy")]
#: Rules that gather problems to one task: name, place in the order of trial, category, pattern.
RULES = [("secure_pages", 0, "trust", "https"), ("name_pages", 1, "content", "title|heading"), ("fill_pages", 2, "content", "text"), ("light_pages", 3, "technical", "script")]


#: Where a node of JSON-LD has further nodes; item: those of a list, whose entries may wrap them.
LD_CHILDREN = {"@graph": "", "itemListElement": "item", "hasVariant": "variant", "variesBy": "variant"}


def as_list(v: Column) -> Column:
    """A variant's elements if it is a list, else itself alone."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def children(v: Column, name: str, to: str) -> Column:
    """v and listed: the nodes below by that name, a list's or the one; none if there is none."""
    inner = F.try_variant_get(v, f"$['{name}']", "variant")
    nodes = F.when(inner.isNull(), F.array().cast("array<variant>")).otherwise(as_list(inner))

    def entry(x: Column) -> Column:
        node = F.coalesce(F.try_variant_get(x, "$.item", "variant"), x) if to == "item" else x
        return F.struct(node.alias("v"), F.lit(bool(to)).alias("listed"))

    return F.transform(nodes, entry)


def structured_products(pages: DataFrame) -> DataFrame:
    """page_id, name, price, image, confidence: products of JSON-LD blocks, one row a normalized name of a page, of its highest confidence.

    Blocks that are no JSON are skipped; graphs, list items and variants are entered to any depth; a price is the first offer's price, low or high price.
    """
    get = F.try_variant_get
    blocks = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1))
    nodes = pages.select("page_id", blocks.alias("raw")).select("page_id", F.try_parse_json("raw").alias("v")).where("v is not null")
    nodes = nodes.select("page_id", F.explode(as_list(F.col("v"))).alias("v"), F.lit(False).alias("listed"))
    level = kept(nodes)
    levels = [level]
    while True:  # a round a depth; each reads only what the one before found
        inner = F.concat(*(children(F.col("v"), name, to) for name, to in LD_CHILDREN.items()))
        level = kept(level.select("page_id", F.explode(inner).alias("x")).select("page_id", "x.v", "x.listed"))
        if level.isEmpty():
            break
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels)
    kind, text = get("v", "$['@type']", "string"), lambda *paths: F.coalesce(*(get("v", p, "string") for p in paths))
    sure = F.when(F.col("listed"), F.lit(LISTED))
    for name, points in PRODUCT_KINDS.items():
        sure = sure.when(kind == name, points)
    rows = found.where(kind.isin(*PRODUCT_KINDS)).select(
        "page_id", F.trim(text("$.name")).alias("name"), text("$.offers[0].price", "$.offers.price", "$.offers[0].lowPrice", "$.offers.lowPrice", "$.offers[0].highPrice", "$.offers.highPrice").alias("price"),
        text("$.image[0].url", "$.image[0]", "$.image.url", "$.image").alias("image"), sure.alias("confidence"),
    )
    rows = rows.where("name != ''").withColumn("key", F.lower(F.regexp_replace("name", r"\s+", " ")))
    best = rows.groupBy("page_id", "key").agg(F.max(F.struct("confidence", "name", "price", "image")).alias("best"))
    return best.select("page_id", "best.name", "best.price", "best.image", "best.confidence")


def page_hints(pages: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """page_id, site_id, platform, the signs of its kind as booleans, service_action, and hint."""
    html, url = F.col("html"), F.col("url")
    low = F.lower(visible_text(html))
    rows = pages.select("page_id", site_id(url).alias("site_id"), url_path(url).alias("path"), platform(html).alias("platform"), low.alias("text"), F.array_join(calls_to_action(html), " ").alias("actions"))
    sure = (structured_products(pages) if products is None else products).groupBy("page_id").agg(F.count_if(F.col("confidence") >= 70).alias("sure_products"))
    rows = rows.select(
        "page_id", "site_id", "platform", matches(F.col("text"), MARKET_COPY).alias("market_copy"), F.col("path").rlike(f"(?i){MARKET_PATH}").alias("market_path"), F.col("text").contains("sponsored").alias("sponsored"),
        matches(F.col("text"), SERVICE_COPY, SERVICE_WORDS).alias("service_copy"), (F.size(F.regexp_extract_all("text", F.lit(CONTENT_COPY), 0)) >= 3).alias("content_heavy"), F.col("actions").rlike(f"(?i){SERVICE_ACTION}").alias("service_action"),
    ).join(sure, "page_id", "left").withColumn("sure_products", F.coalesce("sure_products", F.lit(0)))
    market = F.col("market_copy").cast("int") + F.col("market_path").cast("int") + (F.col("sponsored") & (F.col("market_copy") | F.col("market_path"))).cast("int") >= 2
    hint = F.when(F.col("service_copy"), "service").when(market, "marketplace").when(F.col("platform") == "Shopify", "shopify_dtc").when(F.col("sure_products") > 0, "single_brand_ecommerce").when(F.col("content_heavy"), "content_social")
    return rows.withColumn("hint", hint.otherwise("unknown"))


def site_classes(hints: DataFrame) -> DataFrame:
    """One row a site: votes of its pages by kind, the kind that they decide, and how sure it is."""
    vote = lambda kind: F.count_if(F.col("hint") == kind)
    votes = hints.groupBy("site_id").agg(
        vote("marketplace").alias("marketplace"), vote("shopify_dtc").alias("shopify"), vote("single_brand_ecommerce").alias("ecommerce"), vote("service").alias("service"), vote("content_social").alias("content"),
        F.bool_or("market_copy").alias("copy"), F.bool_or("market_path").alias("path"), F.bool_or("service_action").alias("lean"), F.sum("sure_products").alias("products"),
    )
    served = F.col("service") > 0
    market = (F.col("marketplace") >= 2) | (~served & F.col("copy") & F.col("path"))
    shop, store, lean = F.col("shopify") > 0, (F.col("ecommerce") > 0) | (F.col("products") >= 2), served | F.col("lean")
    leads = lean & (F.col("service") >= F.col("ecommerce"))
    cases = [(market, "marketplace", 85), (shop & lean, "service", 68), (shop, "shopify_dtc", 80), (store & leads, "service", 66), (store, "single_brand_ecommerce", 75), (served & (F.col("service") >= F.col("content")), "service", 70), (F.col("content") > 0, "content_social", 65)]
    choose = lambda place, other: reduce(lambda x, c: x.when(c[0], c[place]), cases[1:], F.when(cases[0][0], cases[0][place])).otherwise(other)
    return votes.select("site_id", "marketplace", "shopify", "ecommerce", "service", "content", choose(1, "unknown").alias("kind"), choose(2, 40).alias("confidence"))


def capped(score: Column, faults: dict[str, Column]) -> tuple[Column, Column]:
    """The score under the caps of its faults, and the names of all faults that hold, whether or not they bind."""
    held = [(name, cap, faults[name]) for name, cap in CAPS if name in faults]
    low = F.least(score, *(F.when(test, F.lit(float(cap))).otherwise(score) for _, cap, test in held))
    return low, F.array_compact(F.array(*(F.when(test, name) for name, _, test in held)))


def problems(signals: DataFrame) -> DataFrame:
    """site_id, page_id, category, rank and problem: a row for each fault of each page."""
    tests = F.array(*(F.when(F.expr(test), F.struct(F.lit(c).alias("category"), F.lit(r).alias("rank"), F.lit(w).alias("problem"))) for c, r, w, test in PROBLEMS))
    return signals.select("site_id", "page_id", F.explode(F.array_compact(tests)).alias("p")).select("site_id", "page_id", "p.*")


def clustered(events: DataFrame, rules: list[tuple[str, int, str, str]]) -> DataFrame:
    """Events with cluster: the first rule of their category whose pattern their words match, else the words themselves. The rules are few, given in code."""
    case = reduce(lambda x, r: x.when((F.col("category") == r[2]) & F.col("problem").rlike(f"(?i){r[3]}"), r[0]), sorted(rules, key=lambda r: r[1]), F.when(F.lit(False), ""))
    return events.withColumn("cluster", case.otherwise(F.lower("problem")))


def fix_plan(events: DataFrame, rules: list = RULES, most: int = 9) -> DataFrame:
    """The most urgent clusters of each site: highest priority, pages, up to three kinds of evidence; the least urgent need two pages."""
    groups = clustered(events, rules).groupBy("site_id", "cluster").agg(F.min("rank").alias("rank"), F.countDistinct("page_id").alias("pages"), F.slice(F.array_sort(F.collect_set("problem")), 1, 3).alias("evidence"))
    own = Window.partitionBy("site_id").orderBy("rank", F.col("pages").desc(), "cluster")
    plan = groups.where("rank < 2 or pages >= 2").withColumn("position", F.row_number().over(own)).where(F.col("position") <= most)
    return plan.select("site_id", "position", "cluster", F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("rank") + 1).alias("priority"), "pages", F.array_join("evidence", "; ").alias("evidence"))


def chat_facts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, kind, key, value: goal, platforms, audience and competitor that a message names."""
    text = F.col("text")
    named = lambda pattern, group: F.nullif(F.trim(F.regexp_extract(text, f"(?i){pattern}", group)), F.lit(""))
    low = F.lower(text)
    places = F.array_join(F.array_compact(F.array(*(F.when(low.contains(p.lower()), p) for p in ("TikTok", "Instagram", "Facebook")))), ",")
    facts = [
        ("goal", "primary_goal", named(r"goal[:\s]+(.{5,120})", 1)), ("platform", "platforms", F.when(low.contains("tiktok") | low.contains("instagram"), places)),
        ("audience", "target_audience", named(r"customers? (?:are|include)[:\s]+(.{5,120})", 1)), ("competitor", "mentioned_competitor", named(r"competitor[:\s]+(.{3,80})", 1)),
    ]
    found = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), v.alias("value"))) for kind, key, v in facts)))
    return turns.select("conv_id", "turn", F.explode(found).alias("f")).select("conv_id", "turn", "f.*")


def site_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_classes(page_hints(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def site_capped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of sites under the caps that their pages call for: no home page, little text, no action to take."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    paths = pages.select(site_id(F.col("url")).alias("site_id"), (F.size(calls_to_action(F.col("html"))) > 0).alias("acts")).groupBy("site_id").agg(F.bool_or("acts").alias("acts"))
    profile = site_profile(page_signals(pages))
    rows = profile.select("site_id", "has_homepage", "text_chars").join(site_scores(profile).select("site_id", "score"), "site_id").join(paths, "site_id")
    score, faults = capped(F.col("score"), {"homepage_failed": ~F.col("has_homepage"), "no_readable_content": F.col("text_chars") < 200, "no_conversion_path": ~F.col("acts")})
    return rows.select("site_id", "score", score.alias("capped_score"), F.array_join(faults, ",").alias("caps"))


def site_fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_plan(problems(signals_of(spark, sf_dir)))


def conversation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_facts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _oracles() -> dict[str, str]:
    from marketloom.operators.extraction import ACTION, PLATFORMS

    acts = f"list_filter(list_transform(regexp_extract_all(html, '<(?:a|button)(?:\\s[^>]*)?>(.*?)</(?:a|button)>', 1, 'is'), lambda x: {_VIS.format('x')}), lambda x: x != '' AND length(x) <= 40 AND regexp_matches(x, '{ACTION}', 'i'))"
    host = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m|blog)\.', '')"
    kinds = " ".join(f"WHEN regexp_matches(lower(html), '{p}') THEN '{n}'" for n, p in PLATFORMS)
    events = " UNION ALL ".join(f"SELECT site_id, page_id, '{c}' AS category, {r} AS rank, '{w}' AS problem FROM s WHERE {test}" for c, r, w, test in PROBLEMS)
    rules = " ".join(f"WHEN category = '{c}' AND regexp_matches(problem, '{p}', 'i') THEN '{n}'" for n, _, c, p in RULES)
    # the tables hold no structured products, so these queries' SQL counts none
    return {
        "site_classification": f"""WITH t AS (SELECT page_id, {host} AS site_id, lower({_VIS.format("html")}) AS txt, url, CASE {kinds} ELSE 'unknown' END AS platform, array_to_string({acts}, ' ') AS actions FROM pages),
f AS (SELECT *, regexp_matches(txt, '{MARKET_COPY}') AS c, regexp_matches(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '{MARKET_PATH}', 'i') AS p, regexp_matches(txt, '{SERVICE_COPY}') AS sv, len(regexp_extract_all(txt, '{CONTENT_COPY}')) >= 3 AS ch, regexp_matches(actions, '{SERVICE_ACTION}', 'i') AS act FROM t),
h AS (SELECT *, CASE WHEN sv THEN 'service' WHEN CAST(c AS INT) + CAST(p AS INT) + CAST(contains(txt, 'sponsored') AND (c OR p) AS INT) >= 2 THEN 'marketplace' WHEN platform = 'Shopify' THEN 'shopify_dtc' WHEN ch THEN 'content_social' ELSE 'unknown' END AS hint FROM f),
v AS (SELECT site_id, count(*) FILTER (hint = 'marketplace') AS marketplace, count(*) FILTER (hint = 'shopify_dtc') AS shopify, CAST(0 AS BIGINT) AS ecommerce, count(*) FILTER (hint = 'service') AS service, count(*) FILTER (hint = 'content_social') AS content, bool_or(c) AS c, bool_or(p) AS p, bool_or(act) AS act FROM h GROUP BY 1),
k AS (SELECT *, CASE WHEN marketplace >= 2 OR (service = 0 AND c AND p) THEN 1 WHEN shopify > 0 AND (service > 0 OR act) THEN 2 WHEN shopify > 0 THEN 3 WHEN service > 0 AND service >= content THEN 4 WHEN content > 0 THEN 5 ELSE 6 END AS n FROM v)
SELECT site_id, marketplace, shopify, ecommerce, service, content, ['marketplace', 'service', 'shopify_dtc', 'service', 'content_social', 'unknown'][n] AS kind, [85, 68, 80, 70, 65, 40][n] AS confidence FROM k""",
        "site_capped_scores": _oracle() + _PROFILE
        + f""", a AS (SELECT {host} AS site_id, bool_or(len({acts}) > 0) AS acts FROM pages GROUP BY 1),
q AS (SELECT site_id, text_chars, has_homepage, floor(10 * CASE WHEN text_chars >= 3000 THEN 1 WHEN text_chars >= 1800 THEN 0.66 WHEN text_chars >= 700 THEN 0.33 ELSE 0 END + 0.5) + floor(6 * CASE WHEN distinct_pages >= 5 THEN 1 WHEN distinct_pages >= 3 THEN 0.66 ELSE 0.33 END + 0.5) + CASE WHEN all_https THEN 4 ELSE 0 END AS points FROM p),
g AS (SELECT *, CAST(least(100, CASE WHEN text_chars < 200 THEN least(40, floor(100.0 * points / 20 + 0.5)) ELSE floor(100.0 * points / 20 + 0.5) END) AS DOUBLE) AS score FROM q)
SELECT site_id, score, CAST(least(score, CASE WHEN NOT has_homepage THEN 40 ELSE 100 END, CASE WHEN text_chars < 200 THEN 45 ELSE 100 END, CASE WHEN NOT acts THEN 75 ELSE 100 END) AS DOUBLE) AS capped_score,
concat_ws(',', CASE WHEN NOT has_homepage THEN 'homepage_failed' END, CASE WHEN text_chars < 200 THEN 'no_readable_content' END, CASE WHEN NOT acts THEN 'no_conversion_path' END) AS caps FROM g JOIN a USING (site_id)""",
        "site_fix_plan": _oracle()
        + f""", e AS ({events}), c AS (SELECT *, CASE {rules} ELSE lower(problem) END AS cluster FROM e), g AS (SELECT site_id, cluster, min(rank) AS rank, count(DISTINCT page_id) AS pages, array_to_string(list_slice(list_sort(list(DISTINCT problem)), 1, 3), '; ') AS evidence FROM c GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY rank, pages DESC, cluster) AS INT) AS position FROM g WHERE rank < 2 OR pages >= 2) SELECT site_id, position, cluster, ['high', 'medium', 'low'][rank + 1] AS priority, pages, evidence FROM r WHERE position <= 9""",
        "conversation_facts": r"""WITH f AS (SELECT conv_id, turn, unnest([{'kind': 'goal', 'key': 'primary_goal', 'value': trim(regexp_extract(text, 'goal[:\s]+(.{5,120})', 1, 'i'))},
{'kind': 'platform', 'key': 'platforms', 'value': CASE WHEN text ILIKE '%tiktok%' OR text ILIKE '%instagram%' THEN concat_ws(',', CASE WHEN text ILIKE '%tiktok%' THEN 'TikTok' END, CASE WHEN text ILIKE '%instagram%' THEN 'Instagram' END, CASE WHEN text ILIKE '%facebook%' THEN 'Facebook' END) ELSE '' END},
{'kind': 'audience', 'key': 'target_audience', 'value': trim(regexp_extract(text, 'customers? (?:are|include)[:\s]+(.{5,120})', 1, 'i'))}, {'kind': 'competitor', 'key': 'mentioned_competitor', 'value': trim(regexp_extract(text, 'competitor[:\s]+(.{3,80})', 1, 'i'))}]) AS f FROM conversations)
SELECT conv_id, turn, f.kind AS kind, f.key AS key, f.value AS value FROM f WHERE f.value != ''""",
    }


QUERIES = {f.__name__: f for f in (site_classification, site_capped_scores, site_fix_plan, conversation_facts)}
ORACLES = _oracles()
