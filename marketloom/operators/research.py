"""Quick scans of sites and what they say for a business: five scores by point rows, their weighted sum, strengths, risks and next actions.

A scan reads the first 2500 characters of each page's visible text, all links, and title, description and headline of the home page (the page of that type with
the least page_id, else the site's first page). Points and lines are rows (``POINTS``, ``LINES``): a score or list, a value, and when it holds, in SQL on the scan.
Defined cases: a site without a home page is read from its first page; what is unknown of the business or of search results counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.columns import computed, page_type, rounded, site_id, tag_text, visible_text
from marketloom.operators.extraction import meta_content, resolved
from marketloom.operators.page_tree import SOCIAL

SAMPLE, MOST_LINES = 2500, 6
# Words that are looked for, and parts of links that show a page of a kind, the first of each kind counts.
KEYWORDS = {
    "product": ["shop", "buy", "product", "collection", "add to cart", "price", "subscribe", "book now"], "trust": ["review", "testimonial", "trusted", "guarantee", "secure checkout", "customer"],
    "action": ["buy", "shop", "book", "start", "subscribe", "get started", "order"],
}
PAGE_HINTS = {"shipping_policy": "ship|delivery", "return_policy": "return|refund", "privacy_policy": "privacy", "contact_page": "contact|support", "about_page": "about|our-story|story"}
BLOG_LINKS = "blog|article|news|journal"
VALUE_WORDS = "value|best|premium|free|save"
MARKET_WORDS = {"trend": "trend|growing|demand|market", "rival": "competitor|brand|successful|leader", "example": "example|case study|top"}
# What each score begins with, its weight, and its points.
STARTS = {"store_score": (40, 0.22), "trust_score": (35, 0.22), "content_score": (40, 0.18), "offer_score": (45, 0.18), "market_score": (40, 0.20)}
POINTS = [
    ("store_score", 15, "true"), ("store_score", 15, "https"), ("store_score", 10, "length(title) > 3"), ("store_score", 10, "length(description) > 20"), ("store_score", 10, "h1 != ''"), ("store_score", 10, "product_words >= 2"), ("store_score", 10, "social > 0"),
    ("trust_score", 12, "contact_page != ''"), ("trust_score", 10, "about_page != ''"), ("trust_score", 12, "shipping_policy != ''"), ("trust_score", 12, "return_policy != ''"), ("trust_score", 10, "privacy_policy != ''"), ("trust_score", 9, "trust_words >= 2"),
    ("content_score", 15, "social > 0"), ("content_score", 15, "blog_links > 0"), ("content_score", 10, "product_words >= 3"), ("content_score", 10, "text_length > 800"), ("content_score", 10, "text_length > 2000"),
    ("offer_score", 15, "product_sold != ''"), ("offer_score", 15, "target_customers != ''"), ("offer_score", 10, "h1 != ''"), ("offer_score", 15, "action_words >= 2"), ("offer_score", 10, "valued"),
    ("market_score", 15, "results >= 3"), ("market_score", 10, "results >= 8"), ("market_score", 10, "market_trend"), ("market_score", 10, "market_rival"), ("market_score", 10, "market_example"), ("market_score", 5, "queries >= 4"),
]
# Lines of the three lists in their order; {h1} and the like stand for the scan's own.
LINES = [
    ("strengths", "Store uses HTTPS for secure browsing.", "https"), ("strengths", 'Clear homepage headline: "{h1}".', "h1 != ''"), ("strengths", "Social profiles linked from the website.", "social > 0"), ("strengths", "Shipping and return policy pages are discoverable.", "shipping_policy != '' AND return_policy != ''"),
    ("strengths", "Clear product focus: {product_sold}.", "product_sold != ''"), ("strengths", "Defined audience: {target_customers}.", "target_customers != ''"), ("strengths", "Market research returned useful public signals.", "results >= 5"), ("strengths", "Store presentation score is strong.", "store_score >= 75"),
    ("risks", "Site may not be served over HTTPS.", "NOT https"), ("risks", "Missing or weak meta description for SEO and clarity.", "description = ''"), ("risks", "No clear H1 headline detected on the homepage.", "h1 = ''"), ("risks", "Return policy page not detected.", "return_policy = ''"), ("risks", "Shipping policy page not detected.", "shipping_policy = ''"),
    ("risks", "No social profile links found on the site.", "social = 0"), ("risks", "Trust signals need improvement before scaling traffic.", "trust_score < 55"), ("risks", "Limited market/competitor signals from search research.", "market_score < 55"),
    ("actions", "Add a clear H1 that states your main product and who it is for.", "h1 = ''"), ("actions", "Publish a shipping policy page and link it in the footer.", "shipping_policy = ''"), ("actions", "Publish a return policy to reduce purchase hesitation.", "return_policy = ''"), ("actions", "Link Instagram or TikTok from your homepage.", "social = 0"),
    ("actions", "Sharpen your hero offer with a direct CTA above the fold.", "offer_score < 65"), ("actions", "Add product education content or a simple blog/resources section.", "content_score < 65"), ("actions", "Review competitor search results and differentiate your offer.", "market_score < 65"),
]


def scanned_pages(pages: DataFrame) -> DataFrame:
    """A row a page: its text sample, distinct links, title, description, first headline and whether it is a home page."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    hrefs = F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"']"), 1)
    usable = F.filter(hrefs, lambda x: ~F.trim(x).rlike("^(?:#|mailto:|tel:)") & (F.trim(x) != ""))
    description = meta_content(html, "description")
    description = F.when(description != "", description).otherwise(meta_content(html, "og:description"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", site_id(url).alias("site_id"), (page_type(url) == "homepage").alias("is_home"), F.substring(visible_text(html), 1, SAMPLE).alias("text"), tag_text(html, "title").alias("title"), tag_text(html, "h1").alias("h1"),
        F.trim(description).alias("description"), F.array_distinct(usable).alias("hrefs"),
    )


def scan_links(scanned: DataFrame) -> DataFrame:
    """site_id, page_id, place, link: absolute links of scanned pages, in their order."""
    rows = scanned.select("site_id", "page_id", "url", F.posexplode("hrefs").alias("place", "href"))
    return computed(rows, {"link": resolved(F.col("href"), F.col("url"))}).where("link is not null").select("site_id", "page_id", "place", "link")


def site_scans(pages: DataFrame) -> DataFrame:
    """One row a site: the home page's own texts, the first link to each kind of page, keywords and links of all its pages."""
    scanned = scanned_pages(pages)
    link, low = F.col("link"), F.lower("text")
    own = F.regexp_replace(F.lower(F.regexp_extract("link", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    first = lambda p: F.min(F.when(link.rlike(f"(?i){p}"), F.struct("page_id", "place", "link")))["link"]
    links = scan_links(scanned).groupBy("site_id").agg(
        *(first(p).alias(k) for k, p in PAGE_HINTS.items()), F.countDistinct(F.when(own.rlike("|".join(s.replace(".", r"\.") for s in SOCIAL)), link)).alias("social"), F.countDistinct(F.when(link.rlike(f"(?i){BLOG_LINKS}"), link)).alias("blogs"),
    )
    hits = [F.bool_or(low.contains(w)).cast("int") for words in KEYWORDS.values() for w in words]
    names = [f"{kind}_{k}" for kind, words in KEYWORDS.items() for k in range(len(words))]
    home = F.min_by(F.struct("url", "title", "h1", "description"), F.struct(~F.col("is_home"), F.col("page_id")))
    rows = scanned.groupBy("site_id").agg(home.alias("home"), F.count("*").alias("pages"), (F.sum(F.length("text")) + F.count("*") - 1).alias("text_length"), *(h.alias(n) for h, n in zip(hits, names, strict=True)))
    words = [sum((F.col(n) for n in names if n.startswith(f"{kind}_")), F.lit(0)).alias(f"{kind}_words") for kind in KEYWORDS]
    rows = rows.select("site_id", "pages", "text_length", F.col("home.url").startswith("https://").alias("https"), "home.title", "home.h1", "home.description", *words).join(links, "site_id", "left")
    rows = rows.withColumn("valued", F.col("description").rlike(f"(?i){VALUE_WORDS}")).withColumn("blog_links", F.least(F.lit(5), F.coalesce("blogs", F.lit(0)))).drop("blogs")
    return rows.na.fill(0, ["social"]).na.fill("", list(PAGE_HINTS))


def found_online(results: DataFrame) -> DataFrame:
    """site_id, results, queries and the market's signs of results(site_id, query, title, snippet)."""
    blob = F.lower(F.concat_ws(" ", "title", "snippet"))
    return results.groupBy("site_id").agg(F.count("*").alias("results"), F.countDistinct("query").alias("queries"), *(F.bool_or(blob.rlike(p)).alias(f"market_{k}") for k, p in MARKET_WORDS.items()))


def research_scores(scans: DataFrame, business: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """Scans with the five scores and overall_score. business(site_id, product_sold, target_customers); results as of found_online()."""
    rows = scans
    for other in (business, None if results is None else found_online(results)):
        rows = rows if other is None else rows.join(other, "site_id", "left")
    absent = {"product_sold": F.lit(""), "target_customers": F.lit(""), "results": F.lit(0), "queries": F.lit(0)} | {f"market_{k}": F.lit(False) for k in MARKET_WORDS}
    rows = rows.withColumns({c: F.coalesce(F.col(c), x) if c in rows.columns else x for c, x in absent.items()})
    scores = {name: F.greatest(F.lit(0), F.least(F.lit(100), sum((F.when(F.expr(test), n).otherwise(0) for of, n, test in POINTS if of == name), F.lit(start)))) for name, (start, _) in STARTS.items()}
    rows = computed(rows, scores)
    whole = sum((F.col(name) * F.lit(weight).cast("decimal(3,2)") for name, (_, weight) in STARTS.items()), F.lit(0).cast("decimal(3,2)"))
    return rows.withColumn("overall_score", rounded(whole.cast("double")).cast("int"))


def lines_of(name: str) -> Column:
    """The first six lines of a list that hold."""

    def text(line: str) -> Column:
        for field in ("h1", "product_sold", "target_customers"):
            before, found, after = line.partition("{" + field + "}")
            if found:
                return F.concat(F.lit(before), F.col(field), F.lit(after))
        return F.lit(line)

    return F.slice(F.array_distinct(F.array_compact(F.array(*(F.when(F.expr(test), text(line)) for of, line, test in LINES if of == name)))), 1, MOST_LINES)


def market_merged(own: Column, web: Column) -> Column:
    """A market score with that of the website: four fifths and one; a website score that is missing or 0 counts as 50."""
    return rounded(own * 0.8 + F.when(F.coalesce(web, F.lit(0)) == 0, 50).otherwise(web) * 0.2)


def site_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = research_scores(site_scans(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return rows.select("site_id", "pages", "text_length", *STARTS, "overall_score", *(F.array_join(lines_of(name), " | ").alias(name) for name in ("strengths", "risks", "actions")))


def _oracles() -> dict[str, str]:
    from marketloom.operators.sites import _VIS

    vis = _VIS.format
    host = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m|blog)\.', '')"
    root = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)"
    meta = lambda n: f"coalesce(nullif(regexp_extract(html, '<meta[^>]+(?:name|property)=\"{n}\"[^>]*content=\"([^\"]*)\"', 1, 'i'), ''), regexp_extract(html, '<meta[^>]+content=\"([^\"]*)\"[^>]*(?:name|property)=\"{n}\"', 1, 'i'))"
    tag = lambda t: vis(f"regexp_extract(html, '<{t}[^>]*>(.*?)</{t}>', 1, 'is')")
    hints = ", ".join(f"coalesce(arg_min(link, page_id * 100000 + place) FILTER (regexp_matches(link, '{p}', 'i')), '') AS {k}" for k, p in PAGE_HINTS.items())
    words = ", ".join(" + ".join(f"CAST(bool_or(contains(lower(text), '{w}')) AS INT)" for w in ws) + f" AS {kind}_words" for kind, ws in KEYWORDS.items())
    score = lambda name: f"least(100, {STARTS[name][0]}" + "".join(f" + CASE WHEN {test} THEN {n} ELSE 0 END" for of, n, test in POINTS if of == name) + f") AS {name}"
    text = lambda line: "'" + line.replace("'", "''").replace("{h1}", "' || h1 || '").replace("{product_sold}", "").replace("{target_customers}", "") + "'"
    lines = lambda name: "array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN {test} THEN {text(line)} END" for of, line, test in LINES if of == name) + f"], lambda x: x IS NOT NULL), 1, 6), ' | ') AS {name}"
    blank = "'' AS product_sold, '' AS target_customers, 0 AS results, 0 AS queries, false AS market_trend, false AS market_rival, false AS market_example"
    whole = " + ".join(f"{name} * {int(weight * 100)}" for name, (_, weight) in STARTS.items())
    # the given pages link by absolute paths alone
    return {
        "site_research": f"""WITH p AS (SELECT page_id, url, {host} AS site_id, regexp_matches(CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) END, '^/$|^/home/?$') AS is_home, substring({vis("html")}, 1, {SAMPLE}) AS text, {tag("title")} AS title, {tag("h1")} AS h1, trim(CASE WHEN {meta("description")} != '' THEN {meta("description")} ELSE {meta("og:description")} END) AS description, regexp_extract_all(html, '<a[^>]+href=["'']([^"'']+)["'']', 1, 'i') AS hrefs FROM pages),
k AS (SELECT site_id, page_id, place, {root} || regexp_replace(trim(href), '#.*$', '') AS link FROM (SELECT site_id, page_id, url, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS place FROM p)),
n AS (SELECT site_id, {hints}, count(DISTINCT link) FILTER (regexp_matches(regexp_replace(lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', ''), '{"|".join(s.replace(".", "[.]") for s in SOCIAL)}')) AS social, least(5, count(DISTINCT link) FILTER (regexp_matches(link, '{BLOG_LINKS}', 'i'))) AS blog_links FROM k GROUP BY 1),
s AS (SELECT site_id, count(*) AS pages, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS text_length, arg_min({{'u': url, 't': title, 'h': h1, 'd': description}}, (CASE WHEN is_home THEN 0 ELSE 1 END) * 1000000000 + page_id) AS home, {words} FROM p GROUP BY 1),
r AS (SELECT s.*, home.u LIKE 'https://%' AS https, home.t AS title, home.h AS h1, home.d AS description, regexp_matches(home.d, '{VALUE_WORDS}', 'i') AS valued, coalesce(social, 0) AS social, coalesce(blog_links, 0) AS blog_links, {", ".join(f"coalesce({k}, '') AS {k}" for k in PAGE_HINTS)}, {blank} FROM s LEFT JOIN n USING (site_id)),
t AS (SELECT *, {", ".join(score(name) for name in STARTS)} FROM r)
SELECT site_id, pages, text_length, {", ".join(STARTS)}, CAST(floor(({whole}) / 100.0 + 0.5) AS INT) AS overall_score, {lines("strengths")}, {lines("risks")}, {lines("actions")} FROM t""",
    }


QUERIES = {f.__name__: f for f in (site_research,)}
ORACLES = _oracles()
