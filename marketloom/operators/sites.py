"""Web pages to page signals to site profiles, all sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.columns import blocked, canonical_url, clamp, page_type, points, rounded, site_id, strength, tag_text, url_host, url_path, url_priority, visible_text


def page_signals(pages: DataFrame) -> DataFrame:
    """Signals of every page that plain expressions can read from its HTML."""
    html, url = F.col("html"), F.col("url")
    links = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]+href=\"([^\"#]+)"), 1))
    text = visible_text(html)
    return pages.select(
        "page_id", "url", site_id(url).alias("site_id"), url_host(url).alias("host"), canonical_url(url).alias("canonical_url"), page_type(url).alias("page_type"), url_priority(url).alias("priority"), blocked(url).alias("blocked"),
        tag_text(html, "title").alias("title"), tag_text(html, "h1").alias("h1"), F.length(text).alias("text_chars"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)<p[\s>]"), 0)).alias("paragraphs"), links.alias("links"),
        (F.size(F.regexp_extract_all(html, F.lit("(?i)<script"), 0)) >= 3).alias("script_heavy"), url.startswith("https://").alias("https"), F.sha2(text, 256).alias("content_hash"),
    )


def site_profile(signals: DataFrame) -> DataFrame:
    """One row a site: unions, flags, counts, the best page by priority."""
    return signals.groupBy("site_id").agg(
        F.count("*").alias("pages"), F.countDistinct("canonical_url").alias("distinct_pages"), F.countDistinct("content_hash").alias("distinct_contents"), F.bool_or(F.col("page_type") == "homepage").alias("has_homepage"), F.bool_and("https").alias("all_https"),
        F.bool_or("script_heavy").alias("any_script_heavy"), F.sum("text_chars").alias("text_chars"), F.sum("paragraphs").alias("paragraphs"), F.count_if(F.col("text_chars") >= 600).alias("article_pages"), F.array_join(F.array_sort(F.collect_set("page_type")), ",").alias("page_types"),
        F.min(F.struct("priority", "page_id"))["page_id"].alias("first_page"),
    )


def site_scores(profile: DataFrame) -> DataFrame:
    """Content, structure and safety points, capped, with a band; a site without own text can't pass 40."""
    depth = points(strength(F.col("text_chars"), 700, 1800, 3000), 10.0)
    breadth = points(strength(F.col("distinct_pages"), 1, 3, 5), 6.0)
    safety = F.when(F.col("all_https"), 4.0).otherwise(0.0)
    total = rounded(100.0 * (depth + breadth + safety) / 20.0)
    capped = F.when(F.col("text_chars") < 200, F.least(total, F.lit(40.0))).otherwise(total)
    score = clamp(capped, 0.0, 100.0)
    return profile.select("site_id", depth.alias("depth"), breadth.alias("breadth"), safety.alias("safety"), score.alias("score"), F.when(score >= 80, "strong").when(score >= 60, "good").when(score >= 40, "fair").otherwise("weak").alias("band"))


def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_signals(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(spark, sf_dir).select("page_id", "site_id", "host", "canonical_url", "page_type", "priority", "blocked", "title", "h1", "text_chars", "paragraphs", F.size("links").alias("n_links"))


def site_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_profile(signals_of(spark, sf_dir))


def site_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_scores(site_profile(signals_of(spark, sf_dir)))


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links between paths of a site, with how many pages have each."""
    edges = signals_of(spark, sf_dir).select("site_id", "page_id", F.explode("links").alias("target")).where(F.col("target").startswith("/"))
    return edges.groupBy("site_id", "target").agg(F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five pages of each site: distinct canonical URLs that aren't blocked, by priority, then place."""
    from marketloom.operators.tables import recent

    first = signals_of(spark, sf_dir).where("not blocked").groupBy("site_id", "canonical_url").agg(F.min("priority").alias("priority"), F.min("page_id").alias("page_id"))
    return recent(first, ["site_id"], [F.col("priority"), F.col("page_id")], 5).select("site_id", "canonical_url", "position")


_VIS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_PATH = r"CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END"


def _oracle() -> str:
    from marketloom.functions.columns import BLOCKED, PAGE_TYPES

    kind = " ".join(f"WHEN regexp_matches(path, '{p}', 'i') THEN '{n}'" for n, p in PAGE_TYPES)
    rank = " ".join(f"WHEN '{n}' THEN {k}" for k, (n, _) in enumerate(PAGE_TYPES))
    return f"""WITH u AS (SELECT *, {_HOST} AS host, {_PATH} AS path, {_VIS.format("html")} AS txt FROM pages),
t AS (SELECT *, CASE WHEN host = '' THEN 'unknown' {kind} ELSE 'page' END AS page_type FROM u),
s AS (SELECT page_id, url, regexp_replace(host, '^(www|m|blog)\\.', '') AS site_id, host, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS canonical_url,
page_type, CASE page_type {rank} ELSE 50 END AS priority, regexp_matches(lower(path), '{BLOCKED}') AS blocked, {_VIS.format("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")} AS title, {_VIS.format("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is')")} AS h1,
CAST(length(txt) AS INT) AS text_chars, CAST(len(regexp_extract_all(html, '<p[\\s>]', 0, 'i')) AS INT) AS paragraphs, list_distinct(regexp_extract_all(html, '<a[^>]+href="([^"#]+)', 1, 'i')) AS links, len(regexp_extract_all(html, '<script', 0, 'i')) >= 3 AS script_heavy, url LIKE 'https://%' AS https, sha256(txt) AS content_hash FROM t)"""


_PROFILE = """, p AS (SELECT site_id, count(*) AS pages, count(DISTINCT canonical_url) AS distinct_pages, count(DISTINCT content_hash) AS distinct_contents, bool_or(page_type = 'homepage') AS has_homepage, bool_and(https) AS all_https, bool_or(script_heavy) AS any_script_heavy,
CAST(sum(text_chars) AS BIGINT) AS text_chars, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, count(*) FILTER (text_chars >= 600) AS article_pages, array_to_string(list_sort(list(DISTINCT page_type)), ',') AS page_types, arg_min(page_id, CAST(priority AS BIGINT) * 1000000000 + page_id) AS first_page FROM s GROUP BY 1)"""
QUERIES = {f.__name__: f for f in (page_facts, site_profiles, site_grades, link_edges, crawl_frontier)}
ORACLES = {
    "page_facts": _oracle() + " SELECT page_id, site_id, host, canonical_url, page_type, priority, blocked, title, h1, text_chars, paragraphs, CAST(len(links) AS INT) AS n_links FROM s",
    "site_profiles": _oracle() + _PROFILE + " SELECT * FROM p",
    "site_grades": _oracle()
    + _PROFILE
    + """, q AS (SELECT site_id, text_chars, floor(10 * CASE WHEN text_chars >= 3000 THEN 1 WHEN text_chars >= 1800 THEN 0.66 WHEN text_chars >= 700 THEN 0.33 ELSE 0 END + 0.5) AS depth,
floor(6 * CASE WHEN distinct_pages >= 5 THEN 1 WHEN distinct_pages >= 3 THEN 0.66 WHEN distinct_pages >= 1 THEN 0.33 ELSE 0 END + 0.5) AS breadth, CASE WHEN all_https THEN 4.0 ELSE 0.0 END AS safety FROM p),
g AS (SELECT *, greatest(0, least(100, CASE WHEN text_chars < 200 THEN least(40, floor(100.0 * (depth + breadth + safety) / 20 + 0.5)) ELSE floor(100.0 * (depth + breadth + safety) / 20 + 0.5) END)) AS score FROM q)
SELECT site_id, CAST(depth AS DOUBLE) AS depth, CAST(breadth AS DOUBLE) AS breadth, CAST(safety AS DOUBLE) AS safety, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'weak' END AS band FROM g""",
    "link_edges": _oracle() + ", e AS (SELECT site_id, page_id, unnest(links) AS target FROM s) SELECT site_id, target, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM e WHERE target LIKE '/%' GROUP BY 1, 2",
    "crawl_frontier": _oracle() + ", f AS (SELECT site_id, canonical_url, min(priority) AS priority, min(page_id) AS page_id FROM s WHERE NOT blocked GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority, page_id) AS position FROM f) SELECT site_id, canonical_url, position FROM r WHERE position <= 5",
}
