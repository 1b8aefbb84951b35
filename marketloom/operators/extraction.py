"""What single pages offer, where their links lead, and what crawl rules forbid."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import blocked, canonical_url, computed, folded_dots, holds_any, site_id, url_path, url_priority, visible_text
from marketloom.operators.tables import recent

# What counts as a price, a call to action, a policy, and the platforms in the order in which they are tried.
PRICE = r"(?:USD|EUR|GBP|CAD|AUD|\$|€|£)\s?[0-9]{1,5}(?:[.,][0-9]{2})?|[0-9]{1,5}(?:[.,][0-9]{2})?\s?(?:USD|EUR|GBP)"
ACTION = "buy|shop|order|subscribe|book|get started|add to cart|learn more|call|contact|schedule|estimate|quote|consultation"
CURRENCIES = ("usd", "eur", "gbp", "cad", "aud", "$", "€", "£")
POLICIES = {"shipping": "shipping|delivery", "returns": "return|refund", "privacy": "privacy", "terms": "terms|conditions"}
PLATFORMS = [("Shopify", "shopify"), ("WooCommerce", "woocommerce|wp-content"), ("Wix", r"wix\.com"), ("Squarespace", "squarespace"), ("BigCommerce", "bigcommerce")]
CHUNK = 500


def prices(text: Column, low: Column | None = None) -> Column:
    """Distinct prices among the first 20; texts whose lower-cased form, where given, has no currency aren't searched."""
    found = F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(f"(?i){PRICE}"), 0), 1, 20))
    return found if low is None else F.when(~holds_any(low, CURRENCIES), F.array().cast("array<string>")).otherwise(found)


def platform(html: Column) -> Column:
    low = F.lower(html)
    out = F.when(low.rlike(PLATFORMS[0][1]), PLATFORMS[0][0])
    for name, pattern in PLATFORMS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unknown")


def meta_content(html: Column, name: str) -> Column:
    """Content of the first such meta tag, whichever attribute stands first; '' if there is none."""
    first = F.regexp_extract(html, rf'(?i)<meta[^>]+(?:name|property)="{name}"[^>]*content="([^"]*)"', 1)
    return F.when(first != "", first).otherwise(F.regexp_extract(html, rf'(?i)<meta[^>]+content="([^"]*)"[^>]*(?:name|property)="{name}"', 1))


def labels_of(html: Column, tags: str, most: int) -> Column:
    """Distinct non-empty texts of such elements, the first ``most``."""
    found = F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tags})(?:\s[^>]*)?>(.*?)</(?:{tags})>"), 1), visible_text)
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, most)


def calls_to_action(html: Column) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:a|button)(?:\s[^>]*)?>(.*?)</(?:a|button)>"), 1), visible_text)
    return F.slice(F.array_distinct(F.filter(found, lambda x: (x != "") & (F.length(x) <= 40) & x.rlike(f"(?i){ACTION}"))), 1, 15)


def resolved(href: Column, base: Column) -> Column:
    """A link as an absolute URL without its fragment; null where it leads to no page."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    joined = F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link)
    return (
        F.when((link == "") | (root == ""), F.lit(None).cast("string")).when(link.rlike("(?i)^https?://[^/]"), link).when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link)).when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]+)", 1), link)).otherwise(joined)
    )


def link_targets(pages: DataFrame) -> DataFrame:
    """page_id, site_id, target: links of every page to pages of its own site, canonical, each once."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)<a[^>]+href=\"([^\"#]+)"), 1))
    rows = pages.select("page_id", "url", site_id(F.col("url")).alias("site_id"), F.explode(hrefs).alias("href"))
    rows = computed(rows, {"joined": resolved(F.col("href"), F.col("url"))}).where("joined is not null")
    rows = computed(rows.select("page_id", "site_id", "joined"), {"to": folded_dots(F.col("joined"))})
    rows = rows.where(site_id(F.col("to")) == F.col("site_id"))
    return computed(rows, {"target": canonical_url(F.col("to"))}).select("page_id", "site_id", "target").distinct()


def robots_rules(robots: DataFrame) -> DataFrame:
    """site_id, rule: paths that robots(site_id, text) forbids all agents; those after a named agent's lines don't count."""
    lines = robots.select("site_id", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).select("site_id", "at", F.trim("line").alias("line")).where("line != '' and not startswith(line, '#')")
    key, value = F.lower(F.trim(F.regexp_extract("line", "^([^:]*)", 1))), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    lines = lines.select("site_id", "at", key.alias("key"), value.alias("value"))
    own = Window.partitionBy("site_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agent = F.when(F.col("key") == "user-agent", F.lower("value"))
    lines = lines.withColumn("agent", F.last(agent, ignorenulls=True).over(own)).withColumn("named", F.max(F.when(agent != "*", F.col("at"))).over(own))
    since = F.last(F.when(F.col("key") == "user-agent", F.col("at")), ignorenulls=True).over(own)
    return lines.withColumn("since", since).where("key = 'disallow' and value != '' and agent = '*' and (named is null or named > since)").select("site_id", F.col("value").alias("rule")).distinct()


def allowed(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """targets(site_id, target, ...) whose path begins with no rule of their site."""
    path = F.coalesce(F.nullif(F.regexp_extract("target", r"^[a-zA-Z]+://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    return targets.join(rules.withColumnRenamed("site_id", "of"), (F.col("of") == F.col("site_id")) & path.startswith(F.col("rule")), "left_anti")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """site_id, url, is_index: locations of sitemaps(site_id, xml) on their own host."""
    found = F.explode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), 1))
    return sitemaps.select("site_id", F.lower("xml").contains("<sitemapindex").alias("is_index"), found.alias("url")).where(F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "") == F.regexp_replace("site_id", r"^www\.", "")).select("site_id", "url", "is_index")


def page_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", visible_text(html).alias("text"), platform(html).alias("platform"), meta_content(html, "description").alias("description"), labels_of(html, "h1|h2|h3", 6).alias("headings"), calls_to_action(html).alias("actions"),
        F.array_join(F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]+href=\"([^\"#]+)"), 1), " ").alias("links"),
    )
    policies = [(F.col("text").rlike(f"(?i){p}") | F.col("links").rlike(f"(?i){p}")).alias(k) for k, p in POLICIES.items()]
    found = prices(F.col("text"))
    return rows.select("page_id", "platform", "description", F.size("headings").alias("n_headings"), F.array_join("headings", "|").alias("headings"), F.array_join("actions", "|").alias("actions"), F.array_join(found, "|").alias("prices"), *policies)


def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to each page of a site, and whether it is held already."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    held = pages.select(canonical_url(F.col("url")).alias("target")).distinct().withColumn("held", F.lit(True))
    return link_targets(pages).groupBy("site_id", "target").agg(F.count("*").alias("pages")).join(held, "target", "left").select("site_id", "target", "pages", F.coalesce("held", F.lit(False)).alias("held"))


def crawl_wave(links: DataFrame, most: int = 10, rules: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """site_id, target, priority, pages, position: the first ``most`` pages of each site to fetch next, by priority, then most links.

    links(site_id, target, pages, held); rules(site_id, rule) of robots files leave out what they forbid; mapped(site_id, url) of sitemaps adds
    pages that none links to.
    """
    rows = links.where("not held").select("site_id", "target", "pages")
    if mapped is not None:
        own = computed(mapped.select("site_id", "url"), {"target": canonical_url(folded_dots(F.col("url")))}).select("site_id", "target").distinct()
        new = own.join(links.select("site_id", "target"), ["site_id", "target"], "left_anti")
        rows = rows.unionByName(new.withColumn("pages", F.lit(0).cast("long")))
    rows = computed(rows, {"path": url_path(F.col("target"))}).where(~blocked(F.col("target"), F.col("path")))
    rows = computed(rows, {"priority": url_priority(F.col("target"), F.col("path"))}).drop("path")
    if rules is not None:
        rows = allowed(rows, rules)
    return recent(rows, ["site_id"], [F.col("priority"), F.col("pages").desc(), F.col("target")], most).select("site_id", "target", "priority", "pages", "position")


def next_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next ten pages of each site: linked, neither blocked nor held, by priority, then most links."""
    return crawl_wave(internal_links(spark, sf_dir))


def chunks(docs: DataFrame, size: int = CHUNK, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, content: the words of a text, gathered until a chunk has ``size`` characters; null and blank texts have none."""
    kind = "bigint" if key == "doc_id" else docs.schema[key].dataType.simpleString()
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    docs = docs.select(F.col(key).cast(kind).alias(key), plain.alias("text")).where("text != ''")

    def run(batches):
        for b in batches:
            whose, places, contents = [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                at, place = 0, 0
                while at < len(text):  # a step a chunk: it ends with the word in which it reaches its size
                    end = text.find(" ", at + size)
                    end = len(text) if end < 0 else end
                    whose.append(row)
                    places.append(place)
                    contents.append(text[at:end])
                    at, place = end + 1, place + 1
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(whose, pa.int64())), pa.array(places, pa.int32()), pa.array(contents, pa.string())], [key, "chunk_index", "content"])

    return docs.mapInArrow(run, f"{key} {kind}, chunk_index int, content string")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min(F.length("content")).alias("shortest"), F.max(F.length("content")).alias("longest"))


def chunk_search(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = ("the", "and", "with"), k: int = 10) -> DataFrame:
    """The best chunks that hold all terms, with the source of their document: a top-k report."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = chunks(docs).select("doc_id", "chunk_index", F.split(F.lower("content"), " ").alias("words"))
    hits = words.where(reduce(lambda a, b: a & b, (F.array_contains("words", t) for t in terms))).select("doc_id", "chunk_index", F.size(F.filter("words", lambda w: w.isin(*terms))).alias("hits"), F.size("words").alias("n_words"))
    best = hits.orderBy(F.col("hits").desc(), "doc_id", "chunk_index").limit(k)
    return best.join(docs.select("doc_id", "source"), "doc_id")


_LINKS = r"""WITH l AS (SELECT DISTINCT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m|blog)\.', '') AS site_id, regexp_replace(trim(unnest(regexp_extract_all(html, '<a[^>]+href="([^"#]+)', 1, 'i'))), '#.*$', '') AS link FROM pages),
t AS (SELECT page_id, site_id, CASE WHEN link = '' OR regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) = '' THEN NULL WHEN regexp_matches(link, '^https?://[^/]', 'i') THEN link WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL WHEN link LIKE '//%' THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || link
WHEN link LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || link WHEN link LIKE '?%' THEN regexp_extract(url, '^([^?#]+)', 1) || link
ELSE CASE WHEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)', 1) LIKE '%/' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)', 1) ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)', 1) || '/' END || link END AS target FROM l),
c AS (SELECT *, {canon_t} AS canon FROM t WHERE target IS NOT NULL AND regexp_replace(lower(regexp_extract(target, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m|blog)\.', '') = site_id),
h AS (SELECT DISTINCT {canon_u} AS canon FROM pages), g AS (SELECT site_id, canon AS target, count(DISTINCT page_id) AS pages FROM c GROUP BY 1, 2),
i AS (SELECT site_id, target, pages, target IN (SELECT canon FROM h) AS held FROM g)"""


#: Chunks as c(doc_id, content, chunk_index).
CHUNK_SQL = r"WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x != '') AS words FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, list_reduce(list_transform(words, lambda x: {'n': length(x), 'chunk': 0, 'out': x}), lambda a, x: {'n': CASE WHEN a.n >= 500 THEN x.n ELSE a.n + 1 + x.n END, 'chunk': 0, 'out': a.out || CASE WHEN a.n >= 500 THEN chr(10) ELSE ' ' END || x.out}).out AS joined FROM w WHERE len(words) > 0), c AS (SELECT doc_id, unnest(string_split(joined, chr(10))) AS content, generate_subscripts(string_split(joined, chr(10)), 1) - 1 AS chunk_index FROM r)"


def _canonical(u: str) -> str:
    path = f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
    return f"regexp_extract({u}, '^([a-zA-Z]+://[^/?#]+)', 1) || CASE WHEN {path} = '' THEN '/' WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE {path} END"


def _oracles() -> dict[str, str]:
    from marketloom.functions.columns import BLOCKED, PAGE_TYPES
    from marketloom.operators.sites import _VIS

    links = _LINKS.replace("{canon_t}", _canonical("target")).replace("{canon_u}", _canonical("url"))
    path = "CASE WHEN regexp_extract(target, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(target, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END"
    rank = " ".join(f"WHEN regexp_matches({path}, '{p}', 'i') THEN {k}" for k, (_, p) in enumerate(PAGE_TYPES))
    labels = lambda tags: f"list_filter(list_transform(regexp_extract_all(html, '<(?:{tags})(?:\\s[^>]*)?>(.*?)</(?:{tags})>', 1, 'is'), lambda x: {_VIS.format('x')}), lambda x: x != '')"
    first = lambda x: f"list_transform(list_filter(list_zip({x}, range(len({x}))), lambda p: list_position({x}, p[1]) = p[2] + 1), lambda p: p[1])"  # noqa: E731  distinct, in order
    meta = """CASE WHEN regexp_extract(html, '<meta[^>]+(?:name|property)="description"[^>]*content="([^"]*)"', 1, 'i') != '' THEN regexp_extract(html, '<meta[^>]+(?:name|property)="description"[^>]*content="([^"]*)"', 1, 'i') ELSE regexp_extract(html, '<meta[^>]+content="([^"]*)"[^>]*(?:name|property)="description"', 1, 'i') END"""
    kinds = " ".join(f"WHEN regexp_matches(lower(html), '{p}') THEN '{n}'" for n, p in PLATFORMS)
    policies = ", ".join(f"regexp_matches(txt, '{p}', 'i') OR regexp_matches(links, '{p}', 'i') AS {k}" for k, p in POLICIES.items())
    return {
        "page_offers": f"WITH a AS (SELECT page_id, {_VIS.format('html')} AS txt, CASE {kinds} ELSE 'unknown' END AS platform, {meta} AS description, {labels('h1|h2|h3')} AS h, list_filter({labels('a|button')}, lambda x: length(x) <= 40 AND regexp_matches(x, '{ACTION}', 'i')) AS b, array_to_string(regexp_extract_all(html, '<a[^>]+href=\"([^\"#]+)', 1, 'i'), ' ') AS links FROM pages), p AS (SELECT *, list_slice(regexp_extract_all(txt, '{PRICE}', 0, 'i'), 1, 20) AS q FROM a) SELECT page_id, platform, description, CAST(len(list_slice({first('h')}, 1, 6)) AS INT) AS n_headings, array_to_string(list_slice({first('h')}, 1, 6), '|') AS headings, array_to_string(list_slice({first('b')}, 1, 15), '|') AS actions, array_to_string({first('q')}, '|') AS prices, {policies} FROM p",
        "internal_links": links + " SELECT * FROM i",
        "next_wave": links + f", f AS (SELECT *, CASE {rank} ELSE 50 END AS priority FROM i WHERE NOT held AND NOT regexp_matches(lower({path}), '{BLOCKED}')), o AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority, pages DESC, target) AS position FROM f) SELECT site_id, target, priority, pages, position FROM o WHERE position <= 10",
        "document_chunks": CHUNK_SQL + " SELECT doc_id, count(*) AS n_chunks, CAST(min(length(content)) AS INT) AS shortest, CAST(max(length(content)) AS INT) AS longest FROM c GROUP BY 1",
        "chunk_search": CHUNK_SQL + ", k AS (SELECT doc_id, chunk_index, string_split(lower(content), ' ') AS words FROM c), s AS (SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(len(list_filter(words, lambda x: x IN ('the', 'and', 'with'))) AS INT) AS hits, CAST(len(words) AS INT) AS n_words FROM k WHERE list_contains(words, 'the') AND list_contains(words, 'and') AND list_contains(words, 'with')) SELECT s.*, source FROM (SELECT * FROM s ORDER BY hits DESC, doc_id, chunk_index LIMIT 10) s JOIN documents USING (doc_id)",
    }


QUERIES = {f.__name__: f for f in (page_offers, internal_links, next_wave, document_chunks, chunk_search)}
ORACLES = _oracles()
