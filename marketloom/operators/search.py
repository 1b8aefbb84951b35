"""Term search, exact duplicates and contact extraction over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERMS = ("the", "and", "with")


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def search(docs: DataFrame, terms: tuple[str, ...], k: int = 20) -> DataFrame:
    """Documents that hold all terms, ranked by how many of their words those are; a top-k report."""
    each = docs.where(F.col("text").isNotNull()).select("doc_id", terms_of(F.col("text")).alias("words"))  # split once
    each = each.where(" and ".join(f"array_contains(words, '{t}')" for t in terms))
    counted = each.select("doc_id", F.size("words").alias("n_words"), F.size(F.filter("words", lambda w: w.isin(*terms))).alias("hits"))
    return counted.select("doc_id", "n_words", "hits", (F.floor(F.col("hits") / F.col("n_words") * 10000 + 0.5) / 10000).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), TERMS)


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same text, by its hash; copies are only counted, so a hot group is a sum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def paragraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, longest and mean of each document's lines of 40 characters and more."""
    long = F.filter(F.transform(F.split("text", "\n"), lambda p: F.length(F.trim(p))), lambda n: n >= 40)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", long.alias("sizes"))
    mean = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("sizes")
    return rows.select("doc_id", F.size("sizes").alias("paragraphs"), F.array_max("sizes").alias("longest"), F.when(F.size("sizes") > 0, F.floor(mean * 100 + 0.5) / 100).alias("mean_chars"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct e-mail addresses of each document, the first five, and how many phone-like numbers of 7 to 15 digits it has."""
    none = F.array().cast("array<string>")  # only texts with the sign are searched
    mails = F.slice(F.array_distinct(F.when(F.contains("text", F.lit("@")), F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0)).otherwise(none)), 1, 5)
    found = F.when(F.contains("text", F.lit("+")), F.regexp_extract_all("text", F.lit(r"\+[0-9][0-9 ().-]{6,}[0-9]"), 0)).otherwise(none)
    phones = F.filter(found, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(7, 15))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("contains(text, '@') or contains(text, '+')").select("doc_id", F.array_join(mails, ",").alias("emails"), F.size(phones).alias("phones"))
    return rows.where("emails != '' or phones > 0")


def source_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent words of each source; words are counted before they meet, so a hot source is no hot task."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.explode(terms_of(F.col("text"))).alias("word"))
    counts = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "word"))).where("place <= 3")


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w != '')"
QUERIES = {f.__name__: f for f in (document_search, exact_duplicates, paragraph_stats, contacts, source_vocabulary)}
ORACLES = {
    "document_search": f"WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, CAST(len(words) AS INT) AS n_words, CAST(len(list_filter(words, lambda w: w IN ('the', 'and', 'with'))) AS INT) AS hits FROM w WHERE list_contains(words, 'the') AND list_contains(words, 'and') AND list_contains(words, 'with')) SELECT doc_id, n_words, hits, floor(hits / n_words * 10000 + 0.5) / 10000 AS score FROM h ORDER BY score DESC, doc_id LIMIT 20",
    "exact_duplicates": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1",
    "paragraph_stats": "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: length(trim(p))), lambda n: n >= 40) AS sizes FROM documents) SELECT doc_id, CAST(len(sizes) AS INT) AS paragraphs, CAST(list_max(sizes) AS INT) AS longest, CASE WHEN len(sizes) > 0 THEN floor(list_sum(sizes) / len(sizes) * 100 + 0.5) / 100 END AS mean_chars FROM s",
    "contacts": r"WITH c AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS m, len(list_filter(regexp_extract_all(text, '\+[0-9][0-9 ().-]{6,}[0-9]'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)) AS phones FROM documents), o AS (SELECT doc_id, phones, list_filter(m, lambda x, i: list_position(m, x) = i) AS d FROM c) SELECT doc_id, array_to_string(d[1:5], ',') AS emails, CAST(phones AS INT) AS phones FROM o WHERE len(d) > 0 OR phones > 0",
    "source_vocabulary": f"WITH w AS (SELECT source, unnest({_WORDS}) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS place FROM c) SELECT * FROM r WHERE place <= 3",
}
