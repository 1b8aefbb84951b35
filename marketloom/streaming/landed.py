"""Newly landed pages as tables: the latest version of each page, and the chunks of its text.

Both tables lie in folders by bucket of the page's address. A batch rewrites only the buckets of pages that it changes, by dynamic partition
overwrite, and leaves all other files as they are. Chunks are written before pages, and what has changed is judged by the pages, so a batch that fails between
the two is done again in full, and one that comes again changes nothing.

A row (url, html, crawled_at, removed) with removed true takes the page away, and its chunks with it; it stays as a mark, so that an older
version that comes later doesn't bring the page back. Of rows of equal time a removal wins, then the greater html.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marketloom.functions.columns import page_type, site_id, visible_text
from marketloom.functions.work import kept
from marketloom.operators.extraction import chunks
from marketloom.operators.tables import latest

BUCKETS = 32
PAGES = "url string, site_id string, page_type string, content_hash string, text string, crawled_at timestamp, removed boolean, bucket int"
CHUNKS = "url string, chunk_index int, content string, bucket int"


def table(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The table at path, or the folders of some buckets; empty before the first write."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))


def live_pages(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, f"{path}/pages", PAGES).where("not removed")


def live_chunks(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, f"{path}/chunks", CHUNKS).where("chunk_index >= 0")


def written(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def land_pages(path: str, buckets: int = BUCKETS):
    """For foreachBatch over pages(url, html, crawled_at, removed)."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        order = [F.col("crawled_at").desc(), F.col("removed").desc(), F.col("content_hash").desc()]
        gone_ = F.coalesce("removed", F.lit(False))
        rows = batch.select("url", "crawled_at", gone_.alias("removed"), F.when(gone_, "").otherwise(visible_text(F.coalesce("html", F.lit("")))).alias("text"))
        rows = rows.select("url", site_id(F.col("url")).alias("site_id"), page_type(F.col("url")).alias("page_type"), F.sha2("text", 256).alias("content_hash"), "text", "crawled_at", "removed", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket"))
        fresh = latest(rows, ["url"], order)
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # no more than there are buckets
        old = table(spark, f"{path}/pages", PAGES, touched)
        held = old.select(F.col("url").alias("held"), F.struct("crawled_at", "removed", "content_hash").alias("had"))
        newer = F.col("held").isNull() | (F.struct("crawled_at", "removed", "content_hash") > F.col("had"))
        changed = kept(fresh.join(held, F.col("url") == F.col("held"), "left").where(newer).select(*fresh.columns))
        touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())
        if not touched:
            return
        old = table(spark, f"{path}/pages", PAGES, touched)
        own = chunks(changed.where("not removed").select("url", "text"), key="url").join(changed.select("url", "bucket"), "url")
        gone = changed.select("url", F.lit(-1).alias("chunk_index"), F.lit(None).cast("string").alias("content"), "bucket")  # a mark, so that a bucket without chunks is rewritten too
        other = table(spark, f"{path}/chunks", CHUNKS, touched).join(changed.select("url"), "url", "left_anti")
        written(kept(other.unionByName(own).unionByName(gone)), f"{path}/chunks")
        written(kept(old.join(changed.select("url"), "url", "left_anti").unionByName(changed)), f"{path}/pages")

    return write


def keep_latest_rows(path: str, schema: str, key: list[str], order: str, tie: str, buckets: int = BUCKETS):
    """For foreachBatch: the table at path keeps one row a key, the newest, and rewrites only buckets of keys that a batch changes."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = [F.col(order).desc(), F.col(tie).desc()]
        fresh = latest(batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), key, newest)
        full = f"{schema}, bucket int"
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        old = table(batch.sparkSession, path, full, touched)
        both = kept(latest(old.unionByName(fresh.select(*old.columns)), key, newest))
        changed = sorted(r.bucket for r in both.join(old, old.columns, "left_anti").select("bucket").distinct().collect())
        if changed:
            written(both.where(F.col("bucket").isin(*changed)), path)

    return write
