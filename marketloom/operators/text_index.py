"""An inverted index over text chunks: a search reads the postings of its own terms, not the texts.

``write_index`` lays postings (term, chunk, count of the term, words of the chunk) and document frequencies out by bucket of the term's hash, each
file in the order of terms. ``search_index`` names its terms' buckets, so other folders aren't opened, and terms are pushed to the
files' statistics. A very common term is spread over several files of its bucket, by document.

Defined cases: null and blank texts have no chunk; repeated rows are chunks of their own and count apart; a term that no chunk holds finds nothing.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.functions.work import work_path
from marketloom.operators.extraction import chunks

#: Rows of a batch that a task hands on.
BATCH = 1 << 17
#: Files over which the postings of a bucket are spread, by document.
SPREAD = 4
QUERY = ("the", "and", "with")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def chunk_terms(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, n_words, term and tf of every chunk: a chunk is whole in its task, so its words are counted there, before any shuffle."""

    def run(batches):
        for b in batches:
            words = pc.split_pattern(b.column("content"), " ")
            n_words = pc.list_value_length(words)
            counts = pa.table({"row": pc.list_parent_indices(words), "term": pc.list_flatten(words)}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            row = counts["row"]
            out = {"doc_id": b.column("doc_id").take(row), "chunk_index": b.column("chunk_index").take(row), "n_words": n_words.take(row), "term": counts["term"], "tf": counts["count_all"].cast(pa.int32())}
            yield from pa.table(out).to_batches(max_chunksize=BATCH)

    rows = chunks(docs).select("doc_id", "chunk_index", F.lower("content").alias("content"))
    return rows.mapInArrow(run, "doc_id bigint, chunk_index int, n_words int, term string, tf int")


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, term, tf and n_words of every chunk of docs(doc_id, text); where a doc_id repeats, its equal places are one."""
    rows = chunk_terms(docs)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id", "chunk_index", "n_words", "term").agg(F.sum("tf").cast("int").alias("tf"))


def write_index(docs: DataFrame, path: str, buckets: int | None = None) -> None:
    """path/postings and path/terms by bucket, path/size with the number of chunks; as many buckets as the session has shuffle partitions, if not told."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = postings(docs).withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.repartition(buckets * SPREAD, "bucket", F.pmod("doc_id", F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    terms = written.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    terms.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    sizes = written.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("n"))  # chunks of a document are numbered from 0
    sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def of_terms(table: DataFrame, terms: tuple[str, ...], buckets: int) -> DataFrame:
    """Rows of the terms: their buckets' folders alone are read."""
    own = reduce(lambda a, b: a | b, ((F.col("bucket") == bucket_of(F.lit(t), buckets)) & (F.col("term") == t) for t in terms))
    return table.where(F.col("bucket").isin(*(bucket_of(F.lit(t), buckets) for t in terms)) & own)


def search_index(spark: SparkSession, path: str, terms: tuple[str, ...], k: int = 10) -> DataFrame:
    """doc_id, chunk_index, score: the k best of the chunks that hold all terms, by sums of share of words x ln(chunks / chunks with the term)."""
    terms = tuple(dict.fromkeys(terms))
    n, buckets = spark.read.parquet(f"{path}/size").first()
    hits = of_terms(spark.read.parquet(f"{path}/postings"), terms, buckets)
    weight = of_terms(spark.read.parquet(f"{path}/terms"), terms, buckets).select("term", F.log(F.lit(float(n)) / F.col("df")).alias("weight"))
    rows = hits.join(F.broadcast(weight), "term")  # a row a term of the query
    best = rows.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("found"), rounded(F.sum(F.col("tf") / F.col("n_words") * F.col("weight")), 6).alias("score"))
    return best.where(F.col("found") == len(terms)).orderBy(F.col("score").desc(), "doc_id", "chunk_index").limit(k).select("doc_id", "chunk_index", "score")


def indexed_search(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = QUERY, k: int = 10) -> DataFrame:
    """A top-k report from an index over the chunks of all documents, with the source of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    path = work_path(spark, "text-index")
    write_index(docs, path)
    return search_index(spark, path, terms, k).join(docs.select("doc_id", "source"), "doc_id")


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of at least ten chunks: how many chunks hold each, and how often."""
    rows = postings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where("df >= 10")


def _oracles() -> dict[str, str]:
    from marketloom.operators.extraction import CHUNK_SQL

    held = " AND ".join(f"list_contains(words, '{t}')" for t in QUERY)
    weighed = " + ".join(f"CAST(len(list_filter(words, lambda x: x = '{t}')) AS DOUBLE) / len(words) * ln(CAST(n AS DOUBLE) / d{k})" for k, t in enumerate(QUERY))
    counts = ", ".join(f"count(*) FILTER (list_contains(words, '{t}')) AS d{k}" for k, t in enumerate(QUERY))
    return {
        "indexed_search": CHUNK_SQL + f""", k AS (SELECT doc_id, chunk_index, string_split(lower(content), ' ') AS words FROM c), z AS (SELECT count(*) AS n, {counts} FROM k),
s AS (SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, floor(({weighed}) * 1000000 + 0.5) / 1000000 AS score FROM k, z WHERE {held}) SELECT s.*, source FROM (SELECT * FROM s ORDER BY score DESC, doc_id, chunk_index LIMIT 10) s JOIN documents USING (doc_id)""",
        "term_frequencies": CHUNK_SQL + ", k AS (SELECT doc_id, chunk_index, unnest(string_split(lower(content), ' ')) AS term FROM c), p AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM k GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY 1 HAVING count(*) >= 10",
    }


QUERIES = {f.__name__: f for f in (indexed_search, term_frequencies)}
ORACLES = _oracles()
