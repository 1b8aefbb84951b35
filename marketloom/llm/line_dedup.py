"""Operator 13 [native]: lines that many documents share are dropped, in Spark SQL functions alone.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points are
hashed to 128 bits and counted in distinct documents, after a partial count in each task. Where a key is in at least ``min_docs``
documents, its lines stay only in the document of the largest doc_id. Places to drop go back to their row as positions, and
the other lines are joined again in their order. Only hashes are shuffled for the counts; each text is shuffled once.

Defined cases: null and empty text are one empty line (a null text stays null); rows that share a doc_id are one document for the counts, and
rows of null doc_id are one that comes before all others; repeated lines of a document all go or all stay; a very long
text is a row of its own, whose positions are one array; an empty table gives no rows; other columns pass through, also of clashing names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import numbered, staged, told_apart

MIN_CHARS, MIN_DOCS = 40, 5


def bare(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    return F.ltrim(F.rtrim(line, blank), blank)


def lower(text: Column) -> Column:
    """A-Z, no other letters, lower-cased: ``translate`` is much slower than ``lower``, which is the same for ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h, h2 and stays (the largest doc_id) of the keys that at least min_docs documents hold."""
    held = lines.select("h", "h2", "doc_id").distinct()
    return held.groupBy("h", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays")).where(F.col("n") >= min_docs).drop("n")


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc (the row as it came), kept (its text without common lines), n_lines (before) and n_dropped."""
    rows = numbered(docs, told_apart(docs))
    parts = F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n")
    lines = rows.select("row_id", F.col("doc.doc_id").cast("long").alias("doc_id"), parts.alias("lines"))
    lines = lines.select("row_id", "doc_id", F.posexplode("lines").alias("place", "line"))  # no row of a line holds the text
    lines = lines.where(F.length(bare(F.col("line"))) >= min_chars).select("row_id", "doc_id", "place", bare(F.col("line")).alias("key"))
    lines = lines.select("row_id", "doc_id", "place", lower(F.col("key")).alias("key"))
    lines = lines.select("row_id", "doc_id", "place", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("h2"))
    common = staged(common_keys(lines, min_docs), "common-lines")  # a scan, so that Spark splits the join where a line is very common
    dropped = lines.join(common, ["h", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("stays")))
    dropped = dropped.groupBy("row_id").agg(F.collect_list("place").alias("dropped"))
    all_ = rows.join(dropped, "row_id", "left").select("doc", "dropped", parts.alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    left = F.array_join(F.transform(places, lambda k: F.get("lines", k)), "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("doc.text")).otherwise(left)
    return all_.select("doc", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, u.place, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(range(len(parts))) AS place, unnest(parts) AS line) u),
common AS (
  SELECT key, max(doc_id) AS stays FROM lines WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id IS DISTINCT FROM c.stays AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
