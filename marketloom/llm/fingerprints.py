"""Operator 6 [native]: a Merkle tree over the clauses, paragraphs and sections of a text, in Spark SQL functions alone.

Leaves are clauses (cut after a mark of punctuation and white space), their parents paragraphs (lines), then sections: runs of
paragraphs that end where a paragraph's digest begins with 0 or 1, so an edit moves no later border. Each node is the
SHA-256 of its children's. The fingerprint is a string, ``root:section/section``, a section ``digest=paragraph;paragraph``,
a paragraph its leaves joined by commas; roots test equality in full, and sections and leaves (shortened) show where two
texts differ. ``likeness`` needs two fingerprints only: twice the leaves they share over the leaves they have.

Defined cases: null text counts as empty, which has one empty leaf; equal fingerprints are 1.0 alike; repeated rows are
rows of their own, ties of doc_id in the order of their text; a table of one row is its own next; null doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAF, SECTION = 6, 16


def fingerprint(text: Column) -> Column:
    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.split(p, r"(?<=[.,;:!?|#$%&*])\s+"), lambda x: F.sha2(x, 256))
        short = F.array_join(F.transform(leaves, lambda h: F.substring(h, 1, LEAF)), ",")
        return F.struct(F.sha2(F.array_join(leaves, ""), 256).alias("node"), short.alias("leaves"))

    paragraphs = F.transform(F.split(text, "\n"), paragraph)
    ends = F.transform(paragraphs, lambda p: F.concat(p["node"], F.lit("="), p["leaves"], F.when(F.substring(p["node"], 1, 1) < "2", F.lit("/")).otherwise(F.lit(";"))))
    sections = F.split(F.regexp_replace(F.array_join(ends, ""), "[/;]$", ""), "/")

    def section(s: Column) -> Column:
        nodes = F.regexp_replace(s, "=[0-9a-f,]*;?", "")
        return F.struct(F.sha2(nodes, 256).alias("node"), F.regexp_replace(s, "[0-9a-f]{64}=", "").alias("leaves"))

    parts = F.transform(sections, section)
    root = F.sha2(F.array_join(F.transform(parts, lambda s: s["node"]), ""), 256)
    return F.concat(root, F.lit(":"), F.array_join(F.transform(parts, lambda s: F.concat(F.substring(s["node"], 1, SECTION), F.lit("="), s["leaves"])), "/"))


def root(fp: Column) -> Column:
    return F.substring_index(fp, ":", 1)


def leaves(fp: Column) -> Column:
    """Distinct leaves of a fingerprint."""
    return F.array_distinct(F.split(F.regexp_replace(F.substring_index(fp, ":", -1), f"/?[0-9a-f]{{{SECTION}}}=", ";"), "[,;]+"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints."""
    x, y = leaves(a), leaves(b)
    shared = F.size(F.array_intersect(x, y)) - 1  # the empty string before the first leaf
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y) - 2))


def changed_sections(a: Column, b: Column) -> Column:
    """Sections of a that b lacks: where the edits are."""
    cut = lambda fp: F.transform(F.split(F.substring_index(fp, ":", -1), "/"), lambda s: F.substring_index(s, "=", 1))
    return F.array_except(cut(a), cut(b))


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """docs(doc_id, text) with the derived columns, and next_text and next_<derived>: those of the document next in falling order of doc_id, the first after the last.

    Documents are dealt to ranges of doc_id and each range gets the first row of the next, so no order over the whole table runs
    in one task. A range's window holds one row at a time and its neighbour.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))) if cuts else F.lit(0)
    docs = docs.withColumn("part", part)
    falling = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    heads = docs.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("top"))  # a row a range
    order = Window.orderBy(F.col("part"))
    above = heads.select("part", "top", F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("goes_to"))
    first = docs.join(F.broadcast(above.withColumnRenamed("part", "of")), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy(*falling))).where("n = 1")
    extra = first.withColumn("part", F.col("goes_to")).select(*docs.columns, F.lit(1).alias("extra"))
    own = Window.partitionBy("part").orderBy("extra", *falling)
    both = docs.withColumn("extra", F.lit(0)).unionByName(extra).withColumns(derived)
    return both.select("*", *(F.lead(c).over(own).alias(f"next_{c}") for c in ["text", *derived])).where("extra = 0").drop("extra", "part")


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
