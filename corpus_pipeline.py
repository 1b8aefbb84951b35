"""Cleaning of a training corpus: stages that each keep, change or arrange the documents of the one before.

Toxic documents are rejected, one document of each near-duplicate group stays, passages of the benchmark are cut, personal
data is masked, and what is left is packed. All stages but the last return the columns of their input; ``n_chars`` follows
changes of ``text``. Defined cases: rows are told apart also where doc_ids are null or repeat: each stays unless it is toxic or a
near duplicate of a row that stays; a null text stays null and is packed as an empty one; ties go to the smallest doc_id (null
last), then by contents; very long texts are handled alone; columns of any name pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontamination as decontamination_
from marketloom.llm import near_duplicates as near_duplicates_
from marketloom.llm import pii as pii_
from marketloom.llm import toxicity as toxicity_
from marketloom.llm.common import numbered, staged, told_apart
from marketloom.llm.packing import pack_documents


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but the text renamed, so that none clashes with what an operator adds; no row holds its text twice."""
    return docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "text"})


def back(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text" if c == "text" else f"own_{c}").alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labels, doesn't call toxic; a text without a letter shows nothing and stays."""
    model = toxicity_.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_.score_toxicity(aside(docs), model, spans=False)
    return back(scored.where((F.col("predicted") == 0) | ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id (null is the largest) of every group that agrees in four fifths of its five-word shingles."""
    rows = numbered(docs, told_apart(docs))
    kept = near_duplicates_.near_rows(rows.select("row_id", "doc.text"), n=5, threshold=(80, 100)).where("kept").select("row_id")
    return rows.join(kept, "row_id", "left_semi").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages."""
    found = decontamination_.decontaminate(aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return recounted(back(decontamination_.without_spans(found), docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return recounted(back(pii_.redacted(pii_.find_pii(aside(docs), pii_.train(docs))), docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, with_ids=False)


STAGES = [("toxicity", toxicity), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: Stages learn from data and encode text, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
