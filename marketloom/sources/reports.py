"""Reports as files: tables as CSV, and one nested JSON row a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.sources.files import write_csv


def nested_report(summary: DataFrame, categories: DataFrame) -> DataFrame:
    """Each feature's summary with its categories as an array, by name; a feature has few categories."""
    own = [c for c in categories.columns if c != "feature_name"]
    parts = categories.groupBy("feature_name").agg(F.sort_array(F.collect_list(F.struct("category", *(c for c in own if c != "category")))).alias("categories"))
    return summary.join(parts, "feature_name", "left")


def write_association_report(overview: DataFrame, summary: DataFrame, categories: DataFrame, path: str) -> None:
    """path/overview, path/summary and path/categories as CSV, and path/features as JSON."""
    for name, rows in (("overview", overview), ("summary", summary), ("categories", categories)):
        write_csv(rows, f"{path}/{name}")
    nested_report(summary, categories).write.json(f"{path}/features")


def write_batch_results(results: DataFrame, by: list[str], path: str) -> None:
    """All rows of a batch run as CSV and JSON, and counts of each value of each grouping column."""
    write_csv(results, f"{path}/all")
    results.write.json(f"{path}/rows")
    for c in by:
        write_csv(results.groupBy(c).agg(F.count("*").alias("n")), f"{path}/by_{c}")
