"""Reading and writing of the file formats that the analytics meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """Quoted CSV with a header; missing columns are an error, all-blank rows go, missing cells are ''."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    strings = [c for c, kind in df.dtypes if kind == "string"]
    df = df.fillna("", subset=strings) if strings else df
    return df.where(F.array_max(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in df.columns))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", False).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def replace_table(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
