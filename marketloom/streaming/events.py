"""Event logs as streams: windowed counts with late data, balances, latest rows kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.tables import latest


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Events and conditional sums by user and window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"))


def once(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each event_id once, with state no older than the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def balances(events: DataFrame) -> DataFrame:
    delta = F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).otherwise(-F.col("value"))
    return events.groupBy("user_id").agg(F.sum(delta).alias("balance"))


def keep_latest(path: str, key: list[str], order: str, tie: str):
    """For foreachBatch: the table at path/<version> keeps one row a key, the newest; a batch that comes again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch if epoch == 0 else spark.read.parquet(f"{path}/{epoch - 1}").unionByName(batch)
        latest(rows, key, [F.col(order).desc(), F.col(tie).desc()]).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return write


def credit_admission(events: DataFrame, cost: float = 10.0, premium: tuple[int, ...] = ()) -> DataFrame:
    """Each use of a user in order: accepted if the balance covers the cost, which it then takes; premium users pay nothing.

    Purchases and sign-ups add their value. State is one number a user. Rows come in the order of the micro-batches, and
    within one by time and event_id.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (balance,) = state.get if state.exists else (0.0,)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if r.event_type in ("purchase", "signup"):
                balance += r.value
            else:
                fine = key[0] in premium or balance >= cost
                balance -= cost if fine and key[0] not in premium else 0.0
                out.append((r.event_id, key[0], bool(fine), balance))
        state.update((balance,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted", "balance"])

    return events.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, accepted boolean, balance double", "balance double", "append", "NoTimeout")


def quota_admission(events: DataFrame, limit: int = 5, hours: int = 24) -> DataFrame:
    """Each event of a user in order: accepted while fewer than ``limit`` were accepted in the hours before. State is those times."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            now = r.ts.timestamp()
            times = [t for t in times if now - t < hours * 3600]
            out.append((r.event_id, key[0], len(times) < limit))
            if len(times) < limit:
                times.append(now)
        state.update((times,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted"])

    return events.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, accepted boolean", "times array<double>", "append", "NoTimeout")
