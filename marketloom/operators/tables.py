"""Table work around the analytics: latest rows, quotas, balances, cache look-ups, upserts, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded

DAY = 86_400_000_000


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in that order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def recent(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("position") <= n)


def rolling_count(df: DataFrame, key: list[str], ts: str, condition: Column, micros: int = DAY) -> Column:
    """Rows of the key with the condition in the time before and at each row; exactly that long ago is out."""
    return F.sum(F.when(condition, 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(micros - 1), 0))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and one row of each key of new that old lacks: the least by all its columns."""
    first = latest(new, key, [F.col(c).asc_nulls_last() for c in new.columns])
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    names = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return names.join(rows, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", F.coalesce("o_orderstatus", F.lit("none")).alias("status"), F.coalesce("o_totalprice", F.lit(0.0)).alias("o_totalprice"))


def urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: open orders by priority, then newest."""
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).when(F.col("o_orderpriority").startswith("3"), 2).otherwise(3)
    rows = read(spark, sf_dir, "orders").where("o_orderstatus != 'F'").withColumn("rank", rank)
    return rows.orderBy("rank", F.col("o_orderdate").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "rank")


def user_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of each customer's ledger; those without entries have 0."""
    delta = F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).otherwise(-F.col("value"))
    sums = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(delta.cast("decimal(18,4)")).alias("sum"))
    return read(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce(F.col("sum").cast("double"), F.lit(0.0)).alias("balance"))


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", rolling_count(rows, ["user_id"], "ts", F.col("event_type") == "view").alias("views_24h"), F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-(DAY - 1), 0)).alias("same_24h"))


def cached_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view, the newest search result of the user (a click) within 24 hours before it."""
    rows = read(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy(F.col("ts"), F.col("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    click = F.last(F.when(F.col("event_type") == "click", F.struct("event_id", "ts")), ignorenulls=True).over(own)
    found = rows.select("event_id", "event_type", "ts", click.alias("c")).where("event_type = 'view'")
    return found.select("event_id", F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("c.ts").cast("timestamp")) < DAY, F.col("c.event_id")).alias("cached_event_id"))


def json_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.coalesce(k >= 50, F.lit(False))).alias("n_high"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def repeat_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after which a customer's first urgent order stands, those of customers with one kept from before 1996."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    early = latest(rows.where("o_orderdate < '1996-01-01'"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    late = latest(rows.where("o_orderdate >= '1996-01-01'"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return insert_missing(early, late, ["o_custkey"]).select("o_custkey", "o_orderkey")


def upsert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    sums = lambda df: df.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return upsert(sums(rows.where("o_orderdate < '1997-01-01'")), sums(rows.where("o_orderdate >= '1997-01-01'")), ["o_custkey"])


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of the user in each conversation, oldest first."""
    rows = recent(read(spark, sf_dir, "conversations").where("role = 'user'"), ["conv_id"], [F.col("turn").desc()], 3)
    return rows.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"), F.length("text").alias("chars"))


def order_status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and averages by status and by priority in one pass over grouping sets."""
    rows, sets = read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]
    all_of = lambda c, name: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c)).alias(name)  # noqa: E731  a null of the data stays null
    totals = rows.groupingSets([[c] for c in sets], *sets).agg(
        all_of(sets[0], "status"), all_of(sets[1], "priority"), F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    )
    return totals.select("status", "priority", "n", "large", "total")


def segment_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment with dense rank, and the gap to the segment before."""
    n = read(spark, sf_dir, "customer").groupBy("c_mktsegment").count()
    order = Window.partitionBy().orderBy(F.col("count").desc(), F.col("c_mktsegment"))  # a row a segment
    return n.select("c_mktsegment", F.col("count").alias("n"), F.row_number().over(order).alias("rank"), F.lag("c_mktsegment").over(order).alias("before"), rounded(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 3).alias("pct"))


_R3 = "floor({} * 1000 + 0.5) / 1000"
QUERIES = {f.__name__: f for f in (latest_order, urgent_orders, user_balance, daily_quota, cached_event, json_flag, repeat_insert, upsert_totals, user_turns, order_status_sets, segment_pillars)}
ORACLES = {
    "latest_order": "SELECT c_custkey, c_name, o_orderkey, coalesce(o_orderstatus, 'none') AS status, coalesce(o_totalprice, 0) AS o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1",
    "urgent_orders": "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority[1] WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS rank FROM orders WHERE o_orderstatus != 'F' ORDER BY rank, o_orderdate DESC, o_orderkey LIMIT 100",
    "user_balance": "SELECT c_custkey, coalesce(CAST(b AS DOUBLE), 0) AS balance FROM customer LEFT JOIN (SELECT user_id, sum(CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END AS DECIMAL(18,4))) AS b FROM events GROUP BY 1) ON c_custkey = user_id",
    "daily_quota": "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS views_24h, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS same_24h FROM events",
    "cached_event": "WITH c AS (SELECT event_id, event_type, ts, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS cid, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER w AS cts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(cts) < 86400000000 THEN cid END AS cached_event_id FROM c WHERE event_type = 'view'",
    "json_flag": "SELECT event_type, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 50) AS n_high, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "repeat_insert": "WITH e AS (SELECT o_custkey, o_orderkey, o_orderdate < '1996-01-01' AS early, row_number() OVER (PARTITION BY o_custkey, o_orderdate < '1996-01-01' ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM e WHERE n = 1 AND (early OR o_custkey NOT IN (SELECT o_custkey FROM e WHERE early))",
    "upsert_totals": "WITH s AS (SELECT o_custkey, o_orderdate >= '1997-01-01' AS late, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2) SELECT o_custkey, total FROM s WHERE late OR o_custkey NOT IN (SELECT o_custkey FROM s WHERE late)",
    "user_turns": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, length(text) AS chars FROM r WHERE n <= 3",
    "order_status_sets": "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
    "segment_pillars": "WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, row_number() OVER o AS rank, lag(c_mktsegment) OVER o AS before, floor(100.0 * n / sum(n) OVER () * 1000 + 0.5) / 1000 AS pct FROM n WINDOW o AS (ORDER BY n DESC, c_mktsegment)",
}
