"""Business KPIs and advice, and the metrics of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators.running import running_before

# A KPI is unhealthy below or above its bound.
BOUNDS = [("conversion_rate", "<", 1.5), ("repeat_customer_rate", "<", 22.0), ("ad_spend_to_revenue_pct", ">", 30.0), ("avg_delivery_days", ">", 6.0), ("refund_rate", ">", 5.0), ("monthly_sessions", "<", 10000.0)]


def advice(kpis: DataFrame) -> DataFrame:
    """One row for each unhealthy KPI, or one that says so if all are healthy."""
    found = F.array_compact(F.array(*(F.when((F.col(c) < b) if op == "<" else (F.col(c) > b), F.lit(c)) for c, op, b in BOUNDS)))
    return kpis.select("*", F.explode(F.when(F.size(found) == 0, F.array(F.lit("keep_monitoring"))).otherwise(found)).alias("problem"))


def nation_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").groupBy("o_custkey").count()
    repeat = read("customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(rounded(100.0 * F.count_if(F.col("count") >= 2) / F.count("*"), 3).alias("repeat_customer_rate"))
    days = F.datediff("l_shipdate", "o_orderdate")
    lines = read("lineitem").select("l_orderkey", "l_returnflag", "l_shipdate", "l_discount").join(read("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = lines.join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        rounded(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 3).alias("refund_rate"),
        rounded(F.avg(F.when((days >= 0) & (days <= 60), days)), 3).alias("avg_delivery_days"),
        rounded(100.0 * F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count("*"), 3).alias("ad_spend_to_revenue_pct"),
    )
    seen = read("events").groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    use = read("customer").join(seen, F.col("c_custkey") == F.col("user_id")).groupBy("c_nationkey").agg(F.sum("n").cast("double").alias("monthly_sessions"), rounded(100.0 * F.count_if("bought") / F.count("*"), 3).alias("conversion_rate"))
    return repeat.join(per, "c_nationkey").join(use, "c_nationkey", "left")


def nation_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice(nation_kpis(spark, sf_dir)).select("c_nationkey", "problem", "repeat_customer_rate", "refund_rate", "avg_delivery_days", "ad_spend_to_revenue_pct", "monthly_sessions", "conversion_rate")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels with a plain score of the text's length, 0 to 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars"))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").join(docs, "doc_id").select(F.col("quality").cast("int").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, Brier score and exact AUC (ties count half).

    AUC sums over distinct scores, a row each; the running count of negatives comes from ranges of scores.
    """
    by_score = rows.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    auc = running_before(by_score, "p", "neg").agg((F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    hit = F.col("p") >= 0.5
    tp, fp, fn = F.count_if(hit & (F.col("y") == 1)), F.count_if(hit & (F.col("y") == 0)), F.count_if(~hit & (F.col("y") == 1))
    n = F.count("*")
    base = rows.agg(n.alias("n"), rounded((n - fp - fn) / n, 4).alias("accuracy"), rounded(tp / F.greatest(F.lit(1), tp + fp), 4).alias("precision"), rounded(tp / F.greatest(F.lit(1), tp + fn), 4).alias("recall"), rounded(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 4).alias("brier"))
    return base.join(auc.select(rounded(F.col("auc"), 4).alias("auc")))


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_metrics(scored_labels(spark, sf_dir))


def calibration_curve(spark: SparkSession, sf_dir: str, bins: int = 5) -> DataFrame:
    """Mean score and share of positives in uniform bins; empty bins have no row."""
    rows = scored_labels(spark, sf_dir).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), rounded(F.avg("y"), 4).alias("positives"), rounded(F.avg("p"), 4).alias("mean_score"))


_L = "WITH l AS (SELECT CAST(quality AS INT) AS y, least(1.0, n_chars / 4000.0) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"
QUERIES = {f.__name__: f for f in (nation_advice, model_metrics, calibration_curve)}
ORACLES = {
    "model_metrics": _L + """, s AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM l GROUP BY 1), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
a AS (SELECT CAST(sum(pos * (before + neg / 2)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM b), c AS (SELECT count(*) AS n, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, avg(power(p - y, 2)) AS brier FROM l)
SELECT n, floor((n - fp - fn) / n * 10000 + 0.5) / 10000 AS accuracy, floor(tp / greatest(1, tp + fp) * 10000 + 0.5) / 10000 AS precision, floor(tp / greatest(1, tp + fn) * 10000 + 0.5) / 10000 AS recall, floor(brier * 10000 + 0.5) / 10000 AS brier, floor(auc * 10000 + 0.5) / 10000 AS auc FROM c, a""",
    "calibration_curve": _L + " SELECT CAST(least(4, floor(p * 5)) AS INT) AS bin, count(*) AS n, floor(avg(y) * 10000 + 0.5) / 10000 AS positives, floor(avg(p) * 10000 + 0.5) / 10000 AS mean_score FROM l GROUP BY 1",
    "nation_advice": """WITH r AS (SELECT c_nationkey, floor(100.0 * count(*) FILTER (n >= 2) / count(*) * 1000 + 0.5) / 1000 AS repeat_customer_rate FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1),
p AS (SELECT c_nationkey, floor(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) * 1000 + 0.5) / 1000 AS refund_rate, floor(avg(CASE WHEN date_diff('day', o_orderdate, l_shipdate) BETWEEN 0 AND 60 THEN date_diff('day', o_orderdate, l_shipdate) END) * 1000 + 0.5) / 1000 AS avg_delivery_days, floor(100.0 * CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1000 + 0.5) / 1000 AS ad_spend_to_revenue_pct
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
u AS (SELECT c_nationkey, CAST(sum(n) AS DOUBLE) AS monthly_sessions, floor(100.0 * count(*) FILTER (bought) / count(*) * 1000 + 0.5) / 1000 AS conversion_rate FROM customer JOIN (SELECT user_id, count(*) AS n, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1) ON c_custkey = user_id GROUP BY 1),
k AS (SELECT * FROM r JOIN p USING (c_nationkey) LEFT JOIN u USING (c_nationkey)),
f AS (SELECT *, list_filter([CASE WHEN conversion_rate < 1.5 THEN 'conversion_rate' END, CASE WHEN repeat_customer_rate < 22 THEN 'repeat_customer_rate' END, CASE WHEN ad_spend_to_revenue_pct > 30 THEN 'ad_spend_to_revenue_pct' END, CASE WHEN avg_delivery_days > 6 THEN 'avg_delivery_days' END, CASE WHEN refund_rate > 5 THEN 'refund_rate' END, CASE WHEN monthly_sessions < 10000 THEN 'monthly_sessions' END], lambda x: x IS NOT NULL) AS bad FROM k)
SELECT c_nationkey, unnest(CASE WHEN len(bad) = 0 THEN ['keep_monitoring'] ELSE bad END) AS problem, repeat_customer_rate, refund_rate, avg_delivery_days, ad_spend_to_revenue_pct, monthly_sessions, conversion_rate FROM f""",
}
