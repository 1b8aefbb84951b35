"""Which categorical attributes go with customer loss: contingency tables, chi-square, Cramér's V, shares."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded

P_VALUE, CRAMER_V = 0.05, 0.05
# Upper 5 % points of chi-square for 1 to 30 degrees of freedom, as the SQL below has them.
CHI2_LIMITS = [
    3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685, 24.996,
    26.296, 27.587, 28.869, 30.144, 31.410, 32.671, 33.924, 35.172, 36.415, 37.652, 38.885, 40.113, 41.337, 42.557, 43.773,
]


def contingency(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature_name, category, n_no, n_yes of every feature in one pass; a null category counts as 'nan', a null target is dropped."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature_name"), F.coalesce(F.col(f).cast("string"), F.lit("nan")).alias("category")) for f in features)))
    long = df.where(F.col(target).isin(0, 1)).select(F.col(target).alias("t"), pairs.alias("p")).select("t", "p.*")
    return long.groupBy("feature_name", "category").agg(F.count_if(F.col("t") == 0).alias("n_no"), F.count_if(F.col("t") == 1).alias("n_yes"))


def category_breakdown(table: DataFrame) -> DataFrame:
    n = F.col("n_no") + F.col("n_yes")
    return table.select("feature_name", "category", "n_no", "n_yes", n.alias("n_total"), rounded(100.0 * F.col("n_no") / n, 2).alias("pct_no"), rounded(100.0 * F.col("n_yes") / n, 2).alias("pct_yes"))


def chi2_tail(x: float, dof: int) -> float:
    """Chance that chi-square of any degrees of freedom is over x, as a finite sum."""
    if x <= 0 or dof < 1:
        return 1.0
    h, j = x / 2, 0.5 if dof % 2 else 0.0
    total = [math.erfc(math.sqrt(h))] if dof % 2 else []
    while j < dof / 2:
        total.append(math.exp(j * math.log(h) - h - math.lgamma(j + 1)))
        j += 1
    return min(1.0, math.fsum(total))


def p_value(chi2: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, int(b)) for a, b in zip(x, k, strict=True)], dtype="float64")

    return tail(chi2, dof)


def feature_summary(table: DataFrame) -> DataFrame:
    """Chi-square (with continuity correction at one degree of freedom), its p-value, Cramér's V, share of all V, and whether it matters.

    A feature matters if its p-value is under the threshold and its V at or over its own.
    """
    own = Window.partitionBy("feature_name")
    cells = table.withColumns({"no": F.sum("n_no").over(own), "yes": F.sum("n_yes").over(own), "k": F.count("*").over(own)})
    cells = cells.withColumn("n", F.col("no") + F.col("yes"))
    shift = F.when((F.col("k") == 2) & (F.col("no") > 0) & (F.col("yes") > 0), 0.5).otherwise(0.0)

    def part(observed: str, side: str) -> Column:
        expected = (F.col("n_no") + F.col("n_yes")) * F.col(side) / F.col("n")
        gap = F.abs(F.col(observed) - expected)
        return F.when(expected > 0, F.pow(gap - F.least(gap, shift), 2) / expected).otherwise(0.0)

    sums = cells.groupBy("feature_name").agg(F.sum(part("n_no", "no") + part("n_yes", "yes")).alias("chi2"), F.max("k").alias("k"), F.max("n").alias("n"), F.max("no").alias("no"), F.max("yes").alias("yes"))
    live = (F.col("k") > 1) & (F.col("no") > 0) & (F.col("yes") > 0)
    v = F.when(live, F.sqrt(F.col("chi2") / F.col("n"))).otherwise(0.0)  # two classes, so the smaller side less one is 1
    every = Window.partitionBy()
    out = sums.withColumn("v", v).withColumn("share", F.when(F.sum("v").over(every) > 0, 100.0 * F.col("v") / F.sum("v").over(every)).otherwise(0.0))  # a row a feature
    out = out.withColumn("p", F.when(live, p_value(F.col("chi2"), F.col("k") - 1)).otherwise(1.0))
    return out.select(
        "feature_name", rounded(F.col("chi2"), 3).alias("chi2"), (F.col("k") - 1).alias("dof"), rounded(F.col("v"), 4).alias("cramer_v"), rounded(F.col("share"), 3).alias("relative_importance_pct"),
        (live & (F.col("p") < P_VALUE) & (F.col("v") >= CRAMER_V)).cast("int").alias("is_important"), F.col("n").alias("contingency_n"), F.col("p").alias("p_value"),
    )


def lost_customers(spark: SparkSession, sf_dir: str, days: int = 180) -> DataFrame:
    """Customers with lost = 1 if they have no order in the last days before the newest order."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    last = read("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    nation = F.broadcast(read("nation").select("n_nationkey", "n_name", "n_regionkey"))  # 25 rows by definition
    df = read("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(newest))
    lost = (F.col("last").isNull() | (F.col("last") < F.col("newest") - F.expr(f"INTERVAL {days} DAYS"))).cast("int")
    band = F.when(F.col("c_acctbal") < 2500, "low").when(F.col("c_acctbal") < 7500, "middle").otherwise("high")
    return df.select("c_custkey", lost.alias("lost"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"), band.alias("band"), F.when(F.col("c_acctbal") < 0, "yes").otherwise("no").alias("overdrawn"))


FEATURES = ["segment", "nation", "region", "band", "overdrawn"]


def churn_feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_summary(contingency(lost_customers(spark, sf_dir), FEATURES, "lost")).drop("p_value")


def churn_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_breakdown(contingency(lost_customers(spark, sf_dir), FEATURES, "lost"))


def churn_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    yes = F.count_if(F.col("lost") == 1)
    return lost_customers(spark, sf_dir).agg(n.alias("n_rows"), (n - yes).alias("n_no"), yes.alias("n_yes"), rounded(100.0 * yes / n, 3).alias("pct_yes"), F.lit(P_VALUE).alias("p_value_threshold"), F.lit(CRAMER_V).alias("cramer_v_threshold"))


_LOST = """last AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1), lost AS (
SELECT c_custkey, CASE WHEN last IS NULL OR last < (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY THEN 1 ELSE 0 END AS lost, c_mktsegment AS segment, n_name AS nation,
CAST(n_regionkey AS VARCHAR) AS region, CASE WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS band, CASE WHEN c_acctbal < 0 THEN 'yes' ELSE 'no' END AS overdrawn
FROM customer LEFT JOIN last ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
_TABLE = (
    _LOST
    + ", tab AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature_name, coalesce({f}, 'nan') AS category, count(*) FILTER (lost = 0) AS n_no, count(*) FILTER (lost = 1) AS n_yes FROM lost GROUP BY 2" for f in FEATURES)
    + ")"
)
_LIMITS = "[" + ", ".join(map(str, CHI2_LIMITS)) + "]"

QUERIES = {"churn_feature_summary": churn_feature_summary, "churn_category_breakdown": churn_category_breakdown, "churn_overview": churn_overview}
ORACLES = {
    "churn_overview": f"WITH {_LOST} SELECT count(*) AS n_rows, count(*) FILTER (lost = 0) AS n_no, count(*) FILTER (lost = 1) AS n_yes, floor(100.0 * count(*) FILTER (lost = 1) / count(*) * 1000 + 0.5) / 1000 AS pct_yes, CAST(0.05 AS DOUBLE) AS p_value_threshold, CAST(0.05 AS DOUBLE) AS cramer_v_threshold FROM lost",
    "churn_category_breakdown": f"WITH {_TABLE} SELECT feature_name, category, n_no, n_yes, n_no + n_yes AS n_total, floor(100.0 * n_no / (n_no + n_yes) * 100 + 0.5) / 100 AS pct_no, floor(100.0 * n_yes / (n_no + n_yes) * 100 + 0.5) / 100 AS pct_yes FROM tab",
    "churn_feature_summary": f"""WITH {_TABLE}, m AS (SELECT *, CAST(sum(n_no) OVER w AS DOUBLE) AS no, CAST(sum(n_yes) OVER w AS DOUBLE) AS yes, count(*) OVER w AS k FROM tab WINDOW w AS (PARTITION BY feature_name)),
e AS (SELECT *, (n_no + n_yes) * no / (no + yes) AS e0, (n_no + n_yes) * yes / (no + yes) AS e1, CASE WHEN k = 2 THEN 0.5 ELSE 0 END AS s FROM m),
c AS (SELECT feature_name, sum(power(abs(n_no - e0) - least(abs(n_no - e0), s), 2) / e0 + power(abs(n_yes - e1) - least(abs(n_yes - e1), s), 2) / e1) AS chi2, max(k) AS k, CAST(max(no + yes) AS BIGINT) AS n FROM e GROUP BY 1),
v AS (SELECT *, sqrt(chi2 / n) AS v FROM c)
SELECT feature_name, floor(chi2 * 1000 + 0.5) / 1000 AS chi2, k - 1 AS dof, floor(v * 10000 + 0.5) / 10000 AS cramer_v, floor(100 * v / sum(v) OVER () * 1000 + 0.5) / 1000 AS relative_importance_pct,
CAST(chi2 > {_LIMITS}[CAST(greatest(1, least(k - 1, 30)) AS INT)] AND v >= 0.05 AS INT) AS is_important, n AS contingency_n FROM v""",
}
