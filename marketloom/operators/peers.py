"""Peers of one model: percentile, gaps to averages, nearest neighbours, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators.running import running_before
from marketloom.operators.tables import recent

LEAST_PEERS = 3


def supplier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites, regions as models; three scores of 0 to 20 from what they sold, and their sum."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("discount"))
    nation = F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_regionkey").alias("model")))
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(sold, F.col("s_suppkey") == F.col("l_suppkey"))
    kept = rounded(20.0 * (1 - F.col("returned") / F.col("n")))
    price = rounded(20.0 * (1 - F.col("discount").cast("double") / F.col("n") * 10))
    money = rounded(20.0 * F.greatest(F.lit(0.0), F.col("s_acctbal")) / 10000)
    return df.select(F.col("s_suppkey").alias("site"), "model", kept.alias("kept"), price.alias("price"), money.alias("money"), (kept + price + money).alias("overall"))


def level(score):
    """Band of a score of 0 to 60."""
    return F.when(score >= 48, "excellent").when(score >= 42, "strong").when(score >= 36, "good").when(score >= 24, "average").otherwise("weak")


def peer_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of peers at or below each site; null where a model has too few."""
    df = supplier_scores(spark, sf_dir)
    counts = df.groupBy("model", "overall").agg(F.count("*").alias("n"))
    total = counts.groupBy("model").agg(F.sum("n").alias("total"))
    below = F.col("before") + F.col("n")
    pct = running_before(counts, "overall", "n", ("model",)).join(total, "model").select("model", "overall", F.when(F.col("total") >= LEAST_PEERS, rounded(100.0 * (below / F.col("total")), 2)).alias("percentile"))
    return df.join(pct, ["model", "overall"]).select("site", "model", "overall", "percentile", level(F.col("overall")).alias("level"))


def peer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's gap to the rounded average of the model."""
    names = ["kept", "price", "money"]
    long = supplier_scores(spark, sf_dir).select("site", "model", F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in names))).alias("x")).select("site", "model", "x.*")
    mean = long.groupBy("model", "category").agg(rounded(F.avg("score")).alias("average"), F.count("*").alias("peers"))
    return long.join(mean, ["model", "category"]).select("site", "category", "score", "average", (F.col("score") - F.col("average")).alias("gap"), "peers")


def nearest(df: DataFrame, k: int) -> DataFrame:
    """site, peer, distance, position of the k peers of a model with the nearest score, higher scores and smaller ids first.

    A score's first k + 1 sites stand for it, and k scores on either side are enough, so no site meets all of its model.
    """
    some = recent(df, ["model", "overall"], [F.col("site")], k + 1).groupBy("model", "overall").agg(F.array_sort(F.collect_list("site")).alias("sites"))
    order = Window.partitionBy("model").orderBy("overall")
    own = F.struct("overall", "sites")
    sides = [f(own, d).over(order) for d in range(1, k + 1) for f in (F.lag, F.lead)]
    near = some.select("model", "overall", F.array(own, *sides).alias("near")).select("model", "overall", F.explode("near").alias("p")).where("p.overall is not null")
    near = near.select("model", "overall", F.col("p.overall").alias("peer_overall"), F.explode("p.sites").alias("peer"))
    rows = df.join(near, ["model", "overall"]).where("site != peer").withColumn("distance", F.abs(F.col("overall") - F.col("peer_overall")))
    return recent(rows, ["site"], [F.col("distance"), F.col("peer_overall").desc(), F.col("peer")], k).select("site", "peer", "distance", "position")


def nearest_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(supplier_scores(spark, sf_dir).select("site", "model", "overall"), 5)


_S = """WITH s AS (SELECT s_suppkey AS site, n_regionkey AS model, floor(20.0 * (1 - CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*)) + 0.5) AS kept, floor(20.0 * (1 - CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 10) + 0.5) AS price,
floor(20.0 * greatest(0, max(s_acctbal)) / 10000 + 0.5) AS money FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2), o AS (SELECT *, kept + price + money AS overall FROM s)"""
QUERIES = {f.__name__: f for f in (peer_percentiles, peer_gaps, nearest_peers)}
ORACLES = {
    "peer_percentiles": _S + " SELECT site, model, overall, CASE WHEN count(*) OVER (PARTITION BY model) >= 3 THEN floor(100.0 * cume_dist() OVER (PARTITION BY model ORDER BY overall) * 100 + 0.5) / 100 END AS percentile, CASE WHEN overall >= 48 THEN 'excellent' WHEN overall >= 42 THEN 'strong' WHEN overall >= 36 THEN 'good' WHEN overall >= 24 THEN 'average' ELSE 'weak' END AS level FROM o",
    "peer_gaps": _S + ", l AS (SELECT site, model, unnest(['kept', 'price', 'money']) AS category, unnest([kept, price, money]) AS score FROM o), m AS (SELECT model, category, floor(avg(score) + 0.5) AS average, count(*) AS peers FROM l GROUP BY 1, 2) SELECT site, category, score, average, score - average AS gap, peers FROM l JOIN m USING (model, category)",
    "nearest_peers": _S + ", r AS (SELECT a.site, b.site AS peer, abs(a.overall - b.overall) AS distance, row_number() OVER (PARTITION BY a.site ORDER BY abs(a.overall - b.overall), b.overall DESC, b.site) AS position FROM o a JOIN o b ON a.model = b.model AND a.site != b.site) SELECT * FROM r WHERE position <= 5",
}
