"""Scores on common scales, levels, targets and blends; metrics of predictions; what to do first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import clamp, rounded
from marketloom.operators.health import BOUNDS, nation_kpis, scored_labels
from marketloom.operators.peers import supplier_scores
from marketloom.operators.tables import read, recent

# Levels with their least score of 20, targets, weights of a blend, penalties of unhealthy KPIs.
LEVELS = [("elite", 20), ("very_strong", 19), ("strong", 18), ("average", 17), ("below_average", 16), ("low", 13)]
LAST_LEVEL = "major_issue"
TARGETS = {"average": 17, "strong": 18, "top": 19}
BLEND, VERIFIED, POLISHED = (0.35, 0.65), (0.52, 0.48), (0.62, 0.38)
PENALTIES = {"conversion_rate": 7, "repeat_customer_rate": 8, "ad_spend_to_revenue_pct": 7, "avg_delivery_days": 6, "refund_rate": 6}
MOST = 20


def human_score(human: Column, overall: Column, parts: list[Column]) -> Column:
    """A score of 20 from one of 20 or 100, else from one of 100, else from parts of 100 together."""
    total = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts))
    return rounded(F.coalesce(F.when(human <= 20, human).otherwise(human / 5), overall / 5, total / 5), 1)


def level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][1], LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(LAST_LEVEL)


def ux_target(score: Column) -> Column:
    """The whole points below a score, less one under 17."""
    band = F.floor(rounded(score, 1))
    return clamp(F.when(band >= 17, band).otherwise(band - 1).cast("double"), 0.0, float(MOST))


def adjusted(own: Column, target: Column) -> Column:
    """A score moved towards a target by two points at most; a null target moves nothing."""
    crawl = clamp(rounded(own), 0.0, float(MOST))
    return F.when(target.isNull(), crawl).otherwise(clamp(crawl + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), target - crawl)), 0.0, float(MOST)))


def blended(own: Column, predicted: Column, verified: Column, layout: Column, polish: Column) -> Column:
    """Own score of 20 with a predicted one of 100, by how well the page was seen; a good verified score loses one point at most."""
    fine = verified & ((F.coalesce(layout, F.lit(0.0)) >= 82) | (F.coalesce(polish, F.lit(0.0)) >= 78))
    weight = lambda k: F.when(fine, POLISHED[k]).when(verified, VERIFIED[k]).otherwise(BLEND[k])
    base = clamp(own, 0.0, float(MOST))
    mixed = base * weight(0) + clamp(predicted / 5, 0.0, float(MOST)) * weight(1)
    return F.when(predicted.isNull(), base).otherwise(clamp(F.when(verified & (base >= 15), F.greatest(mixed, base - 1)).otherwise(mixed), 0.0, float(MOST)))


def trusted_blend(own: Column, predicted: Column, confidence: Column, weight: float = 0.4) -> Column:
    """Scores of 100 where the predicted one counts by its confidence."""
    w = weight * clamp(F.coalesce(confidence, F.lit(1.0)), 0.0, 1.0)
    return F.when(predicted.isNull(), clamp(own, 0.0, 100.0)).otherwise(rounded(clamp(own, 0.0, 100.0) * (1 - w) + clamp(predicted, 0.0, 100.0) * w, 2))


def density_score(density: Column) -> Column:
    return F.when(density <= 0, 70).when(density < 0.0008, 85).when(density < 0.0015, 70).when(density < 0.0025, 55).otherwise(35)


def gap_priority(gap: Column) -> Column:
    return F.when(gap >= 0.65, "critical").when(gap >= 0.45, "high").when(gap >= 0.25, "medium").otherwise("low")


def lift(gap: Column, matched: Column) -> tuple[Column, Column]:
    """Least and most points that mending a gap of so many points may give, by the number of findings."""
    high = F.greatest(F.lit(1.0), rounded(gap * F.when(matched >= 3, 0.55).when(matched == 2, 0.4).otherwise(0.3)))
    return F.greatest(F.lit(1.0), F.least(high, rounded(high * 0.5))), high


def position_priority(place: Column) -> Column:
    """From 1: the first is high, the next two medium."""
    return F.when(place == 1, "high").when(place <= 3, "medium").otherwise("low")


def truth(x: Column) -> Column:
    """Text as a boolean: blank, 0 and false are false, anything else is true."""
    return ~F.coalesce(F.lower(x).isin("", "0", "false"), F.lit(True))


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows where each named column has the wanted value; None asks for nothing."""
    return reduce(lambda d, c: d.where(F.col(c) == F.lit(wanted[c])), [c for c in wanted if wanted[c] is not None], df)


def risk(p: Column) -> dict[str, Column]:
    """What a probability of loss says: the verdict and how sure it is."""
    return {"will_lose": p >= 0.5, "confidence": F.abs(p - 0.5) * 2}


def health_score(p: Column) -> Column:
    """0 to 100: what risk leaves, less penalties of unhealthy KPIs."""
    bad = [F.when((F.col(c) < b) if op == "<" else (F.col(c) > b), float(PENALTIES[c])).otherwise(0.0) for c, op, b in BOUNDS if c in PENALTIES]
    return clamp(rounded((1 - p) * 100) - reduce(lambda a, b: a + b, bad), 0.0, 100.0)


def site_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site on the scale of 20: level, gaps to the targets, target of its look and its own score moved towards that."""
    rows = supplier_scores(spark, sf_dir).select("site", "model", "kept", human_score(F.lit(None).cast("double"), F.col("overall") * 5 / 3, [F.col("kept")]).alias("human"))
    target = ux_target(F.col("human"))
    return rows.select("site", "model", "human", level(F.col("human")).alias("level"), *(rounded(t - F.col("human"), 1).alias(f"gap_to_{n}") for n, t in TARGETS.items()), target.alias("target"), adjusted(F.col("kept"), target).alias("adjusted"))


def site_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_scores(spark, sf_dir)
    seen = F.col("price") >= 10
    return rows.select("site", rounded(blended(F.col("kept"), F.when(F.col("money") > 2, F.col("money") * 5), seen, F.col("price") * 5, F.col("money") * 5), 4).alias("blend"), trusted_blend(F.col("kept") * 5, F.col("money") * 5, F.col("price") / 20).alias("trusted"), density_score(F.col("money") / 10000).alias("density"))


def peer_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five sites of each model in each band."""
    rows = supplier_scores(spark, sf_dir).withColumn("human", rounded(F.col("overall") / 3, 1))
    near = rounded(F.col("human"))
    bands = F.array_compact(F.array(F.when(near == 12, "average"), F.when(near == 13, "strong"), F.when(F.col("human") >= 14, "top"), F.when(F.col("human") <= 11, "low")))
    return recent(rows.select("site", "model", "human", F.explode(bands).alias("band")), ["model", "band"], [F.col("human").desc(), F.col("site")], 5).select("model", "band", "site", "human", "position")


def site_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's priority and the points that mending may give."""
    names = ["kept", "price", "money"]
    rows = supplier_scores(spark, sf_dir)
    below = reduce(lambda a, b: a + b, ((F.col(c) < MOST).cast("int") for c in names))
    long = rows.select("site", below.alias("matched"), F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in names))).alias("x")).select("site", "matched", "x.*").where(F.col("score") < MOST)
    low, high = lift(MOST - F.col("score"), F.col("matched"))
    return long.select("site", "category", gap_priority(1 - F.col("score") / MOST).alias("priority"), low.alias("low"), high.alias("high"))


def nation_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each nation as the share of its unhealthy KPIs, with verdict, health score and status."""
    bad = reduce(lambda a, b: a + b, (F.coalesce(((F.col(c) < b) if op == "<" else (F.col(c) > b)).cast("int"), F.lit(0)) for c, op, b in BOUNDS))
    rows = nation_kpis(spark, sf_dir).withColumn("p", bad / len(BOUNDS)).withColumn("health", health_score(F.col("p")))
    status = F.when(F.col("health") < 45, "critical").when(F.col("health") < 65, "warning").otherwise("healthy")
    return rows.select("c_nationkey", rounded(F.col("p"), 6).alias("p"), *(rounded(v, 6).alias(k) if k == "confidence" else v.alias(k) for k, v in risk(F.col("p")).items()), "health", status.alias("status"))


def batch_summary(spark: SparkSession, sf_dir: str, threshold: float = 0.81) -> DataFrame:
    """Counts, rate and range of predicted probabilities; an empty batch has nulls and rate 0."""
    n, hit = F.count("*"), F.count_if(F.col("p") >= threshold)
    return scored_labels(spark, sf_dir).agg(n.alias("rows_total"), hit.alias("predicted"), (n - hit).alias("not_predicted"), rounded(hit / F.greatest(F.lit(1), n), 6).alias("rate"), F.min("p").alias("least"), F.max("p").alias("most"), rounded(F.avg("p"), 6).alias("mean"))


def weighted_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 of each label of rows(y, label) weighted by its rows; a label never predicted has precision 0."""
    table = rows.groupBy("y", "label").agg(F.count("*").alias("n"))  # a row a pair of labels
    right = table.where("y = label").select(F.col("y").alias("c"), F.col("n").alias("right"))
    real, said = table.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("real")), table.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("said"))
    each = real.join(said, "c", "left").join(right, "c", "left").na.fill(0)
    p, r = F.col("right") / F.greatest(F.lit(1), "said"), F.col("right") / F.col("real")
    each = each.select("real", "right", p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))
    mean = lambda c: rounded(F.sum(F.col(c) * F.col("real")) / F.sum("real"), 4)
    return each.agg(F.sum("real").alias("support"), rounded(F.sum("right") / F.sum("real"), 4).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_metrics(scored_labels(spark, sf_dir).select("y", (F.col("p") >= 0.5).cast("int").alias("label")))


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a plain estimate of line prices: a fixed price a piece."""
    y, e = F.col("l_extendedprice"), F.col("l_quantity") * 1500 - F.col("l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(y.alias("y"), e.alias("e"))
    sums = rows.agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.var_pop("y").alias("var"))
    return sums.select("n", rounded(F.col("mae"), 2).alias("mae"), rounded(F.sqrt("mse"), 2).alias("rmse"), rounded(1 - F.col("mse") / F.col("var"), 4).alias("r2"))


def held_out(key: Column, seed: Column, share: float = 0.2) -> Column:
    """Whether a row is in the hold-out part: by a hash of its key and the seed, so each class gives about its share, without a shuffle."""
    return F.substring(F.md5(F.concat_ws(":", key.cast("string"), seed.cast("string"))), 1, 6) < F.lit(f"{int(share * 16**6):06x}")


def run_statistics(spark: SparkSession, sf_dir: str, first: int = 42, runs: int = 20) -> DataFrame:
    """Accuracy on the hold-out parts of several seeds: mean, deviation, range, best seed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("n_chars") >= 2000).cast("int").alias("label"))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").join(docs, "doc_id").select("doc_id", (F.col("quality") == F.col("label")).cast("int").alias("right"), F.explode(F.sequence(F.lit(first), F.lit(first + runs - 1))).alias("seed"))
    runs_ = rows.where(held_out(F.col("doc_id"), F.col("seed"))).groupBy("seed").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))
    return runs_.agg(F.count("*").alias("runs"), F.sum("n").alias("rows_scored"), rounded(F.avg("accuracy"), 5).alias("mean"), rounded(F.stddev_pop("accuracy"), 5).alias("std"), rounded(F.min("accuracy"), 5).alias("least"), rounded(F.max("accuracy"), 5).alias("most"), F.max(F.struct("accuracy", F.negative("seed").alias("s")))["s"].alias("s")).withColumn("best_seed", -F.col("s")).drop("s")


def order_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's five largest orders: the first three are primary; priority by place."""
    rows = recent(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)
    return rows.select("o_custkey", "o_orderkey", "position", F.when(F.col("position") <= 3, "primary").otherwise("secondary").alias("tier"), position_priority(F.col("position")).alias("priority"))


def row_costs(spark: SparkSession, sf_dir: str, base: int = 10, per_row: float = 0.5) -> DataFrame:
    """Credits that each customer's batch of orders costs: a base and a part a row."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg((base + per_row * F.count("*")).alias("cost"))


def research_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six search queries for each business, from its name, kind, product and buyers."""
    name, kind, buyers = F.col("c_name"), F.lower("c_mktsegment"), F.lit("customers")
    made = [F.concat_ws(" ", *parts) for parts in (
        (name, F.lit("competitors"), kind), (F.lit("products customer reviews"),), (F.lit("products"), kind, F.lit("trends")), (buyers, F.lit("buying behavior products")), (F.lit("successful"), kind, F.lit("brands products")), (name, F.lit("brand mentions")))]
    return read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(*made)).alias("place", "query"))


# Add-ons that keep customers, and how their absence is written.
ADD_ONS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
ABSENT = ["No", "No internet service"]


def retention_advice(rows: DataFrame, most: int = 8) -> DataFrame:
    """rows(predicted_churn, the add-ons, Contract, PaperlessBilling) with advice: keys of what to do, the first ``most``."""
    risk_first = F.when(F.col("predicted_churn"), "prioritize_retention").otherwise("prevent_and_upsell")
    missing = [F.when(F.trim(F.col(c)).isin(*ABSENT), F.lit(f"offer:{c}")) for c in ADD_ONS]
    contract = F.when(F.trim("Contract") == "Month-to-month", "longer_contract")
    paper = F.when(F.trim("PaperlessBilling") == "No", "paperless_billing")
    return rows.withColumn("advice", F.slice(F.array_compact(F.array(risk_first, *missing, contract, paper, F.lit("targeted_offer"), F.lit("review_tickets"))), 1, most))


def completions(log: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """key, status, completed_at of the latest row of log(key, status, at, ...): when it last changed to done; null unless it still is."""
    own = Window.partitionBy(key).orderBy(*order)
    rows = log.select(key, "status", at, F.struct(*order).alias("o"), F.lag("status").over(own).alias("before"))
    begun = F.max(F.when((F.col("status") == "done") & ~F.col("before").eqNullSafe("done"), F.col(at)))
    latest = rows.groupBy(key).agg(F.max_by("status", "o").alias("status"), begun.alias("begun"))
    return latest.select(key, "status", F.when(F.col("status") == "done", F.col("begun")).alias("completed_at"))


def user_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as status changes, done by a purchase and open again by anything else."""
    log = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "purchase", "done").otherwise("open").alias("status"), "ts", "event_id")
    return completions(log, "user_id", ["ts", "event_id"], "ts").select("user_id", "status", F.unix_micros(F.col("completed_at").cast("timestamp")).alias("completed_us"))


def _r(x: str, places: int = 0) -> str:
    return f"(floor(({x}) * {10**places} + 0.5) / {10**places})"


_S = f"""WITH sold AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, sum(CAST(l_discount AS DECIMAL(18,2))) AS discount FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey AS site, n_regionkey AS model, {_r('20.0 * (1 - returned / n)')} AS kept, {_r('20.0 * (1 - CAST(discount AS DOUBLE) / n * 10)')} AS price, {_r('20.0 * greatest(0.0, s_acctbal) / 10000')} AS money FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN sold ON s_suppkey = l_suppkey),
o AS (SELECT *, kept + price + money AS overall FROM s)"""
_LEVEL = " ".join(f"WHEN human >= {n} THEN '{k}'" for k, n in LEVELS)
_GAPS = ", ".join(f"{_r(f'{t} - human', 1)} AS gap_to_{n}" for n, t in TARGETS.items())
_L = "l AS (SELECT doc_id, CAST(quality AS INT) AS y, least(1.0, n_chars / 4000.0) AS p, n_chars FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


def _health() -> str:
    from marketloom.operators.health import ORACLES as own

    kpis = own["nation_advice"].split(",\nf AS")[0]
    bad = " + ".join(f"coalesce(CAST({c} {op} {b} AS INT), 0)" for c, op, b in BOUNDS)
    less = " + ".join(f"CASE WHEN {c} {op} {b} THEN {PENALTIES[c]} ELSE 0 END" for c, op, b in BOUNDS if c in PENALTIES)
    return f"{kpis}, b AS (SELECT *, ({bad}) / 6 AS p FROM k), h AS (SELECT c_nationkey, p, CAST(greatest(0, least(100, floor((1 - p) * 100 + 0.5) - ({less}))) AS DOUBLE) AS health FROM b) SELECT c_nationkey, {_r('p', 6)} AS p, p >= 0.5 AS will_lose, {_r('abs(p - 0.5) * 2', 6)} AS confidence, health, CASE WHEN health < 45 THEN 'critical' WHEN health < 65 THEN 'warning' ELSE 'healthy' END AS status FROM h"


QUERIES = {f.__name__: f for f in (site_levels, site_blends, peer_examples, site_gaps, nation_health, batch_summary, label_metrics, regression_metrics, run_statistics, order_tiers, row_costs, research_queries, user_completions)}
ORACLES = {
    "site_levels": f"{_S}, h AS (SELECT site, model, kept, {_r('overall * 5 / 3 / 5', 1)} AS human FROM o), t AS (SELECT *, greatest(0.0, least(20.0, CASE WHEN floor(human) >= 17 THEN floor(human) ELSE floor(human) - 1 END)) AS target FROM h) SELECT site, model, human, CASE {_LEVEL} ELSE '{LAST_LEVEL}' END AS level, {_GAPS}, CAST(target AS DOUBLE) AS target, CAST(greatest(0.0, least(20.0, kept + greatest(-2.0, least(2.0, target - kept)))) AS DOUBLE) AS adjusted FROM t",
    "site_blends": f"{_S}, w AS (SELECT *, price >= 10 AS seen, price >= 10 AND (price * 5 >= 82 OR money * 5 >= 78) AS fine FROM o), m AS (SELECT *, kept * CASE WHEN fine THEN 0.62 WHEN seen THEN 0.52 ELSE 0.35 END + money * CASE WHEN fine THEN 0.38 WHEN seen THEN 0.48 ELSE 0.65 END AS mixed FROM w) SELECT site, CAST({_r('CASE WHEN money <= 2 THEN kept WHEN seen AND kept >= 15 THEN greatest(mixed, kept - 1) ELSE mixed END', 4)} AS DOUBLE) AS blend, CAST({_r('kept * 5 * (1 - 0.4 * price / 20) + money * 5 * 0.4 * price / 20', 2)} AS DOUBLE) AS trusted, CASE WHEN money / 10000 <= 0 THEN 70 WHEN money / 10000 < 0.0008 THEN 85 WHEN money / 10000 < 0.0015 THEN 70 WHEN money / 10000 < 0.0025 THEN 55 ELSE 35 END AS density FROM m",
    "peer_examples": f"{_S}, h AS (SELECT site, model, {_r('overall / 3', 1)} AS human FROM o), b AS (SELECT site, model, human, unnest(list_filter([CASE WHEN floor(human + 0.5) = 12 THEN 'average' END, CASE WHEN floor(human + 0.5) = 13 THEN 'strong' END, CASE WHEN human >= 14 THEN 'top' END, CASE WHEN human <= 11 THEN 'low' END], lambda x: x IS NOT NULL)) AS band FROM h), r AS (SELECT model, band, site, human, row_number() OVER (PARTITION BY model, band ORDER BY human DESC, site) AS position FROM b) SELECT * FROM r WHERE position <= 5",
    "site_gaps": f"{_S}, g AS (SELECT site, CAST(kept < 20 AS INT) + CAST(price < 20 AS INT) + CAST(money < 20 AS INT) AS matched, unnest([{{'category': 'kept', 'score': kept}}, {{'category': 'price', 'score': price}}, {{'category': 'money', 'score': money}}], recursive := true) FROM o), h AS (SELECT *, greatest(1.0, floor((20 - score) * CASE WHEN matched >= 3 THEN 0.55 WHEN matched = 2 THEN 0.4 ELSE 0.3 END + 0.5)) AS high FROM g WHERE score < 20) SELECT site, category, CASE WHEN 1 - score / 20 >= 0.65 THEN 'critical' WHEN 1 - score / 20 >= 0.45 THEN 'high' WHEN 1 - score / 20 >= 0.25 THEN 'medium' ELSE 'low' END AS priority, CAST(greatest(1.0, least(high, floor(high * 0.5 + 0.5))) AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM h",
    "nation_health": _health(),
    "batch_summary": f"WITH {_L} SELECT count(*) AS rows_total, count(*) FILTER (p >= 0.81) AS predicted, count(*) FILTER (p < 0.81) AS not_predicted, {_r('count(*) FILTER (p >= 0.81) / greatest(1, count(*))', 6)} AS rate, min(p) AS least, max(p) AS most, {_r('avg(p)', 6)} AS mean FROM l",
    "label_metrics": f"WITH {_L}, t AS (SELECT y, CAST(p >= 0.5 AS INT) AS label, count(*) AS n FROM l GROUP BY 1, 2), e AS (SELECT c, (SELECT sum(n) FROM t WHERE y = c) AS actual, coalesce((SELECT sum(n) FROM t WHERE label = c), 0) AS said, coalesce((SELECT sum(n) FROM t WHERE label = c AND y = c), 0) AS hit FROM (SELECT DISTINCT y AS c FROM t)), f AS (SELECT *, hit / greatest(1, said) AS p, hit / actual AS r FROM e) SELECT CAST(sum(actual) AS BIGINT) AS support, {_r('sum(hit) / sum(actual)', 4)} AS accuracy, {_r('sum(p * actual) / sum(actual)', 4)} AS precision, {_r('sum(r * actual) / sum(actual)', 4)} AS recall, {_r('sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * actual) / sum(actual)', 4)} AS f1 FROM f",
    "regression_metrics": f"SELECT count(*) AS n, {_r('avg(abs(l_quantity * 1500 - l_extendedprice))', 2)} AS mae, {_r('sqrt(avg(power(l_quantity * 1500 - l_extendedprice, 2)))', 2)} AS rmse, {_r('1 - avg(power(l_quantity * 1500 - l_extendedprice, 2)) / var_pop(l_extendedprice)', 4)} AS r2 FROM lineitem",
    "run_statistics": f"WITH {_L}, s AS (SELECT CAST(y = CAST(n_chars >= 2000 AS INT) AS INT) AS hit, seed, md5(doc_id || ':' || seed) AS h FROM l, range(42, 62) t(seed)), a AS (SELECT seed, count(*) AS n, avg(hit) AS accuracy FROM s WHERE h[1:6] < '{int(0.2 * 16**6):06x}' GROUP BY 1) SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS rows_scored, {_r('avg(accuracy)', 5)} AS mean, {_r('stddev_pop(accuracy)', 5)} AS std, {_r('min(accuracy)', 5)} AS least, {_r('max(accuracy)', 5)} AS most, CAST((SELECT seed FROM a ORDER BY accuracy DESC, seed LIMIT 1) AS INT) AS best_seed FROM a",
    "order_tiers": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) SELECT *, CASE WHEN position <= 3 THEN 'primary' ELSE 'secondary' END AS tier, CASE WHEN position = 1 THEN 'high' WHEN position <= 3 THEN 'medium' ELSE 'low' END AS priority FROM r WHERE position <= 5",
    "user_completions": "WITH l AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS done, lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), g AS (SELECT user_id, last(done ORDER BY ts, event_id) AS done, max(ts) FILTER (done AND NOT coalesce(before, false)) AS begun FROM l GROUP BY 1) SELECT user_id, CASE WHEN done THEN 'done' ELSE 'open' END AS status, CASE WHEN done THEN epoch_us(begun) END AS completed_us FROM g",
    "row_costs": "SELECT o_custkey, CAST(10 + 0.5 * count(*) AS DOUBLE) AS cost FROM orders GROUP BY 1",
    "research_queries": "WITH q AS (SELECT c_custkey, [c_name || ' competitors ' || lower(c_mktsegment), 'products customer reviews', 'products ' || lower(c_mktsegment) || ' trends', 'customers buying behavior products', 'successful ' || lower(c_mktsegment) || ' brands products', c_name || ' brand mentions'] AS q FROM customer) SELECT c_custkey, CAST(generate_subscripts(q, 1) - 1 AS INT) AS place, unnest(q) AS query FROM q",
}
