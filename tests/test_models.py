"""Customer-loss models: unseen categories, weights, calibration and the choice of a model on tables with a known rule."""

import math

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from marketloom.operators import models

SF = "/root/testdata/sf0.001"


def known(spark, n=600):
    """Group a is lost seven times in ten, group b once in ten; x says nothing."""
    rows = [(i, "ab"[i % 2], float(i % 7), int((i * 7919) % 100 < (70, 10)[i % 2])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, x double, lost int")


def test_known_rule(spark):
    df = models.held_out(known(spark), "id")
    part = df.agg(F.avg(F.col("held_out").cast("int"))).first()[0]
    assert 0.12 < part < 0.28
    train = df.where("not held_out")
    encode = Pipeline(stages=models.encoder(["g"], ["x"])).fit(train)
    ready = models.balanced(encode.transform(train), "lost")
    weights = {r.lost: r.w for r in ready.groupBy("lost").agg(F.sum("weight").alias("w")).collect()}
    assert math.isclose(weights[0], weights[1])
    fit = models.calibrated(ready, models.candidates("lost")["logistic_regression"], "lost", "id")
    out = models.scored(df.unionByName(df.limit(1).withColumn("g", F.lit("new"))), encode, *fit)
    by = {r.g: (r.p, r.y) for r in out.groupBy("g").agg(F.avg("probability_churn").alias("p"), F.avg("lost").alias("y")).collect()}
    assert abs(by["a"][0] - by["a"][1]) < 0.12 and abs(by["b"][0] - by["b"][1]) < 0.12  # calibrated, although classes were weighed
    assert "new" in by and 0 < by["new"][0] < 1
    assert encode.transform(df.limit(1).withColumn("g", F.lit("new")).withColumn("x", F.lit(0.0))).first().features.toArray().tolist() == [0.0, 0.0, 0.0]
    assert out.where("predicted != cast(probability_churn >= 0.5 as int) or abs(confidence - abs(probability_churn - 0.5) * 2) > 1e-5").isEmpty()
    areas = models.cross_validated(ready, "lost", "id", folds=2)
    assert set(areas) == set(models.candidates("lost")) and all(a > 0.7 for a in areas.values())


def test_customers(spark):
    rows = models.churn_predictions(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    s = models.prediction_summary(rows).first()
    assert s.predicted_churn + s.predicted_no_churn == s.rows_total and s.least <= s.mean <= s.most
    assert models.prediction_summary(rows.where("false")).first().churn_rate == 0


def test_strata_are_exact(spark):
    rows = [(i, None if i % 97 == 0 else int(i % 11 == 0)) for i in range(5003)]
    df = spark.createDataFrame(rows, "id long, lost int")
    cuts = [0.2, 0.4, 0.6, 0.8]
    got = models.dealt(df, "id", "lost", cuts, "folds", "fold")
    counts = {}
    for r in got.groupBy("lost", "fold").count().collect():
        counts.setdefault(r.lost, {})[r.fold] = r["count"]
    for target, folds in counts.items():
        n = sum(y == target for _, y in rows)
        edges = [0, *(math.floor(c * n + 0.5) for c in cuts), n]
        assert [folds[k] for k in range(5)] == [b - a for a, b in zip(edges, edges[1:])]
    again = {r.id: r.fold for r in models.dealt(df.repartition(7), "id", "lost", cuts, "folds", "fold").collect()}
    assert again == {r.id: r.fold for r in got.collect()} and len(again) == len(rows)
    few = spark.createDataFrame([(1, 1), (2, 0)], "id long, lost int")
    assert models.held_out(few, "id").where("held_out").count() == 0
