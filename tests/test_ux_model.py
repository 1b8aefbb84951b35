"""The score model: planted rules, missing values, unseen categories, and the spread of trees."""

import random
import statistics

import pytest
from marketloom.operators import ux_model as U
from pyspark.sql import functions as F

ROW = "id long, a double, b double, c string, empty double, human double"


@pytest.fixture(scope="module")
def planted(spark):
    """The score is 10 for kind x and 4 for kind y, plus 8 where a is large; b says nothing; some values are missing."""
    rng = random.Random(2)
    rows = []
    for i in range(800):
        a, kind = rng.random(), rng.choice("xy")
        score = {"x": 10.0, "y": 4.0}[kind] + (8 if a > 0.5 else 0)
        rows.append((i, a if i % 40 else None, rng.random(), kind if i % 50 else None, None, score if i < 700 else None))
    return spark.createDataFrame(rows, ROW).cache()


@pytest.mark.parametrize("kind", ["forest", "gradient_boosting", "linear"])
def test_planted_rule_is_learned(planted, kind):
    train = U.labelled(planted, "human")
    assert train.count() == 700 and train.agg(F.max("human")).first()[0] == 90  # 0 to 20 becomes 0 to 100
    model = U.UxModel(train, "human", ["a", "b", "empty"], ["c"], kind, trees=15)
    rows = model.predictions(planted.where("id >= 700 and a is not null and c is not null")).collect()
    truth = {("x", True): 90, ("x", False): 50, ("y", True): 60, ("y", False): 20}
    wrong = [abs(r.predicted - truth[r.c, r.a > 0.5]) for r in rows if abs(r.a - 0.5) > 0.05]
    assert statistics.mean(wrong) < (6 if kind != "linear" else 15)
    assert {r.confidence for r in rows} == {0.14} if kind != "forest" else all(0.05 <= r.confidence <= 0.95 for r in rows)


def test_spread_is_that_of_the_trees(planted):
    model = U.UxModel(U.labelled(planted, "human"), "human", ["a", "b"], ["c"], trees=7)
    some = planted.where("id < 60")
    features = {r.id: r.features for r in model.encoded(some).select("id", "features").collect()}
    for r in model.predictions(some).collect():
        each = [t.predict(features[r.id]) for t in model.model.trees]
        assert abs(r.predicted - statistics.fmean(each)) < 1e-3 and abs(r.spread - statistics.pstdev(each)) < 1e-3
        assert abs(r.confidence - min(0.95, max(0.05, 1 - statistics.pstdev(each) / 25))) < 1e-3 and r.varied == (statistics.pstdev(each) > 12)


def test_missing_values_and_unseen_categories(spark, planted):
    model = U.UxModel(U.labelled(planted, "human"), "human", ["a", "b"], ["c"], "linear")
    median = planted.where("human is not null").agg(F.percentile("a", 0.5)).first()[0]
    rows = spark.createDataFrame([(1, None, 0.5, "x", None, None), (2, median, 0.5, "x", None, None), (3, 0.2, 0.5, "new", None, None), (4, 0.2, 0.5, None, None, None)], ROW)
    got = {r.id: r.predicted for r in model.predictions(rows).collect()}
    common = planted.where("human is not null").agg(F.mode("c")).first()[0]
    like = model.predictions(rows.where("id = 3").withColumn("c", F.lit(common))).first().predicted
    assert abs(got[1] - got[2]) < 1.0 and got[4] == like and got[3] not in (like,)


def test_labels_out_of_range_or_absent(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, "x", None, 101.0)], ROW)
    with pytest.raises(ValueError, match="101"):
        U.labelled(rows, "human")
    with pytest.raises(ValueError, match="no labelled"):
        U.labelled(rows.withColumn("human", F.lit(None).cast("double")), "human")
    assert U.labelled(rows.withColumn("human", F.lit("100")), "human").first().human == 100.0


def test_weak_labels(spark):
    rows = spark.createDataFrame([(1, "human", None), (2, "app Weak_Label", None)], "id long, target_source string, human_notes string")
    assert U.weakly_labelled(rows) and not U.weakly_labelled(rows.where("id = 1")) and not U.weakly_labelled(rows.select("id"))
    assert U.weakly_labelled(rows.where("id = 1").withColumn("human_notes", F.lit("auto weak label, from scores")))
