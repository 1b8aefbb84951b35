"""Customer-loss models with Spark ML: one-hot features, cross-validated choice, calibrated probabilities, scored tables."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.functions.work import kept
from marketloom.operators.association import FEATURES, lost_customers

HELD_OUT, FOLDS, CALIBRATION_FOLDS, THRESHOLD = 0.2, 5, 3, 0.5
#: Leading bits of a row's hash by which strata are counted, and fits that run at once.
PREFIX_BITS, AT_ONCE = 12, 4


def dealt(df: DataFrame, key: str, target: str, cuts: list[float], salt: str, name: str) -> DataFrame:
    """df with name: the part, from 0, of each row, cut at those shares of each class's rows, exactly to a row. key tells rows apart.

    Rows are ordered by a hash of the key, so a row's part doesn't depend on how rows lie. Counts of hash prefixes by class say which prefixes lie within one part; only the rows
    of the few prefixes that a cut goes through are ranked. Null classes are one class.
    """
    spread = F.xxhash64(F.col(key), F.lit(salt))
    rows = df.withColumns({"_h": spread, "_p": F.shiftrightunsigned(spread, 64 - PREFIX_BITS).cast("int")})
    prefixes = rows.groupBy(F.col(target).alias("_class"), F.col("_p").alias("_of")).agg(F.count("*").alias("_n"))  # 2 ** PREFIX_BITS rows a class at most
    own = Window.partitionBy("_class")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = F.array(*(F.floor(F.lit(c) * F.sum("_n").over(own) + 0.5) for c in cuts))
    prefixes = prefixes.withColumns({"_before": before, "_quotas": quotas})
    passed = lambda rank: F.size(F.filter("_quotas", lambda q: q < rank))
    prefixes = prefixes.withColumns({"_low": passed(F.col("_before") + 1), "_high": passed(F.col("_before") + F.col("_n"))})
    both = rows.join(prefixes, F.col(target).eqNullSafe(F.col("_class")) & (F.col("_p") == F.col("_of")))
    whole = both.where("_low = _high").select(*df.columns, F.col("_low").alias(name))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_class", "_of").orderBy("_h", key))
    cut = both.where("_low < _high").withColumn("_rank", rank).select(*df.columns, passed(F.col("_rank")).alias(name))
    return whole.unionByName(cut)


def held_out(df: DataFrame, key: str, part: float = HELD_OUT, target: str = "lost") -> DataFrame:
    """With held_out: that part of the rows of each class, to a row."""
    return dealt(df, key, target, [part], "held out", "_part").withColumn("held_out", F.col("_part") == 0).drop("_part")


def balanced(df: DataFrame, target: str) -> DataFrame:
    """With weight: both classes weigh the same. An empty class is left as it is."""
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("yes")).first()
    yes, no = max(1, n.yes), max(1, n.n - n.yes)
    return df.withColumn("weight", F.when(F.col(target) == 1, n.n / (2 * yes)).otherwise(n.n / (2 * no)))


def encoder(categories: list[str], numbers: list[str]) -> list:
    """Stages that make the column features; a category that training has not seen is zero everywhere."""
    index = [f"{c}_index" for c in categories]
    hot = [f"{c}_hot" for c in categories]
    stages = [StringIndexer(inputCols=categories, outputCols=index, handleInvalid="keep"), OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)] if categories else []
    return [*stages, VectorAssembler(inputCols=[*hot, *numbers], outputCol="features")]


def candidates(target: str, seed: int = 7) -> dict:
    return {
        "gradient_boosting": GBTClassifier(labelCol=target, weightCol="weight", maxIter=10, maxDepth=4, seed=seed),
        "logistic_regression": LogisticRegression(labelCol=target, weightCol="weight", maxIter=100, regParam=0.01),
        "random_forest": RandomForestClassifier(labelCol=target, weightCol="weight", numTrees=20, maxDepth=6, seed=seed),
    }


def in_parallel(work: list) -> list:
    """Results of functions that each run Spark jobs of their own, some at a time."""
    with ThreadPool(min(AT_ONCE, len(work))) as pool:
        return pool.map(inheritable_thread_target(lambda f: f()), work)


def by_folds(train: DataFrame, model, key: str, target: str, folds: int, salt: str) -> list:
    """For each fold, a function that fits the rows outside it and gives those in it with the fit's outputs."""
    rows = kept(dealt(train, key, target, [k / folds for k in range(1, folds)], salt, "fold"))
    return [lambda k=k: model.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)) for k in range(folds)]


def cross_validated(train: DataFrame, target: str, key: str, folds: int = FOLDS, seed: int = 7) -> dict[str, float]:
    """Mean area under the curve of each candidate; train has features and weight. All have the same folds."""
    area = BinaryClassificationEvaluator(labelCol=target)
    rows = kept(dealt(train, key, target, [k / folds for k in range(1, folds)], "folds", "fold"))
    names = candidates(target, seed)

    def one(name: str, k: int) -> float:
        return area.evaluate(candidates(target, seed)[name].fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)))

    areas = in_parallel([lambda name=name, k=k: one(name, k) for name in names for k in range(folds)])
    return {name: sum(areas[i * folds : (i + 1) * folds]) / folds for i, name in enumerate(names)}


def margin() -> Column:
    return vector_to_array("rawPrediction")[1]


def calibrated(train: DataFrame, model, target: str, key: str, folds: int = CALIBRATION_FOLDS):
    """The model fit to all rows, and slope and intercept that turn its margins to probabilities, learned from rows left out of fits."""
    left_out = reduce(DataFrame.unionByName, (x.select(F.col(target).alias("label"), margin().alias("margin")) for x in in_parallel(by_folds(train, model, key, target, folds, "calibration"))))
    line = LogisticRegression().fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(left_out))
    return model.fit(train), float(line.coefficients[0]), float(line.intercept)


def scored(df: DataFrame, encode: PipelineModel, model, slope: float, intercept: float, threshold: float = THRESHOLD) -> DataFrame:
    """df with probability, predicted, label and confidence (0 at even odds, 1 when sure)."""
    rows = model.transform(encode.transform(df)).withColumn("probability_churn", rounded(1 / (1 + F.exp(-(slope * margin() + intercept))), 6))
    p = F.col("probability_churn")
    return rows.select(*df.columns, "probability_churn", (p >= threshold).cast("int").alias("predicted"), F.when(p >= threshold, "Churn").otherwise("No churn").alias("label"), rounded(F.abs(p - 0.5) * 2, 6).alias("confidence"))


def prediction_summary(rows: DataFrame) -> DataFrame:
    p = F.col("probability_churn")
    yes = F.count_if(F.col("predicted") == 1)
    return rows.agg(F.count("*").alias("rows_total"), yes.alias("predicted_churn"), (F.count("*") - yes).alias("predicted_no_churn"), rounded(yes / F.greatest(F.count("*"), F.lit(1)), 6).alias("churn_rate"), F.min(p).alias("least"), F.max(p).alias("most"), rounded(F.avg(p), 6).alias("mean"))


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PipelineModel, DataFrame]:
    """All customers with held_out, the encoder that the others fit, and those others encoded and weighed."""
    df = kept(held_out(lost_customers(spark, sf_dir).withColumn("region", F.col("region").cast("string")).na.fill("nan", FEATURES), "c_custkey"))
    train = df.where("not held_out")
    encode = Pipeline(stages=encoder(FEATURES, [])).fit(train)
    return df, encode, kept(balanced(encode.transform(train), "lost"))


def churn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's calibrated risk by logistic regression, learned without the held-out ones."""
    df, encode, train = prepared(spark, sf_dir)
    fit = calibrated(train, candidates("lost")["logistic_regression"], "lost", "c_custkey")
    return scored(df.select("c_custkey", "lost", "held_out", *FEATURES), encode, *fit).drop(*FEATURES)


def churn_prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_summary(churn_predictions(spark, sf_dir))


def churn_model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated area under the curve of each candidate, and which is chosen (ties: the first by name)."""
    areas = cross_validated(prepared(spark, sf_dir)[2], "lost", "c_custkey")
    best = max(sorted(areas), key=areas.get)
    return spark.createDataFrame([(name, a, name == best) for name, a in areas.items()], "model string, auc double, chosen boolean")


QUERIES = {f.__name__: f for f in (churn_predictions, churn_prediction_summary, churn_model_choice)}
#: Learned values have no SQL; tests hold them against plain computations and held-out rows.
ORACLES: dict[str, str] = {}
