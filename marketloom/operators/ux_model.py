"""Scores learned from human labels: imputed and scaled features, three regressors, and confidence from how trees differ.

Labels of 0 to 20 or of 0 to 100 become 0 to 100. Missing numbers are the median's, missing categories the commonest's, categories that training hasn't seen
are zero everywhere. A forest's confidence falls with the spread of its trees' predictions; other models have the fixed one of a baseline.
Defined cases: rows without a label aren't learned from but are scored; a column without any value counts as zero.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.functions.work import kept
from marketloom.operators.models import dealt

# Range of confidence, the spread at which none is left, the confidence of a model without trees.
LOW, HIGH, SPREAD, BASELINE, VARIED = 0.05, 0.95, 25.0, 0.14, 12.0
WEAK_LABELS = {"target_source": "weak_label", "human_notes": "AUTO WEAK LABEL"}
TREES = 60


def labelled(df: DataFrame, target: str) -> DataFrame:
    """Rows with a label, the label on a scale of 0 to 100. ValueError if there is none or one is above 100."""
    rows = df.withColumn(target, F.col(target).cast("double")).where(F.col(target).isNotNull())
    most = rows.agg(F.max(target)).first()[0]
    if most is None:
        raise ValueError("no labelled rows")
    if most > 100:
        raise ValueError(f"labels must be on a scale of 0 to 20 or 0 to 100, not up to {most:.2f}")
    return rows.withColumn(target, F.col(target) * (5.0 if most <= 20 else 1.0))


def weakly_labelled(df: DataFrame) -> bool:
    """Whether notes or sources of labels say that scores of the application were taken for human ones."""
    tests = [F.lower(c).contains(word.lower()) for c, word in WEAK_LABELS.items() if c in df.columns]
    return bool(tests) and not df.where(F.coalesce(*tests) if len(tests) == 1 else F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False))).isEmpty()


class Filled:
    """Commonest values of the categories and presence of numbers, from training rows."""

    def __init__(self, train: DataFrame, numbers: list[str], categories: list[str]):
        row = train.agg(*(F.mode(c).alias(c) for c in categories), *(F.count(c).alias(c) for c in numbers)).first()
        self.modes = {c: str(row[c]) if row[c] is not None else "" for c in categories}
        self.empty = [c for c in numbers if row[c] == 0]

    def __call__(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in self.modes.items()})
        return df.withColumns({c: F.lit(0.0) for c in self.empty}) if self.empty else df


def features(numbers: list[str], categories: list[str]) -> Pipeline:
    """Stages that make the column features: medians for missing numbers, all scaled; categories one-hot."""
    full, index, hot = [f"{c}_full" for c in numbers], [f"{c}_index" for c in categories], [f"{c}_hot" for c in categories]
    stages = [
        Imputer(inputCols=numbers, outputCols=full, strategy="median"), VectorAssembler(inputCols=full, outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
        *([StringIndexer(inputCols=categories, outputCols=index, handleInvalid="keep"), OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)] if categories else []), VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
    ]
    return Pipeline(stages=stages)


def regressor(kind: str, target: str, trees: int = TREES, seed: int = 42):
    """gradient_boosting, linear, or any other name: a forest."""
    if kind == "linear":
        return LinearRegression(labelCol=target, regParam=1e-6)
    if kind == "gradient_boosting":
        return GBTRegressor(labelCol=target, maxIter=30, maxDepth=3, seed=seed)
    return RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="all", seed=seed)


def spread_confidence(each: Column) -> tuple[Column, Column, Column]:
    """Mean, spread (of the whole, not of a sample) and confidence of an array of predictions."""
    n = F.size(each)
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(F.transform(each, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n)
    return mean, spread, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), 1.0 - spread / SPREAD))


class UxModel:
    """A fit: filled values, features, a model."""

    def __init__(self, train: DataFrame, target: str, numbers: list[str], categories: list[str], kind: str = "forest", trees: int = TREES):
        numbered = train.withColumns({c: F.col(c).cast("double") for c in numbers})
        self.numbers, self.filled = numbers, Filled(numbered, numbers, categories)
        ready = self.filled(numbered)
        self.encode: PipelineModel = features(numbers, categories).fit(ready)
        self.model = regressor(kind, target, trees).fit(kept(self.encode.transform(ready).select("features", target)))

    def encoded(self, df: DataFrame) -> DataFrame:
        return self.encode.transform(self.filled(df.withColumns({c: F.col(c).cast("double") for c in self.numbers})))

    def predictions(self, df: DataFrame) -> DataFrame:
        """df with predicted (0 to 100), spread, confidence and varied (whether trees differed widely)."""
        rows = self.encoded(df)
        if isinstance(self.model, RandomForestRegressionModel):
            names = []
            for k, tree in enumerate(self.model.trees):
                names.append(f"_tree{k}")
                rows = tree.setFeaturesCol("features").setPredictionCol(names[-1]).transform(rows)
            mean, spread, sure = spread_confidence(F.col("_each"))
            rows = rows.withColumn("_each", F.array(*names))
        else:
            rows = self.model.transform(rows)
            mean, spread, sure = F.col("prediction"), F.lit(None).cast("double"), F.lit(BASELINE)
        predicted = F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean))
        return rows.select(*df.columns, rounded(predicted, 4).alias("predicted"), rounded(spread, 4).alias("spread"), rounded(sure, 4).alias("confidence"), F.coalesce(spread > VARIED, F.lit(False)).alias("varied"))


NUMBERS, CATEGORIES = ["n_chars", "n_lines", "mean_line", "max_line", "digits_share", "ends_share"], ["lang", "source"]


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and figures of the layout of each text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.length(x))
    rows = docs.select("doc_id", "lang", "source", "text", lines.alias("lines"))
    n = F.greatest(F.lit(1), F.length(text))
    return rows.select(
        "doc_id", "lang", "source", F.length(text).alias("n_chars"), F.size("lines").alias("n_lines"), (F.aggregate("lines", F.lit(0), lambda a, x: a + x) / F.size("lines")).alias("mean_line"), F.array_max("lines").alias("max_line"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / n).alias("digits_share"), (F.length(F.regexp_replace(text, "[^.!?]", "")) / n).alias("ends_share"),
    )


def text_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted quality of every labelled document, learned from four fifths of them by a forest over layout, language and source."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg((F.max("quality") * 20).alias("human_score"))
    rows = kept(labelled(text_features(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id"), "human_score"))
    rows = kept(dealt(rows, "doc_id", "human_score", [0.2], "quality", "part"))
    model = UxModel(rows.where("part = 1"), "human_score", NUMBERS, CATEGORIES, trees=20)
    return model.predictions(rows).select("doc_id", "human_score", (F.col("part") == 0).alias("held_out"), "predicted", "spread", "confidence", "varied")


QUERIES = {f.__name__: f for f in (text_quality_scores,)}
#: Learned values have no SQL; tests hold them against planted rules and single trees.
ORACLES: dict[str, str] = {}
