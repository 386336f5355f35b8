"""A linear probe that learns a teacher's labels from features, and its fidelity."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(rows: DataFrame, features: str) -> DataFrame:
    return rows.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))


def fit(rows: DataFrame, features: str, label: str, c: float = 1.0, iterations: int = 1_000) -> LogisticRegressionModel:
    """Multinomial logistic regression with the ridge of strength c over the sum of losses."""
    kept = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    n = kept.count()
    return LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=iterations).fit(_vectors(kept, features))


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: str) -> DataFrame:
    """Adds prediction and confidence (the largest class probability)."""
    return model.transform(_vectors(rows, features)).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("_features", "rawPrediction", "probability")


def fidelity(predicted: DataFrame, teacher: str) -> DataFrame:
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("prediction") == F.col(teacher), 1.0).otherwise(0.0)).alias("fidelity"))


def abstain(predicted: DataFrame, threshold: float) -> DataFrame:
    return predicted.withColumn("answer", F.when(F.col("confidence") >= threshold, F.col("prediction")))
