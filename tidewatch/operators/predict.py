"""Predictions: seasonal means, and a trained regressor when one is wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exact import exact_means
from tidewatch.operators.sequence import attach

CALIB = "period = 'calib'"


def seasonal_means(df: DataFrame, y: str, season: Sequence[str], keys: Sequence[str] = ()):
    """Mean per season and overall, learned on the calibration period only."""
    calib = df.where(CALIB)
    return exact_means(calib, [*keys, *season], y, "_m"), exact_means(calib, keys, y, "_g")


def seasonal_naive(
    df: DataFrame, y: str, season: Sequence[str], keys: Sequence[str] = (), out: str = "pred_naive"
) -> DataFrame:
    by_season, overall = seasonal_means(df, y, season, keys)
    d = df.join(by_season, [*keys, *season], "left")
    d = attach(d, overall, list(keys), "left")
    return d.withColumn(out, F.coalesce("_m", "_g")).drop("_m", "_g")


def fit_predictor(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    kind: str = "gbt",
    seed: int = 42,
    max_iter: int = 40,
    max_depth: int = 4,
):
    """Train on fit, watch the calibration period for early stopping."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")]
    train = df.where(F.col("period").isin("fit", "calib")).select(*features, y, "period")
    if kind == "gbt":
        train = train.withColumn("_valid", F.col("period") == "calib")
        stages.append(
            GBTRegressor(
                featuresCol="_x",
                labelCol=y,
                predictionCol="pred",
                maxIter=max_iter,
                maxDepth=max_depth,
                stepSize=0.2,
                seed=seed,
                validationIndicatorCol="_valid",
            )
        )
    elif kind == "linear":
        train = train.where(F.col("period") == "fit")
        stages.append(
            LinearRegression(featuresCol="_x", labelCol=y, predictionCol="pred", solver="normal")
        )
    else:
        raise ValueError(f"unknown kind: {kind}")
    return Pipeline(stages=stages).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_x")
