"""A linear model per series: one aggregate for all keys, one small solve per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.sequence import attach

#: from strong to weak shrinkage, as shares of a feature's variance
PATH = tuple(10.0 ** (2 - i / 2) for i in range(21))
#: steps without a better calibration error after which the path ends
PATIENCE = 4


def gram(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str]) -> DataFrame:
    """One row per key: means and deviations on the fit period, and the products of centred, scaled values.

    The products come for the fit and the calibration period in one aggregate, which combines before the
    shuffle, so a hot key costs one row per task.  Rows with a null among the columns are left out.
    """
    keys, cols = list(keys), [*features, y]
    rows = df.where(F.col("period").isin("fit", "calib")).select(*keys, "period", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    names = [f"x{i}" for i in range(len(cols))]
    rows = rows.na.drop(subset=names)
    on = F.col("period") == "fit"
    moments = rows.where(on).groupBy(*keys).agg(
        F.array(*[F.avg(x) for x in names]).alias("mean"), F.array(*[F.stddev_pop(x) for x in names]).alias("scale")
    )
    scaled = attach(rows, moments, keys)
    last = len(names) - 1

    def z(i: int) -> Column:
        """Centred, and scaled unless it is the target or does not vary."""
        centred = F.col(names[i]) - F.col("mean")[i]
        if i == last:
            return centred
        return F.when(F.col("scale")[i] > 0, centred / F.col("scale")[i]).otherwise(0.0)

    scaled = scaled.select(*keys, "period", "mean", "scale", *[z(i).alias(f"z{i}") for i in range(len(names))])
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    part = lambda p: F.array(
        F.count_if(F.col("period") == p).cast("double"),
        *[F.coalesce(F.sum(F.when(F.col("period") == p, F.col(f"z{i}"))), F.lit(0.0)) for i in range(len(names))],
        *[F.coalesce(F.sum(F.when(F.col("period") == p, F.col(f"z{i}") * F.col(f"z{j}"))), F.lit(0.0)) for i, j in pairs],
    )
    same = [F.first(c).alias(c) for c in ("mean", "scale")]
    return scaled.groupBy(*keys).agg(*same, part("fit").alias("fit"), part("calib").alias("calib"))


def _matrix(sums: list[float], size: int) -> tuple[float, np.ndarray]:
    """Rows, and the products of (1, z0, z1, ...) with themselves."""
    out = np.zeros((size + 1, size + 1))
    out[0, 0] = sums[0]
    out[0, 1:] = out[1:, 0] = sums[1 : size + 1]
    for (i, j), v in zip(combinations_with_replacement(range(size), 2), sums[size + 1 :], strict=True):
        out[i + 1, j + 1] = out[j + 1, i + 1] = v
    return sums[0], out


def solve_path(fit: list[float], calib: list[float], size: int, path: Sequence[float]) -> tuple[float, np.ndarray, float]:
    """The penalty, scaled weights and calibration error (without calibration rows: error on fit) of the best step."""
    n, g = _matrix(fit, size)
    m, c = _matrix(calib, size)
    watch, rows = (c, m) if m else (g, n)
    best, since = (float(path[0]), np.zeros(size - 1), np.inf), 0
    for penalty in path:
        a = g[1:size, 1:size] / n + penalty * np.eye(size - 1)
        # a singular matrix (penalty 0, equal features) takes the smallest weights
        w = np.linalg.lstsq(a, g[1:size, size] / n, rcond=None)[0]
        # z_y is centred on fit, where all means are zero: the error of w on the watched rows
        v = np.concatenate([[0.0], -w, [1.0]])
        error = float(v @ watch @ v) / rows
        if error < best[2]:
            best, since = (float(penalty), w, error), 0
        else:
            since += 1
            if since >= PATIENCE:
                break
    return best


def fit_ridge(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str] = (), path: Sequence[float] = PATH) -> DataFrame:
    """``keys, penalty, calib_mse, intercept, weights``: one linear model per key.

    Fitted on the fit period along a path of penalties from strong to weak, which stops early: once the
    calibration error has not improved for some steps.  What is solved per key is a matrix of the size of
    its features.  A key without fit rows has no model.
    """
    keys, size = list(keys), len(features) + 1
    sums = gram(df, features, y, keys)
    made = {"penalty": T.DoubleType(), "calib_mse": T.DoubleType(), "intercept": T.DoubleType(), "weights": T.ArrayType(T.DoubleType())}
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, t) for c, t in made.items()])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mean, scale, fit, calib in zip(*(batch[c].to_pylist() for c in ("mean", "scale", "fit", "calib")), strict=True):
                penalty, w, error = solve_path(fit, calib, size, path)
                s = np.array(scale[:-1])
                raw = np.divide(w, s, out=np.zeros(size - 1), where=s > 0)
                out.append((penalty, error, mean[-1] - float(raw @ np.array(mean[:-1])), raw.tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            arrays = [batch[k] for k in keys] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return sums.mapInArrow(solve, schema)


def predict_ridge(models: DataFrame, df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), out: str = "pred") -> DataFrame:
    """``df`` with the prediction of its key's model; null without a model or where a feature is null."""
    keys = list(keys)
    d = attach(df, models.select(*keys, F.col("intercept").alias("_b"), F.col("weights").alias("_w")), keys, "left")
    value = F.col("_b")
    for i, c in enumerate(features):
        value = value + F.col("_w")[i] * F.col(c).cast("double")
    return d.withColumn(out, value).drop("_b", "_w")
