"""Cut a series by time into fit, calib and test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ContractError
from tidewatch.operators.sequence import attach

PERIODS = ("fit", "calib", "test")


def split_spec(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    ratios: tuple[float, float] | None = None,
    dates: tuple[str, str] | None = None,
) -> DataFrame:
    """Boundaries per key: ``split_type, fit_start, calib_start, test_start, n``.

    Ratios pick boundary *rows* (needs ``row_no``), so the boundaries are timestamps
    that exist; dates are taken as they are.
    """
    keys = list(keys)
    if dates is not None:
        calib, test = dates
        return df.groupBy(*keys).agg(
            F.lit("fixed_date").alias("split_type"),
            F.min(ts).alias("fit_start"),
            F.to_timestamp(F.lit(calib)).alias("calib_start"),
            F.to_timestamp(F.lit(test)).alias("test_start"),
            F.count(F.lit(1)).alias("n"),
        )
    fit_ratio, calib_ratio = ratios or (0.60, 0.20)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    fit_end = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fit_ratio)))
    calib_end = F.greatest(F.col("_f") + 1, F.floor(F.col("n") * F.lit(fit_ratio + calib_ratio)))
    total = total.withColumn("_f", fit_end).withColumn("_t", F.least(calib_end, F.col("n") - 1))
    at = lambda i: F.min(F.when(F.col("row_no") == i, F.col(ts)))
    return (
        attach(df.select(*keys, ts, "row_no"), total, keys)
        .where((F.col("row_no") == 0) | (F.col("row_no") == F.col("_f")) | (F.col("row_no") == F.col("_t")))
        .groupBy(*keys)
        .agg(
            F.lit("dynamic_ratio").alias("split_type"),
            F.min(ts).alias("fit_start"),
            at(F.col("_f")).alias("calib_start"),
            at(F.col("_t")).alias("test_start"),
            F.max("n").alias("n"),
        )
    )


def assign_period(df: DataFrame, spec: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    bounds = spec.select(*keys, F.col("calib_start").alias("_c"), F.col("test_start").alias("_t"))
    d = attach(df, bounds, keys)
    period = (
        F.when(F.col(ts) < F.col("_c"), "fit").when(F.col(ts) < F.col("_t"), "calib").otherwise("test")
    )
    return d.withColumn("period", period).drop("_c", "_t")


def period_ranges(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def split_violations(spec: DataFrame, periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keys with boundaries out of order or with an empty period."""
    present = periods.groupBy(*keys).agg(F.count_distinct("period").alias("_p"))
    d = attach(spec, present, keys)
    ordered = (F.col("fit_start") < F.col("calib_start")) & (F.col("calib_start") < F.col("test_start"))
    bad = ~F.coalesce(ordered, F.lit(False)) | (F.col("_p") < len(PERIODS))
    return d.where(bad).drop("_p").withColumn("rule_id", F.lit("split"))


def require_split(spec: DataFrame, df: DataFrame, keys: Sequence[str] = ()) -> None:
    bad = split_violations(spec, period_ranges(df, keys), keys).limit(5).collect()
    if bad:
        raise ContractError(f"split leaves an empty or unordered period: {bad}")
