"""Deterministic hourly series for demonstrations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.calendar import add_calendar
from tidewatch.session import prepare


def noise(position: Column, seed: int, stream: str, sd: float) -> Column:
    """Normal noise that depends on position and seed only, not on partitioning."""

    def uniform(part: str) -> Column:
        h = F.xxhash64(position, F.lit(seed), F.lit(stream), F.lit(part))
        return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)

    return F.lit(sd) * F.sqrt(F.lit(-2.0) * F.log(uniform("u"))) * F.cos(F.lit(2 * math.pi) * uniform("v"))


def synthetic_target(df: DataFrame, seed: int = 42, position: str = "position") -> DataFrame:
    """A target made from temperature, hour and weekend."""
    temp = F.coalesce(F.col("temp"), F.lit(18.0))
    wave = F.sin(F.lit(2 * math.pi) * F.col("hour") / 24.0)
    y = F.lit(3000.0) + 15 * (temp - 18) * (temp - 18) + 200 * wave - 400 * F.col("is_weekend")
    return df.withColumn("y", y + noise(F.col(position), seed, "target", 50.0))


def synthetic_series(spark: SparkSession, start: str = "2023-01-01", days: int = 500, seed: int = 42) -> DataFrame:
    """Year, day and weekend cycles with a quadratic effect of temperature."""
    at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(start))) + F.col("id") * 3600)
    d = prepare(spark).range(days * 24).select(F.col("id").alias("position"), at.alias("ts"))
    d = add_calendar(d)
    wave = lambda fn, col, shift, period: fn(F.lit(2 * math.pi) * (F.col(col) - shift) / period)
    n = lambda stream, sd: noise(F.col("position"), seed, stream, sd)
    d = d.withColumns(
        {
            "temp": 15
            + 10 * wave(F.sin, "dayofyear", 100, 365)
            + 3 * wave(F.sin, "hour", 9, 24)
            + n("temp", 2.0),
            "sun": F.greatest(10 * wave(F.sin, "hour", 6, 24) + n("sun", 2.0), F.lit(0.0)),
            "humid": 60 + 10 * wave(F.cos, "hour", 0, 24) + n("humid", 5.0),
        }
    )
    year = wave(F.cos, "dayofyear", 20, 365)
    y = (
        F.lit(3000.0)
        + 500 * year * year
        - 800 * wave(F.cos, "hour", 4, 24)
        + 10 * (F.col("temp") - 18) * (F.col("temp") - 18)
        - 400 * F.col("is_weekend")
    )
    return d.withColumn("y", y + n("y", 50.0)).drop("position")
