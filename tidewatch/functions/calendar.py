"""Calendar columns of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_columns(ts: str) -> dict[str, Column]:
    day = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "dayofyear": F.dayofyear(ts),
        "weekday": day,
        "is_weekend": (day >= 5).cast("int"),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "band": F.floor(F.hour(ts) / 6).cast("int"),
    }


def add_calendar(
    df: DataFrame, ts: str = "ts", only: tuple[str, ...] = ("hour", "dayofyear", "weekday", "is_weekend")
) -> DataFrame:
    """Monday is weekday 0.  Columns that are already there are kept."""
    cols = calendar_columns(ts)
    return df.withColumns({c: cols[c] for c in only if c not in df.columns})


def add_cyclic(df: DataFrame, covariate: str | None = "temp") -> DataFrame:
    """Position in the year on a circle, and the square of a covariate."""
    angle = F.lit(2 * math.pi) * F.col("dayofyear") / F.lit(366.0)
    new = {"sin_doy": F.sin(angle), "cos_doy": F.cos(angle)}
    if covariate:
        new[f"{covariate}2"] = F.col(covariate) * F.col(covariate)
    return df.withColumns(new)
