"""Several files of one series, read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.features import dedupe_first, rollup


def union_parts(parts: DataFrame, first: str, last: str, ingest_no: str = "ingest_no") -> DataFrame:
    """Overlapping parts: first row per timestamp, range filter, hourly mean."""
    once = dedupe_first(parts, "ts", (), ingest_no)
    kept = once.where(F.col("ts").between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last))))
    return rollup(kept, "ts", "y", "hour", "avg")
