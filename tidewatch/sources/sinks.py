"""What a run leaves behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_certificate(certs: DataFrame, folder: str, run_id: str) -> None:
    """The latest certificate, replaced each time, and one kept per run."""
    doc = _json_lines(certs)
    doc.write.mode("overwrite").text(f"{folder}/certificates/run_id={run_id}")
    doc.write.mode("overwrite").text(f"{folder}/latest")


def append_ledger(rows: DataFrame, folder: str) -> None:
    dated = rows.withColumn("run_date", F.to_date(F.current_timestamp()))
    dated.write.mode("append").partitionBy("run_date").parquet(f"{folder}/ledger")


def append_ledger_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("header", True).csv(f"{folder}/ledger-csv")


def write_events(events: DataFrame, folder: str, keys: Sequence[str] = ()) -> None:
    """Six columns; an empty table keeps them."""
    cols = ["start", "end", "hours", "peak_score", "reason_major", "action"]
    rows = events.select(*keys, *cols).orderBy(*keys, F.desc("peak_score"), "start")
    rows.write.mode("overwrite").parquet(f"{folder}/events")


def write_evidence(evidence: DataFrame, folder: str, keys: Sequence[str] = ()) -> None:
    writer = evidence.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{folder}/evidence")


def write_summary(summary: DataFrame, folder: str) -> None:
    _json_lines(summary).write.mode("overwrite").text(f"{folder}/summary")


def reasons_evidence(reasons: DataFrame) -> DataFrame:
    """``issue_type, detail_json``."""
    return reasons.select(
        F.lit("anomaly").alias("issue_type"), F.to_json(F.struct(*sorted(reasons.columns))).alias("detail_json")
    )


def write_reasons(reasons: DataFrame, folder: str) -> None:
    reasons_evidence(reasons).write.mode("overwrite").parquet(f"{folder}/reasons")
