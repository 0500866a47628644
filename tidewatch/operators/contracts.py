"""Data-quality rules.  Each gives violation rows; the caller decides what they mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import AuditConfig, ContractError
from tidewatch.operators.sequence import BLOCK_ROWS, attach, block_window, blocked, index_rows


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    rows = [("required_columns", c) for c in missing_columns(df, required)]
    return df.sparkSession.createDataFrame(rows, "rule_id string, column string")


def off_grid(ts: str | Column = "ts", every: str = "hour") -> Column:
    """True where the timestamp is null or not on the step of the grid."""
    c = F.col(ts) if isinstance(ts, str) else ts
    bad = (F.minute(c) != 0) | (F.floor(F.second(c)) != 0)
    if every == "day":
        bad = bad | (F.hour(c) != 0)
    return c.isNull() | bad


def check_grid(df: DataFrame, ts: str = "ts", every: str = "hour", keys: Sequence[str] = ()) -> DataFrame:
    t = df.groupBy(*keys).agg(F.count_if(off_grid(ts, every)).alias("value"))
    return t.where("value > 0").withColumn("rule_id", F.lit("grid"))


def check_non_negative(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    t = df.groupBy(*keys).agg(F.count_if(F.col(y) < 0).alias("value"))
    return t.where("value > 0").withColumn("rule_id", F.lit("non_negative"))


def is_monotonic(
    df: DataFrame, ingest_no: str, ts: str, keys: Sequence[str] = (), rows: int = BLOCK_ROWS
) -> DataFrame:
    """``keys, monotonic``: timestamps never go back in the order rows were read."""
    d = index_rows(df.select(*keys, ingest_no, ts), keys, ingest_no)
    d = blocked(d, rows, 1)
    back = F.lag(ts).over(block_window(keys)) > F.col(ts)
    d = d.withColumn("_back", F.coalesce(back, F.lit(False))).where(~F.col("_halo"))
    return d.groupBy(*keys).agg((F.count_if("_back") == 0).alias("monotonic"))


def continuity(
    df: DataFrame, ts: str = "ts", step_seconds: int = 3600, keys: Sequence[str] = (), rows: int = BLOCK_ROWS
) -> DataFrame:
    """``keys, n, duplicates, continuity``: share of neighbours exactly one step apart.

    Copies of a timestamp are counted before anything is ordered; each copy is one
    more neighbour with distance 0.
    """
    counted = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_c"))
    d = index_rows(counted, keys, ts, span=step_seconds * rows * 1_000_000)
    d = blocked(d, rows, 1)
    gap = F.unix_seconds(ts) - F.unix_seconds(F.lag(ts).over(block_window(keys)))
    d = d.withColumn("_ok", (gap == step_seconds).cast("int")).where(~F.col("_halo"))
    return d.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        (F.sum("_c") - F.count(F.lit(1))).alias("duplicates"),
        F.try_divide(F.coalesce(F.sum("_ok"), F.lit(0)).cast("double"), (F.sum("_c") - 1).cast("double")).alias(
            "continuity"
        ),
    )


def series_report(
    df: DataFrame,
    cfg: AuditConfig,
    required: Sequence[str] = ("y",),
    keys: Sequence[str] = (),
    step_seconds: int = 3600,
    ingest_no: str | None = None,
) -> DataFrame:
    """One row per key with every measure of the series contract and ``status``.

    ``monotonic`` is null, and no part of the status, unless ``ingest_no`` names the order of reading.
    """
    keys = list(keys)
    rates = [F.avg(F.col(c).isNull().cast("double")) for c in required]
    every = "day" if step_seconds == 86400 else "hour"
    basic = df.groupBy(*keys).agg(
        (F.greatest(*rates) if len(rates) > 1 else rates[0]).alias("worst_null_rate"),
        F.count_if(off_grid("ts", every)).alias("off_grid_rows"),
    )
    out = attach(continuity(df, "ts", step_seconds, keys), basic, keys)
    if ingest_no:
        out = attach(out, is_monotonic(df, ingest_no, "ts", keys), keys)
    else:
        out = out.withColumn("monotonic", F.lit(None).cast("boolean"))
    ok = (
        (F.col("duplicates") == 0)
        & F.coalesce("monotonic", F.lit(True))
        & (F.col("off_grid_rows") == 0)
        & ((F.col("n") <= 2) | (F.col("continuity") >= cfg.min_continuity))
    )
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def series_violations(report: DataFrame, cfg: AuditConfig, keys: Sequence[str] = ()) -> DataFrame:
    """The report as one row per broken rule."""
    rule = lambda name, bad, value: F.when(
        bad, F.struct(F.lit(name).alias("rule_id"), value.cast("double").alias("value"))
    )
    rules = F.array_compact(
        F.array(
            rule("duplicates", F.col("duplicates") > 0, F.col("duplicates")),
            rule("monotonic", ~F.col("monotonic"), F.lit(0)),
            rule("grid", F.col("off_grid_rows") > 0, F.col("off_grid_rows")),
            rule(
                "continuity",
                (F.col("n") > 2) & (F.col("continuity") < cfg.min_continuity),
                F.col("continuity"),
            ),
        )
    )
    return report.select(*keys, F.explode(rules).alias("_r")).select(*keys, "_r.*")


def enforce(violations: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Report under 'demo', refuse otherwise."""
    if cfg.profile != "demo":
        bad = violations.limit(10).collect()
        if bad:
            raise ContractError(f"data contract violated: {bad}")
    return violations
