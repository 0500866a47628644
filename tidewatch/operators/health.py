"""Is the model still worth trusting, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import AuditConfig
from tidewatch.functions.labels import badge_col, next_action_col, one_liner_col
from tidewatch.operators.features import recent
from tidewatch.operators.flags import rising_edges
from tidewatch.operators.quantile import exact_quantiles
from tidewatch.operators.sequence import attach

TEST = "period = 'test'"


def rmse(y: str, pred: str, where: Column | None = None) -> Column:
    err = (F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred))
    return F.sqrt(F.avg(err if where is None else F.when(where, err)))


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1e-9))


def _recent_mark(df: DataFrame, days: float, keys: list[str]) -> DataFrame:
    """Test rows of the last ``days`` get ``_recent``; one scan serves both sides."""
    last = df.where(TEST).groupBy(*keys).agg(F.max(F.unix_seconds("ts")).alias("_b"))
    d = attach(df, last, keys)
    return d.withColumn(
        "_recent", F.expr(TEST) & (F.unix_seconds("ts") >= F.col("_b") - int(days * 86400))
    ).drop("_b")


def health_model(df: DataFrame, y: str, cfg: AuditConfig, pred: str = "pred", naive: str = "pred_naive", keys: Sequence[str] = ()) -> DataFrame:
    """The model against the naive prediction, on test rows."""
    t = df.where(TEST).groupBy(*keys).agg(
        rmse(y, pred).alias("model_rmse"), rmse(y, naive).alias("naive_rmse")
    )
    t = t.withColumn("model_vs_naive_ratio", _ratio("model_rmse", "naive_rmse"))
    return t.withColumn(
        "model_underperform", (F.col("model_vs_naive_ratio") > cfg.model_ratio_alert).cast("int")
    )


def health_drift(df: DataFrame, y: str, cfg: AuditConfig, pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """Error of the last days against the error on the calibration period."""
    d = _recent_mark(df, cfg.drift_days, list(keys))
    t = d.groupBy(*keys).agg(
        rmse(y, pred, F.col("period") == "calib").alias("rmse_calib"),
        rmse(y, pred, F.col("_recent")).alias("rmse_recent"),
    )
    t = t.withColumn("rmse_recent", F.coalesce("rmse_recent", "rmse_calib"))
    t = t.withColumn("drift_ratio", _ratio("rmse_recent", "rmse_calib"))
    return t.withColumn("drift_alert", (F.col("drift_ratio") > cfg.drift_ratio_alert).cast("int"))


def health_shift(df: DataFrame, cfg: AuditConfig, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """An upper quantile of the score, last days against calibration period."""
    keys = list(keys)
    d = _recent_mark(df, cfg.shift_days, keys)
    side = F.when(F.col("period") == "calib", "calib").when(F.col("_recent"), "recent")
    d = d.withColumn("_side", side).where(F.col("_side").isNotNull())
    q = exact_quantiles(d, [*keys, "_side"], score, [cfg.shift_q])
    pick = lambda s: F.max(F.when(F.col("_side") == s, F.col("quantiles")[0]))
    t = q.groupBy(*keys).agg(pick("calib").alias("q_calib"), pick("recent").alias("q_recent"))
    t = t.withColumn("q_calib", F.coalesce("q_calib", F.lit(1.0)))
    t = t.withColumn("q_recent", F.coalesce("q_recent", "q_calib"))
    t = t.withColumn("shift_ratio", _ratio("q_recent", "q_calib"))
    return t.withColumn("shift_alert", (F.col("shift_ratio") > cfg.shift_ratio_alert).cast("int"))


def flag_metrics(decided: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of flags over decided test rows (with ``outlier``)."""
    on = lambda c: F.col(c) == 1
    suppressed = on("flag_sci") & (F.col("flag_budget") == 0)
    d = decided.withColumn("suppressed", suppressed.cast("int"))
    d = rising_edges(d, ["flag_sci", "flag_budget", "suppressed", "outlier"], keys)
    rate = lambda c: F.avg(c.cast("double"))
    return d.groupBy(*keys).agg(
        F.count_distinct(F.when(on("tau_cap_hit"), F.to_date("ts"))).alias("cap_hit_days"),
        F.sum("tau_cap_hit").alias("cap_hit_hours"),
        rate(F.col("flag_sci")).alias("flag_rate"),
        F.sum("flag_sci_edge").alias("flag_events"),
        F.sum("flag_budget_edge").alias("flag_events_budget"),
        F.sum("suppressed").alias("suppressed_hours"),
        F.sum("suppressed_edge").alias("suppressed_events"),
        rate(F.col("outlier")).alias("outlier_rate"),
        F.sum("outlier_edge").alias("outlier_events"),
        rate(on("flag_sci") & on("outlier")).alias("overlap_both"),
        rate(on("flag_sci") & (F.col("outlier") == 0)).alias("flag_only"),
        rate((F.col("flag_sci") == 0) & on("outlier")).alias("outlier_only"),
    )


def verdict(metrics: DataFrame, cfg: AuditConfig) -> DataFrame:
    """First alert in order of weight names the reason; any alert means NG."""
    reason = (
        F.when(F.col("cap_hit_days") > 0, "TAU_CAP_HIT")
        .when(F.col("model_underperform") == 1, "BEACON_UNDERPERFORM")
        .when(F.col("drift_alert") == 1, "MODEL_DRIFT")
        .when(F.col("shift_alert") == 1, "SCORE_SHIFT")
        .otherwise("BASELINE_STABLE")
    )
    if cfg.profile == "demo":
        d = metrics.withColumns({"verdict": F.lit("DEMO"), "verdict_reason": F.lit("DEMO_MODE")})
    else:
        d = metrics.withColumn("verdict_reason", reason)
        ok = F.col("verdict_reason") == "BASELINE_STABLE"
        d = d.withColumn("verdict", F.when(ok, "OK").otherwise("NG"))
    return d.withColumns(
        {
            "one_liner": one_liner_col(F.col("verdict_reason")),
            "next_action": next_action_col(F.col("verdict_reason")),
            "badge": badge_col(F.col("verdict")),
        }
    )


__all__ = [
    "flag_metrics",
    "health_drift",
    "health_model",
    "health_shift",
    "recent",
    "rmse",
    "verdict",
]
