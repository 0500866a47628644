"""Certificates, ledger rows and summaries as columns of one row per run and key."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import __version__
from tidewatch.config import AuditConfig
from tidewatch.functions.digest import json_digest, short_id, table_digest
from tidewatch.functions.labels import POLICY
from tidewatch.operators.sequence import attach

# Assumptions every certificate states.
PREMISE = ["Seasonality", "WeatherLink", "Inertia"]
EVIDENCE = (
    "ts",
    "y",
    "pred",
    "pred_naive",
    "res",
    "score",
    "reason",
    "tau_sci",
    "tau_budget",
    "tau_cap_hit",
    "flag_sci",
    "flag_budget",
    "outlier",
)


def evidence(decided: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return decided.select(*keys, *[c for c in EVIDENCE if c in decided.columns])


def _sha(text: str) -> Column:
    return F.sha2(F.lit(text), 256)


def environment() -> dict[str, str]:
    return {"engine": __version__, "spark": pyspark.__version__}


def run_settings(cfg: AuditConfig, y: str = "y", features: Sequence[str] = ()) -> str:
    """What a run was told, as the text that is digested: the parameters, the target and the features."""
    return json.dumps({"config": json.loads(cfg.canonical()), "features": list(features), "target": y}, sort_keys=True, separators=(",", ":"))


def digests(
    decided: DataFrame,
    spec: DataFrame,
    cfg: AuditConfig,
    keys: Sequence[str] = (),
    y: str = "y",
    features: Sequence[str] = (),
) -> DataFrame:
    """``data, split, config, code, env`` digests per key.

    The data are the evidence columns and the ``features`` a prediction was made from, so a covariate that
    was changed shows even where no decision did.
    """
    keys = list(keys)
    shown = evidence(decided, keys).columns
    bound = decided.select(*shown, *[c for c in dict.fromkeys((y, *features)) if c not in shown])
    data = table_digest(bound, keys=keys, out="data_sha256").select(*keys, "data_sha256")
    bounds = ["split_type", "fit_start", "calib_start", "test_start"]
    split = spec.select(*keys, json_digest(bounds).alias("split_sha256"))
    return attach(data, split, keys).withColumns(
        {
            "config_sha256": _sha(run_settings(cfg, y, features)),
            "code_sha256": _sha(__version__),
            "env_sha256": _sha(json.dumps(environment(), sort_keys=True)),
        }
    )


def provenance(files: DataFrame, report: DataFrame | None, cfg: AuditConfig, keys: Sequence[str] = ()) -> DataFrame:
    """One row: input files (``role, path, sha256, bytes``), merge report, rules, digest.

    With ``keys`` the report has a row per series and enters by its digest.
    """
    listed = files.agg(
        F.array_sort(F.collect_list(F.struct("role", "path", "sha256", "bytes"))).alias("files")
    )
    rules = F.struct(
        F.lit(cfg.merge_how).alias("merge_how"),
        F.lit(cfg.min_overlap).alias("min_overlap"),
        F.lit(cfg.profile != "demo").alias("no_imputation"),
    ).alias("rules")
    d = listed.withColumn("rules", rules)
    if report is not None and keys:
        d = attach(d, table_digest(report, out="merge_report").select("merge_report"), [])
    elif report is not None:
        d = attach(d, report.select(F.to_json(F.struct(*report.columns)).alias("merge_report")), [])
    return d.withColumn("provenance_sha256", json_digest(d.columns))


def dataset_label(cfg: AuditConfig, names: Sequence[str]) -> str:
    """Where the rows come from, and what that means for the verdict."""
    origin = "generated rows" if cfg.synthetic else f"files: {', '.join(names) or 'none named'}"
    notes = {"demo": "for show, no verdict", "paper": "split by fixed dates"}
    return f"{origin} ({notes[cfg.profile]})" if cfg.profile in notes else origin


def day_range(first: Column, last: Column) -> Column:
    return F.concat_ws("..", F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd"))


def certificate(
    metrics: DataFrame,
    top: DataFrame,
    ranges: DataFrame,
    shas: DataFrame,
    cfg: AuditConfig,
    label: str,
    keys: Sequence[str] = (),
    provenance_sha: str = "",
    prefix: str = "TW-",
    target: str = "y",
    settings: str | None = None,
) -> DataFrame:
    """One certificate per key.

    The id binds data, config, split, code and evidence digests; ``content_sha256``
    covers everything but the time of issue, ``certificate_sha256`` everything.
    """
    keys = list(keys)
    period = lambda p: F.max(F.when(F.col("period") == p, day_range(F.col("first_ts"), F.col("last_ts"))))
    spans = ranges.groupBy(*keys).agg(period("calib").alias("calib_range"), period("test").alias("test_range"))
    m = [c for c in metrics.columns if c not in keys]
    texts = ["verdict", "verdict_reason", "one_liner", "next_action", "badge"]
    # nine places: sums of squares differ in their last bits with the partitioning
    kind = {f.name: f.dataType.typeName() for f in metrics.schema.fields}
    shown = [F.round(c, 9).alias(c) if kind[c] == "double" else F.col(c) for c in m if c not in texts]
    d = metrics.select(*keys, F.struct(*shown).alias("metrics"), *texts)
    d = attach(attach(d, spans, keys), shas, keys)
    best = top.select(*keys, F.struct("reason_major", "action", "peak_score").alias("top_reason"))
    if keys:
        d = d.join(best, keys, "left")
    else:
        d = d.withColumn("top_reason", best.select("top_reason").scalar())
    policy = POLICY["paper" if cfg.profile == "paper" else "rolling"]
    names = ["data_sha256", "config_sha256", "split_sha256", "code_sha256", "env_sha256"]
    head = lambda c: F.concat(F.substring(c, 1, 8), F.lit("..."))
    scope = F.array(
        F.lit(f"profile {cfg.profile}"),
        F.lit(f"data from {label}"),
        F.concat(F.lit("calibrated on "), "calib_range"),
        F.concat(F.lit("tested on "), "test_range"),
        F.lit(policy),
        F.concat(F.lit("digests begin with "), head("data_sha256"), F.lit(" for the data and "), head("config_sha256"), F.lit(" for the settings")),
    )
    d = d.select(
        *keys,
        short_id(prefix, [F.col(c) for c in names[:4]]).alias("certificate_id"),
        "badge",
        F.struct(*texts[:4], scope.alias("scope_of_certificate")).alias("human_summary"),
        "metrics",
        "top_reason",
        F.struct(
            F.lit(label).alias("dataset_label"),
            F.lit(target).alias("target_label"),
            F.struct(F.col("calib_range").alias("calib"), F.col("test_range").alias("test")).alias("time_range"),
            F.array(*[F.lit(p) for p in PREMISE]).alias("premise"),
        ).alias("scope"),
        F.struct(*[F.lit(v).alias(k) for k, v in environment().items()]).alias("environment"),
        F.struct(*names).alias("fingerprints"),
        F.struct(F.lit(cfg.profile).alias("profile"), F.lit(settings or cfg.canonical()).alias("canonical")).alias("config"),
        F.lit(policy).alias("tau_policy"),
        F.lit(provenance_sha).alias("provenance_sha256"),
    )
    d = d.withColumn("content_sha256", json_digest(d.columns))
    d = d.withColumn("issued_at_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return d.withColumn("certificate_sha256", json_digest(d.columns))


def ledger_rows(certs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The certificate on one line, closed by a digest of the line itself."""
    action = F.col("human_summary.next_action")
    short = F.when(F.length(action) > 50, F.concat(F.substring(action, 1, 50), F.lit("..."))).otherwise(action)
    d = certs.select(
        *keys,
        "certificate_id",
        "issued_at_utc",
        "human_summary.verdict",
        "human_summary.verdict_reason",
        F.col("config.profile").alias("profile"),
        F.col("scope.dataset_label").alias("dataset_label"),
        F.col("scope.time_range.test").alias("test_range"),
        short.alias("next_action_short"),
        "metrics.cap_hit_days",
        "metrics.suppressed_hours",
        "metrics.flag_rate",
        F.coalesce("top_reason.reason_major", F.lit("")).alias("reason_major"),
        "fingerprints.data_sha256",
        "fingerprints.config_sha256",
        "fingerprints.split_sha256",
        "fingerprints.code_sha256",
        "fingerprints.env_sha256",
        F.col("provenance_sha256").alias("source_sha256"),
        "certificate_sha256",
    )
    return d.withColumn("ledger_row_sha256", json_digest(d.columns))


def summary(certs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return certs.select(
        *keys,
        "badge",
        "human_summary.verdict",
        "human_summary.verdict_reason",
        "human_summary.one_liner",
        "human_summary.next_action",
        "metrics.cap_hit_days",
        "metrics.flag_events",
        "metrics.suppressed_hours",
        "metrics.flag_rate",
        F.coalesce("top_reason.reason_major", F.lit("")).alias("reason_major"),
        "certificate_id",
        "certificate_sha256",
    )


def verify_certificate(certs: DataFrame) -> DataFrame:
    """Recompute the digests a certificate carries about itself."""
    body = [c for c in certs.columns if c not in ("content_sha256", "issued_at_utc", "certificate_sha256")]
    whole = [c for c in certs.columns if c != "certificate_sha256"]
    return certs.select(
        "certificate_id",
        (json_digest(body) == F.col("content_sha256")).alias("content_ok"),
        (json_digest(whole) == F.col("certificate_sha256")).alias("certificate_ok"),
    )
