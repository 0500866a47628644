"""The whole series audit, from a prepared series to certificate and ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import AuditConfig
from tidewatch.functions.calendar import add_calendar
from tidewatch.operators.calibrate import tau_policies
from tidewatch.operators.certificate import (
    certificate,
    dataset_label,
    digests,
    evidence,
    ledger_rows,
    provenance,
    run_settings,
    summary,
)
from tidewatch.operators.decide import decide_frozen, decide_rolling, zscore_flags
from tidewatch.operators.flags import events, top_event
from tidewatch.operators.health import flag_metrics, health_drift, health_model, health_shift, verdict
from tidewatch.operators.predict import seasonal_naive
from tidewatch.operators.score import audit_rows, score
from tidewatch.operators.sequence import attach
from tidewatch.operators.split import assign_period, period_ranges, require_split, split_spec, split_violations
from tidewatch.session import stage_table
from tidewatch.sources.sinks import (
    append_ledger,
    write_certificate,
    write_events,
    write_evidence,
    write_summary,
)


@dataclass
class AuditResult:
    decided: DataFrame
    events: DataFrame
    metrics: DataFrame
    certificates: DataFrame
    ledger: DataFrame
    summary: DataFrame
    evidence: DataFrame
    refused: DataFrame
    provenance: DataFrame | None = None

    def write(self, folder: str, run_id: str, keys: Sequence[str] = ()) -> None:
        write_certificate(self.certificates, folder, run_id)
        append_ledger(self.ledger, folder)
        write_events(self.events, folder, keys)
        write_evidence(self.evidence, folder, keys)
        write_summary(self.summary, folder)


def metrics_of(scored: DataFrame, decided: DataFrame, y: str, cfg: AuditConfig, pred: str, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    m = flag_metrics(decided, keys)
    for part in (
        health_model(scored, y, cfg, pred, "pred_naive", keys),
        health_drift(scored, y, cfg, pred, keys),
        health_shift(scored, cfg, "score", keys),
    ):
        m = attach(m, part, keys)
    return m


def run_audit(
    series: DataFrame,
    cfg: AuditConfig,
    keys: Sequence[str] = (),
    y: str = "y",
    pred: str | None = None,
    label: str | None = None,
    names: Sequence[str] = (),
    files: DataFrame | None = None,
    report: DataFrame | None = None,
    features: Sequence[str] = (),
    target: str | None = None,
) -> AuditResult:
    """``series``: ``keys, ts, row_no, y`` and, when the caller has one, a prediction.

    ``names`` are the files or tables the rows come from; without a ``label`` they make one.  ``files``
    (``role, path, sha256, bytes``; see ``file_digests``) and the ``report`` of ``merge_target`` are the provenance:
    its digest enters every certificate and ledger row.  ``features`` are columns of ``series`` that the data
    digest covers besides the evidence; they and the target's name enter the digest of the settings.
    """
    cfg.check_profile()
    keys = list(keys)
    dates = (cfg.calib_start, cfg.test_start) if cfg.profile == "paper" else None
    spec = stage_table(split_spec(series, keys, "ts", (cfg.fit_ratio, cfg.calib_ratio), dates), "split")
    split = assign_period(series, spec, keys)
    refused = stage_table(split_violations(spec, period_ranges(split, keys), keys), "refused")
    if not keys:
        require_split(spec, split, keys)
    else:
        # a series that cannot be split is reported; the others go on
        split = split.join(refused.select(*keys), [split[c].eqNullSafe(refused[c]) for c in keys], "left_anti")
        spec = spec.join(refused.select(*keys), [spec[c].eqNullSafe(refused[c]) for c in keys], "left_anti")
    cols = tuple(dict.fromkeys((*cfg.season, cfg.fallback)))
    audit = seasonal_naive(add_calendar(audit_rows(split, keys), "ts", cols), y, cfg.season, keys)
    audit = stage_table(audit, "audit")
    pred = pred or "pred_naive"
    scored = stage_table(
        score(audit, y, cfg.season, cfg.fallback, pred, cfg.threshold_q, cfg.min_n, keys), "scored"
    )
    calib = scored.where("period = 'calib'")
    taus = stage_table(tau_policies(calib, "score", cfg, keys), "taus")
    outliers = zscore_flags(scored, y, cfg, keys, taus=taus)
    decide = decide_frozen if cfg.profile == "paper" else decide_rolling
    decided = decide(stage_table(outliers.drop("mu", "sd"), "outliers"), taus, cfg, keys)
    decided = stage_table(decided, "decided")
    found = stage_table(events(decided, "flag_sci", cfg.cooldown_hours, keys), "events")
    metrics = verdict(metrics_of(scored, decided, y, cfg, pred, keys), cfg)
    # what the decision was made with belongs into the certificate
    learned = taus.select(*keys, F.col("tau_fixed").alias("baseline_tau"), "w_rows", "k_hits")
    bounds = spec.select(*keys, *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("calib_start", "test_start")])
    metrics = stage_table(attach(attach(metrics, learned, keys), bounds, keys), "metrics")
    label = label or dataset_label(cfg, names)
    shas = digests(decided, spec, cfg, keys, y, features)
    origin = None if files is None else stage_table(provenance(files, report, cfg, keys), "provenance")
    origin_sha = "" if origin is None else origin.first()["provenance_sha256"]
    certs = certificate(
        metrics, top_event(found, keys), period_ranges(scored, keys), shas, cfg, label, keys, origin_sha,
        target=target or y, settings=run_settings(cfg, y, features),
    )
    certs = stage_table(certs, "certificates")
    return AuditResult(
        decided, found, metrics, certs, ledger_rows(certs, keys), summary(certs, keys), evidence(decided, keys), refused, origin
    )
