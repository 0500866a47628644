"""Compare datasets with a baseline, certify the outcome, verify it later.

A dataset is its lines, ``(line_no, line)``: a header and a comma-separated body.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import __version__
from tidewatch.functions.digest import changed_rows, table_digest
from tidewatch.operators.certificate import environment
from tidewatch.operators.diff import (
    blank_fields,
    column_diff,
    column_reasons,
    contract_diff,
    header_count,
    header_digest,
    profile,
    token_diff,
    token_reasons,
)
from tidewatch.operators.shift import circular_shift, xcorr_lag
from tidewatch.session import stage_table
from tidewatch.sources.lines import lines_table, promote_numbers
from tidewatch.sources.sinks import reasons_evidence

REASON = (
    "dataset string, code string, rule_id string, metric string, "
    "value double, threshold double, `column` string, detail string"
)
CERT = (
    "cert_id string, run_id string, data map<string,string>, config_sha string, code_sha string, "
    "env_sha string, evidence_sha string, verdict string, config string"
)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def config_text(cfg: dict) -> str:
    return json.dumps(cfg, sort_keys=True, separators=(",", ":"))


@dataclass
class Measured:
    """A dataset with what is known about it; one row of scalars on the driver."""

    lines: DataFrame
    sha: str
    header_count: int
    n_lines: int
    header_sha: str
    blanks: int
    columns: list[str] = field(default_factory=list)

    @property
    def body_rows(self) -> int:
        return self.n_lines - self.header_count

    def body(self) -> DataFrame:
        rows = self.lines.where(F.col("line_no") >= self.header_count)
        return rows.withColumn("row_no", F.col("line_no") - self.header_count)


def measure(lines: DataFrame, name: str) -> Measured:
    lines = stage_table(lines.select("line_no", "line"), f"lines-{name}")
    row = lines.agg(
        header_count().alias("head"),
        F.count(F.lit(1)).alias("n"),
        blank_fields().alias("blanks"),
    ).first()
    header = lines.where(F.col("line_no") < row["head"])
    header_sha = header_digest(lines, header=header).first()["header_sha"]
    sha = table_digest(lines).first()["table_sha"]
    last = header.where(F.col("line_no") == row["head"] - 1).select("line").first()
    names = [c.strip() for c in last["line"].split(",")] if last else []
    return Measured(lines, sha, row["head"], row["n"], header_sha, row["blanks"], names)


class IntegrityAudit:
    def __init__(self, baseline: dict[str, DataFrame], cfg: dict):
        self.cfg = dict(cfg)
        self.base = {n: measure(lines, n) for n, lines in baseline.items()}
        self.tables: dict[str, DataFrame] = {}
        self.profiles: dict[str, DataFrame] = {}
        self.numeric: dict[str, list[str]] = {}
        self.spark: SparkSession = next(iter(self.base.values())).lines.sparkSession

    def _baseline_table(self, name: str) -> DataFrame:
        if name not in self.tables:
            m = self.base[name]
            t = promote_numbers(lines_table(m.lines, m.columns, m.header_count).drop("row_no"))
            self.numeric[name] = [f.name for f in t.schema.fields if f.dataType.typeName() == "double"]
            self.tables[name] = lines_table(m.lines, m.columns, m.header_count, self.numeric[name])
            self.profiles[name] = stage_table(profile(self.tables[name].drop("row_no")), "profile")
        return self.tables[name]

    def run(
        self, current: dict[str, DataFrame | Measured], cfg: dict, run_id: str
    ) -> tuple[DataFrame, DataFrame]:
        """``(reasons, certificate)``.  Only datasets whose digest changed are compared."""
        now = {
            n: current[n] if isinstance(current[n], Measured) else measure(current[n], n) for n in self.base
        }
        found: list[tuple] = []
        add = lambda ds, code, rule, metric=None, value=None, thr=None, col=None, detail=None: found.append(
            (ds, code, rule, metric, None if value is None else float(value), thr, col, detail)
        )
        for n in self.base:
            if now[n].sha != self.base[n].sha:
                add(n, "LAYER_A", f"{n}_sha_changed")
        if config_text(cfg) != config_text(self.cfg):
            add(None, "LAYER_A", "config_sha_changed")
            if cfg.get("threshold") != self.cfg.get("threshold"):
                add(None, "LAYER_A", "threshold_changed")
        threshold = float(cfg.get("threshold", 0.05))
        for n, m in now.items():
            if m.sha != self.base[n].sha:
                self._compare(n, m, threshold, add)
        reasons = self.spark.createDataFrame(found, REASON)
        return reasons, self._certificate(now, cfg, reasons, "NG" if found else "OK", run_id)

    def _compare(self, n: str, m: Measured, threshold: float, add) -> None:
        b = self.base[n]
        broken = m.header_sha != b.header_sha
        if broken:
            add(n, "LAYER_B", "data_contract_violation", detail="header signature")
        base_body, body = b.body(), m.body()
        if m.blanks > b.blanks:
            add(n, "LAYER_B", "missing_injection_detected", "blank_fields_added", m.blanks - b.blanks)
        moved = circular_shift(base_body, body).first()
        if moved:
            add(n, "LAYER_B", "time_shift_detected", "shift", moved["shift"])
        else:
            for r in token_reasons(token_diff(base_body, body, ["row_no"]), threshold).collect():
                add(n, "LAYER_B", r["rule_id"], r["metric"], r["value"], threshold)
        base_table = self._baseline_table(n)
        # baseline names stand in only where the header line has none to use
        usable = bool(m.columns) and all(m.columns) and len(set(m.columns)) == len(m.columns)
        named = m.columns if usable else b.columns
        table = lines_table(m.lines, named, m.header_count, [c for c in self.numeric[n] if c in named])
        cur_profile = profile(table.drop("row_no"))
        violations = contract_diff(cur_profile, self.profiles[n]).collect()
        for v in violations:
            add(n, "LAYER_B", "data_contract_violation", v["rule"], v["value"], None, v["column"])
        if 0 < m.body_rows < b.body_rows:
            add(n, "LAYER_B", "baseline_series_changed", "rows", m.body_rows, float(b.body_rows))
        if violations or m.body_rows != b.body_rows:
            return
        diff = column_diff(base_table, table, ["row_no"], b.columns)
        for r in column_reasons(diff, threshold).collect():
            add(n, "LAYER_B", r["rule_id"], r["metric"], r["value"], threshold, r["column"])
        if self.numeric[n]:
            col = self.numeric[n][0]
            lag = xcorr_lag(base_table.select("row_no", col), table.select("row_no", col), col).first()
            if lag and lag["shift"] != 0:
                add(n, "LAYER_B", "time_shift_detected", "lag", lag["shift"], None, col)

    def _material(self, data: dict[str, str], cfg: str, evidence: str, verdict: str) -> dict[str, str]:
        return {
            "data": data,
            "config_sha": _sha(cfg),
            "code_sha": _sha(__version__),
            "env_sha": _sha(json.dumps(environment(), sort_keys=True)),
            "evidence_sha": evidence,
            "verdict": verdict,
            "config": cfg,
        }

    def _certificate(self, now: dict[str, Measured], cfg: dict, reasons: DataFrame, verdict: str, run_id: str) -> DataFrame:
        m = self._material(
            {n: x.sha for n, x in now.items()}, config_text(cfg), evidence_sha(reasons), verdict
        )
        row = (_sha(json.dumps(m, sort_keys=True)), run_id, m["data"], m["config_sha"], m["code_sha"])
        row += (m["env_sha"], m["evidence_sha"], verdict, m["config"])
        return self.spark.createDataFrame([row], CERT)

    def digests(self, current: dict[str, DataFrame]) -> dict[str, str]:
        """Digests of the datasets as they are now."""
        return {n: table_digest(current[n].select("line_no", "line")).first()["table_sha"] for n in self.base}

    def verify(
        self, cert: DataFrame, current: dict[str, DataFrame | str], reasons: DataFrame, cfg: dict, ledger: DataFrame
    ) -> DataFrame:
        """Recompute every digest and find the certificate in the ledger.

        Several certificates of the same datasets may share the result of ``digests``.
        """
        c = cert.first()
        data = {n: x for n, x in current.items() if isinstance(x, str)}
        data |= self.digests(current) if not data else {}
        m = self._material(data, config_text(cfg), evidence_sha(reasons), c["verdict"])
        listed = not (
            ledger.where((F.col("cert_id") == c["cert_id"]) & (F.col("evidence_sha") == m["evidence_sha"])).isEmpty()
        )
        checks = {
            "data_ok": c["data"] == data,
            "config_ok": c["config_sha"] == m["config_sha"] and c["config"] == m["config"],
            "code_ok": c["code_sha"] == m["code_sha"],
            "env_ok": c["env_sha"] == m["env_sha"],
            "evidence_ok": c["evidence_sha"] == m["evidence_sha"],
            "id_ok": c["cert_id"] == _sha(json.dumps(m, sort_keys=True)),
            "ledger_ok": listed,
        }
        checks["valid"] = all(checks.values())
        schema = ", ".join(f"{k} boolean" for k in checks)
        return self.spark.createDataFrame([tuple(checks.values())], schema)

    def changed_lines(self, name: str, current: DataFrame) -> DataFrame:
        """``line_no, line, side, times``: where a text that no longer verifies differs from its baseline."""
        return changed_rows(self.base[name].lines, current.select("line_no", "line"))

    @staticmethod
    def ledger_entry(cert: DataFrame) -> DataFrame:
        return cert.select(
            "run_id",
            F.current_timestamp().alias("timestamp"),
            "cert_id",
            F.col("data").alias("data_sha"),
            "evidence_sha",
            "verdict",
        )

    @staticmethod
    def covers(reasons: DataFrame, expected: Sequence[str]) -> DataFrame:
        """``covered``: every expected rule was detected."""
        seen = F.coalesce(F.collect_set("rule_id"), F.array())
        want = F.array(*[F.lit(r) for r in expected]) if expected else F.array().cast("array<string>")
        return reasons.agg((F.size(F.array_except(want, seen)) == 0).alias("covered"))


def evidence_sha(reasons: DataFrame) -> str:
    return table_digest(reasons_evidence(reasons)).first()["table_sha"]
