"""Known faults against the integrity audit: what must be found, and was it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.operators import faults
from tidewatch.operators.integrity import IntegrityAudit

# The baseline parameters, and the rule each fault must raise.
CONFIG = {"threshold": 0.05, "baseline_model": "default", "calibration_window": 100}
EXPECTED = {
    "A1": ["local_spike_detected"],
    "A2": ["time_shift_detected"],
    "A3": ["missing_injection_detected"],
    "B1": ["threshold_changed"],
    "B2": ["near_threshold_perturbation"],
    "C1": ["baseline_series_changed"],
    "C2": ["config_sha_changed"],
    "F": ["data_contract_violation"],
}
MAIN_FAULTS = {
    "A1": faults.spike,
    "A2": faults.rotate,
    "A3": faults.blank,
    "B2": faults.rescale,
    "F": faults.break_header,
}
CONFIG_FAULTS = {"B1": {"threshold": 0.10}, "C2": {"calibration_window": 50}}


def scenario_matrix(main: DataFrame, target: DataFrame) -> DataFrame:
    """``attack_id, expected, observed, rules, pass_fail``."""
    audit = IntegrityAudit({"main": main, "target": target}, CONFIG)
    spark = main.sparkSession
    # the staged lines of the baseline: faults are put into copies, and what is not changed is measured once
    measured = audit.base
    main, target = measured["main"].lines, measured["target"].lines
    reasons, cert = audit.run(measured, CONFIG, "baseline")
    ledger = audit.ledger_entry(cert)
    clean = audit.digests({"main": main, "target": target})
    valid = audit.verify(cert, clean, reasons, CONFIG, ledger).first()["valid"]
    ok = not reasons.take(1) and valid
    rows = [("baseline", "OK", cert.first()["verdict"], "", "PASS" if ok else "FAIL")]
    for attack, rules in EXPECTED.items():
        current = dict(measured)
        if attack in MAIN_FAULTS:
            current["main"] = MAIN_FAULTS[attack](main)
        elif attack == "C1":
            current["target"] = faults.truncate(target)
        found, made = audit.run(current, {**CONFIG, **CONFIG_FAULTS.get(attack, {})}, attack)
        seen = sorted({r["rule_id"] for r in found.select("rule_id").collect()})
        observed = made.first()["verdict"]
        hit = observed == "NG" and audit.covers(found, rules).first()["covered"]
        rows.append((attack, "NG", observed, ",".join(seen), "PASS" if hit else "FAIL"))
    forged = faults_tamper(cert)
    caught = not audit.verify(forged, clean, reasons, CONFIG, ledger).first()["valid"]
    verdict = "tamper_detected" if caught else "missed"
    rows.append(("D2", "tamper_detected", verdict, "", "PASS" if caught else "FAIL"))
    return spark.createDataFrame(
        rows, "attack_id string, expected string, observed string, rules string, pass_fail string"
    )


def faults_tamper(cert: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return cert.withColumn("env_sha", F.lit("tampered_hash"))
