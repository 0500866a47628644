"""What a run was made from shows in its certificates."""

from pyspark.sql import functions as F

from tidewatch.config import AuditConfig
from tidewatch.operators.features import prepared
from tidewatch.plans.audit import run_audit
from tidewatch.sources.files import file_digests
from tidewatch.sources.synthetic import synthetic_series


def test_files_report_features_and_target_are_bound(spark, tmp_path):
    (tmp_path / "target.csv").write_text("ts,y\n")
    files = file_digests(spark, str(tmp_path)).withColumn("role", F.lit("target"))
    report = spark.createDataFrame([("a", 10, 0.99)], "k string, merged_rows int, overlap_ratio double")
    s = synthetic_series(spark, days=60).select(F.lit("a").alias("k"), "ts", "y", "sun")
    full = prepared(s, "y", (1, 24), ["k"], complete=True)
    cfg = AuditConfig(profile="paper", calib_start="2023-02-05", test_start="2023-02-17")

    def run(series=full, **given):
        given = {"files": files, "report": report, "features": ["sun", "lag_1"], "target": "load"} | given
        res = run_audit(series, cfg, ["k"], **given)
        return res, res.certificates.first(), res.ledger.first()

    res, cert, ledger = run()
    assert cert["scope"]["target_label"] == "load" and '"features":["sun","lag_1"]' in cert["config"]["canonical"]
    made = res.provenance.first()
    assert made["files"][0]["bytes"] == 5 and made["merge_report"]
    assert cert["provenance_sha256"] == ledger["source_sha256"] == made["provenance_sha256"] != ""
    # a covariate that no decision depends on
    sun = F.when(F.col("row_no") == F.lit(1200), F.col("sun") + 1).otherwise(F.col("sun"))
    moved = run(series=full.withColumn("sun", sun), report=report.withColumn("merged_rows", F.lit(11)))
    assert moved[1]["fingerprints"]["data_sha256"] != cert["fingerprints"]["data_sha256"]
    assert moved[1]["certificate_id"] != cert["certificate_id"]
    assert moved[2]["source_sha256"] != ledger["source_sha256"]
