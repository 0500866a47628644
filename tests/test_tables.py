import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.config import AuditConfig, ContractError
from tidewatch.functions.digest import table_digest
from tidewatch.sources.files import file_digests
from tidewatch.functions.labels import PLAYBOOK, action_col
from tidewatch.functions.text import blank_pairs, float_token
from tidewatch.operators import diff, faults
from tidewatch.operators.certificate import ledger_rows, verify_certificate
from tidewatch.operators.features import fill_missing_covariates, prepared
from tidewatch.operators.integrity import IntegrityAudit
from tidewatch.operators.split import require_split, split_spec, assign_period
from tidewatch.plans.audit import run_audit
from tidewatch.plans.scenarios import scenario_matrix
from tidewatch.sources import lines as src
from tidewatch.sources import sinks
from tidewatch.sources.synthetic import synthetic_series, synthetic_target


def text_lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_no long, line string")


def sample(n=120, seed=1):
    rng = np.random.default_rng(seed)
    head = ["day,temp,load", "unit,C,MW"]
    return head + [f"d{i:04d}x,{20 + rng.normal():.2f},{1000 + 50 * rng.normal():.1f}" for i in range(n)]


# ---- sources ------------------------------------------------------------------


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rows = [f"row {i} " + "x" * random.Random(i).randint(0, 40) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(rows))
    (tmp_path / "b.txt").write_text("one\r\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = src.read_lines(spark, str(tmp_path)).toPandas().sort_values(["path", "line_no"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a, b = (part for _, part in got.groupby("path"))
    assert a["line"].tolist() == rows and a["line_no"].tolist() == list(range(5000))
    assert b["line"].tolist() == ["one", "two"]


def test_file_digest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x00\x01" * 999)
    row = file_digests(spark, str(tmp_path / "x.bin")).first()
    assert row["bytes"] == 1998 and row["sha256"] == hashlib.sha256(b"\x00\x01" * 999).hexdigest()


@pytest.mark.parametrize("charset", ["cp932", "shift_jis", "utf-8"])
def test_aliased_csv_with_preamble(spark, tmp_path, charset):
    text = "ダウンロード\n\n地点,東京\n年月日時,気温(℃),気温(℃),相対湿度(％),日照時間(時間)\n"
    text += "2024/1/1 1:00,3.5,8,50,0.1\n2024/1/1 2:00,×,8,51,\nbad,1.0,8,52,0.3\n"
    (tmp_path / "w.csv").write_bytes(text.encode(charset))
    got = src.read_aliased_csv(spark, str(tmp_path / "w.csv"), charset=charset).orderBy("line_no").toPandas()
    assert list(got.columns) == ["ts", "temp", "humid", "sun", "line_no"]
    assert got["ts"][0] == pd.Timestamp("2024-01-01 01:00") and pd.isna(got["ts"][2])
    assert got["temp"][0] == 3.5 and pd.isna(got["temp"][1]) and got["humid"].tolist() == [50, 51, 52]
    with pytest.raises(ContractError):
        src.read_aliased_csv(spark, str(tmp_path / "w.csv"), marker="nothing", charset=charset)


def test_target_csv(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("﻿日付,時刻,当日実績(万kW)\n2024/1/1,1:00,10\n2024/1/1,1:00,11\n2024/1/1,0:00,9\n2024/1/1,2:00,\n", "utf-8")
    got = src.read_target_csv(spark, str(p)).orderBy("ts").toPandas()
    assert got["y"].tolist() == [9.0, 10.0]
    for bad in ("DATETIME,DEMAND\n2024-01-01 00:30:00,1\n", "DATETIME,DEMAND\n2024-01-01 00:00:00,-1\n", "A,B\n1,2\n"):
        p.write_text(bad)
        with pytest.raises(ContractError):
            src.read_target_csv(spark, str(p))


def test_loose_csv(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("a,b,c\n1,x,--\n2,NA,3\nN/A,null,4\n7,8,9,10\n")
    got = src.read_loose_csv(spark, str(p))
    assert dict(got.dtypes) == {"a": "double", "b": "string", "c": "double"}
    rows = sorted(tuple(r) for r in got.na.fill(-1).na.fill("none").collect())
    assert rows == [(-1.0, "null", 4.0), (1.0, "x", -1.0), (2.0, "none", 3.0)]


def test_csv_and_synthetic(spark, tmp_path):
    s = synthetic_series(spark, days=30)
    again = synthetic_series(spark, days=30).repartition(13, "y")
    assert table_digest(s).first() == table_digest(again).first()
    assert s.count() == 720 and s.where("sun < 0").count() == 0
    m = synthetic_target(s.withColumn("position", F.unix_seconds("ts")).drop("y")).agg(F.avg("y"), F.stddev("y")).first()
    assert 2500 < m[0] < 9000
    s.select("ts", "y").write.option("header", True).csv(str(tmp_path / "s"))
    assert src.read_csv(spark, str(tmp_path / "s"), "ts timestamp, y double").count() == 720
    with pytest.raises(ContractError):
        fill_missing_covariates(s.drop("sun"), "commercial", {"sun": 0.0})
    assert fill_missing_covariates(s.drop("sun"), "demo", {"sun": 0.0, "humid": 50.0}).first()["sun"] == 0.0


# ---- text and digests ----------------------------------------------------------


def test_token_functions(spark):
    toks = ["1", " 2.5 ", "-.5", "+3e2", "1e", "nan", "inf", "", "4.", "0x1"]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    got = [r[0] for r in df.select(float_token(F.col("t"))).collect()]
    assert got == [1.0, 2.5, -0.5, 300.0, None, None, None, None, 4.0, None]
    df = spark.createDataFrame([(t,) for t in ("a,,b", ",,,", ",,,,", "")], "t string")
    assert [r[0] for r in df.select(blank_pairs(F.col("t"))).collect()] == ["a,,b".count(",,"), 1, 2, 0]


def test_table_digest_ignores_order_only(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("s"), (F.col("id") / 7).alias("x"))
    sha = lambda d: table_digest(d).first()["table_sha"]
    want = sha(df)
    assert sha(df.repartition(17).orderBy(F.desc("x"))) == want
    assert sha(df.withColumn("x", F.when(F.col("id") != 77, F.col("x")))) != want
    assert sha(df.unionByName(df.limit(1))) != want
    assert sha(df.withColumn("id", F.col("id").cast("int"))) != want


def test_actions(spark):
    df = spark.createDataFrame([("SHAPE_GRAD", True), ("SHAPE_GRAD", False), ("other", True)], "r string, c boolean")
    a, b, c = (r[0] for r in df.select(action_col(F.col("r"), F.col("c"))).collect())
    assert b == " / ".join(PLAYBOOK["SHAPE_GRAD"])
    assert len(a.split(" / ")) >= 3 and a.startswith("[重要]") and PLAYBOOK["SHAPE_GRAD"][2] not in a
    assert c.startswith("[重要]")


# ---- differences and faults ------------------------------------------------------


def plain_token_diff(a, b):
    total = delta = 0.0
    changed, worst = 0, 0.0
    for x, y in zip(a, b):
        for p, q in zip(x.split(","), y.split(",")):
            try:
                u, v = float(p), float(q)
            except ValueError:
                continue
            total += abs(u)
            if u != v:
                changed += 1
                delta += abs(v - u)
                worst = max(worst, abs(v - u) / (abs(u) if abs(u) >= 1e-9 else 1))
    return (delta / total if total else 0.0), changed, worst


@pytest.mark.parametrize("kind", [faults.spike, faults.rescale, faults.blank, faults.rotate, faults.truncate])
def test_token_diff_matches_loop(spark, kind):
    rows = sample()
    base = text_lines(spark, rows)
    cur = [r["line"] for r in kind(base).orderBy("line_no").collect()]
    got = diff.token_diff(base, kind(base)).first()
    want = plain_token_diff(rows, cur)
    assert np.isclose(got["diff_score"], want[0]) and got["changed_tokens"] == want[1]
    assert np.isclose(got["max_rel_change"], want[2])


def test_faults_do_what_they_say(spark):
    rows = sample()
    base = text_lines(spark, rows)
    out = lambda d: [r["line"] for r in d.orderBy("line_no").collect()]
    assert out(faults.rotate(base)) == rows[:2] + rows[26:] + rows[2:26]
    assert out(faults.truncate(base)) == rows[:-5]
    first = rows[2].split(",")
    assert out(faults.blank(base))[2] == f"{first[0]},,{first[2]}"
    assert out(faults.spike(base))[2].split(",")[1] == f"{float(first[1]) * 1.15:.2f}"
    assert out(faults.break_header(base))[1] == "unit_broken,C,MW"
    short = text_lines(spark, rows[:12])
    assert out(faults.rotate(short)) == rows[:2] + rows[3:12] + rows[2:3]


def test_header_digest_of_a_short_header(spark):
    rows = ["  name, value  ", "unit,x ", "a,1", "b,2"]
    got = diff.header_digest(text_lines(spark, rows)).first()["header_sha"]
    # one chunk, and its digest digested once more: the same two levels as for a long header
    chunk = hashlib.sha256("\n".join(r.rstrip() for r in rows[:2]).strip().encode()).hexdigest()
    assert got == hashlib.sha256(chunk.encode()).hexdigest()
    none = diff.header_digest(text_lines(spark, ["1,2", "3"])).first()["header_sha"]
    assert none == hashlib.sha256(b"").hexdigest()
    long = text_lines(spark, ["no numbers here"] * 9000)
    assert len(diff.header_digest(long).first()["header_sha"]) == 64


def test_contract_diff_rules(spark):
    base = spark.range(100).select("id", F.col("id").cast("double").alias("x"), F.lit("t").alias("t"))
    cur = spark.range(40).select("id", F.when(F.col("id") > 10, "bad").otherwise("1").alias("x"))
    got = {(r["rule"], r["column"]) for r in diff.contract_diff(diff.profile(cur), diff.profile(base)).collect()}
    assert got == {("missing_column", "t"), ("numeric_corruption", "x"), ("row_count", None)}
    assert diff.contract_diff(diff.profile(base), diff.profile(base)).count() == 0


# ---- whole runs --------------------------------------------------------------------


def test_scenario_matrix_all_pass(spark):
    main, target = sample(200, 2), sample(90, 3)
    got = scenario_matrix(text_lines(spark, main), text_lines(spark, target)).toPandas()
    assert len(got) == 10 and set(got["pass_fail"]) == {"PASS"}, got


def test_verification_notices_changes(spark):
    main = text_lines(spark, sample(60, 4))
    cfg = {"threshold": 0.05}
    audit = IntegrityAudit({"main": main}, cfg)
    reasons, cert = audit.run({"main": main}, cfg, "r1")
    ledger = audit.ledger_entry(cert)
    check = lambda c=cert, m=main, r=reasons, g=cfg, led=ledger: audit.verify(c, {"main": m}, r, g, led).first()
    assert check()["valid"]
    assert not check(m=faults.spike(main))["data_ok"]
    assert not check(g={"threshold": 0.1})["config_ok"]
    assert not check(led=ledger.limit(0))["ledger_ok"]
    assert not check(c=cert.withColumn("verdict", F.lit("NG")))["id_ok"]
    extra = reasons.unionByName(spark.createDataFrame([("main", "X", "x", None, None, None, None, None)], reasons.schema))
    assert not check(r=extra)["evidence_ok"]


@pytest.mark.parametrize("profile", ["commercial", "paper"])
def test_run_audit_and_sinks(spark, tmp_path, profile):
    s = synthetic_series(spark, days=60).select(F.lit("s1").alias("k"), "ts", "y", "temp")
    s = s.unionByName(s.withColumns({"k": F.lit("s2"), "y": F.col("y") + F.when(F.dayofyear("ts") == 58, 4000).otherwise(0)}))
    full = prepared(s, "y", (1, 24, 168), ["k"], complete=True)
    cfg = AuditConfig(profile=profile, calib_start="2023-02-05", test_start="2023-02-17")
    res = run_audit(full, cfg, ["k"], label="synthetic")
    for _ in range(2):
        res.write(str(tmp_path), "r1", ["k"])
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 4
    assert spark.read.parquet(f"{tmp_path}/evidence").count() == res.decided.count()
    assert set(spark.read.parquet(f"{tmp_path}/events").columns) >= {"start", "end", "hours", "action"}
    assert len(spark.read.text(f"{tmp_path}/latest").collect()) == 2
    checks = verify_certificate(res.certificates).collect()
    assert all(c["content_ok"] and c["certificate_ok"] for c in checks)
    ids = {r["k"]: r["certificate_id"] for r in res.certificates.collect()}
    assert all(r["scope"]["target_label"] == "y" for r in res.certificates.collect()) and res.provenance is None
    again = {r["k"]: r["certificate_id"] for r in run_audit(full.repartition(5), cfg, ["k"], label="synthetic").certificates.collect()}
    assert ids == again and ids["s1"] != ids["s2"]
    assert len({r["ledger_row_sha256"] for r in ledger_rows(res.certificates, ["k"]).collect()}) == 2
    assert res.events.where("k = 's2'").count() > 0
    forged = res.certificates.withColumn("human_summary", F.col("human_summary").withField("verdict", F.lit("OK?")))
    assert not any(c["certificate_ok"] for c in verify_certificate(forged).collect())
    sinks.append_ledger_csv(res.ledger, str(tmp_path))
    sinks.write_reasons(spark.createDataFrame([("a", 1)], "rule_id string, value int"), str(tmp_path))


def test_split_errors(spark):
    s = synthetic_series(spark, days=5).select("ts", "y").withColumn("row_no", (F.unix_seconds("ts") / 3600).cast("bigint"))
    spec = split_spec(s, dates=("2030-01-01", "2031-01-01"))
    with pytest.raises(ContractError):
        require_split(spec, assign_period(s, spec))
