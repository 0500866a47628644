"""Nothing is cut, rounded or decided by size: the cases that earlier versions got wrong."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import frame

from tidewatch.config import AuditConfig
from tidewatch.functions.exact import exact_means, exact_sums
from tidewatch.operators import contracts, diff
from tidewatch.operators.features import prepared, rollup
from tidewatch.operators.integrity import IntegrityAudit
from tidewatch.operators.quantile import exact_quantiles
from tidewatch.plans.audit import run_audit
from tidewatch.plans.queries import replay
from tidewatch.sources import lines as src
from tidewatch.sources.synthetic import synthetic_series
from tidewatch.streaming import windows
from tidewatch.streaming.flags import FlagSteps
from tidewatch.streaming.windows import hourly_rollup


def test_sums_keep_every_digit_in_any_order(spark):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-60, 60) for _ in range(2000)]
    rows = [("wide", v) for v in values] + [("tiny", 1e-15), ("tiny", 3e-15), ("small", 5e-324), ("none", None)]
    rows += [("odd", math.inf), ("odd", 1.0), ("nan", math.nan), ("zero", 0.0), ("big", 1e300), ("big", 1e300), ("big", -1e300)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = [{r.k: (r.n, r.total) for r in exact_sums(df.repartition(n), ["k"], "v").collect()} for n in (1, 3, 8)]
    text = [sorted(map(str, x.items())) for x in found]
    assert text[0] == text[1] == text[2]
    sums = found[0]
    assert sums["wide"][1] == pytest.approx(math.fsum(values), rel=1e-15)
    assert sums["tiny"] == (2, 4e-15) and sums["small"] == (1, 5e-324) and sums["none"] == (0, None) and sums["zero"] == (1, 0.0)
    assert sums["odd"][1] == math.inf and math.isnan(sums["nan"][1]) and sums["big"] == (3, 1e300)
    means = {r.k: r.m for r in exact_means(df, ["k"], "v", "m").collect()}
    assert means["tiny"] == 2e-15 and means["none"] is None
    assert exact_means(df.where("k = 'tiny'"), [], "v", "m").first().m == 2e-15


def test_rollup_of_small_values(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 4e-7), ("2024-01-01 00:20:00", 4e-7)], "ts string, v double")
    assert rollup(df, "ts", "v").first().y == 8e-7
    assert rollup(df, "ts", "v", agg="avg").first().y == 4e-7


@pytest.mark.parametrize("n", [1, 4096, 4097, 9000])
def test_header_digest_has_one_definition(spark, n):
    text = ["", "  "] + ["  first"] + [f"line {chr(97 + i % 26)}  " for i in range(1, n)] + ["", " \t"]
    df = spark.createDataFrame(list(enumerate(text)), "line_no long, line string").repartition(4)
    kept = [x.rstrip() for x in text[2 : 2 + n]]
    kept[0] = kept[0].lstrip()
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    chunks = [sha(kept[i : i + 4096]) for i in range(0, n, 4096)]
    assert diff.header_digest(df).first().header_sha == sha(chunks)


def test_quantiles_do_not_depend_on_how_work_is_spread(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(x),) for x in rng.normal(size=3000)], "v double")
    qs = [i / 900 for i in range(1, 900)]
    few, many = (exact_quantiles(df, [], "v", qs, one_run=n).first()["quantiles"] for n in (5, 10**6))
    assert few == many


def test_preamble_of_any_length(spark, tmp_path):
    text = "note\n" * 120 + "年月日時,気温(℃)\n2024/1/1 1:00,3.5\n"
    (tmp_path / "w.csv").write_text(text, "utf-8")
    assert src.read_aliased_csv(spark, str(tmp_path / "w.csv"), charset="utf-8").first().temp == 3.5
    with pytest.raises(ValueError):
        src.read_aliased_csv(spark, str(tmp_path / "w.csv"), charset="utf-8", header_within=80)


def test_loose_rows_do_not_depend_on_columns(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text('a,b\n1,2\n3,4,5\n"x,y",6\n7,8,9\n10\n')
    got = src.read_loose_csv(spark, str(p))
    assert got.count() == len(got.collect()) == got.select("a").count() == 3
    assert {r.a for r in got.collect()} == {"1", "x,y", "10"}
    _, _, skipped = src.loose_lines(spark, str(p))
    assert sorted((r.line, r.n_fields) for r in skipped.collect()) == [("3,4,5", 3), ("7,8,9", 3)]


def test_a_dropped_column_is_named(spark):
    rng = random.Random(6)
    rows = [[f"{rng.random():.6f}" for _ in range(5)] for _ in range(300)]
    table = lambda keep: [",".join("abcde"[i] for i in keep)] + [",".join(r[i] for i in keep) for r in rows]
    lines = lambda t: spark.createDataFrame(list(enumerate(t)), "line_no long, line string")
    audit = IntegrityAudit({"d": lines(table(range(5)))}, {"threshold": 0.05})
    reasons, _ = audit.run({"d": lines(table([0, 2, 3, 4]))}, {"threshold": 0.05}, "r")
    contract = [r for r in reasons.collect() if r.rule_id == "data_contract_violation" and r["column"]]
    assert {(r["metric"], r["column"]) for r in contract} == {("missing_column", "b")}


def test_order_of_reading_is_claimed_only_when_looked_at(spark):
    df = spark.createDataFrame([(f"2024-01-01 0{h}:00:00", 1.0, -h) for h in range(5)], "t string, y double, no int")
    df = df.withColumn("ts", F.to_timestamp("t"))
    cfg = AuditConfig()
    plain = contracts.series_report(df, cfg).first()
    assert plain.monotonic is None and plain.status == "PASS"
    assert contracts.series_violations(contracts.series_report(df, cfg), cfg).count() == 0
    looked = contracts.series_report(df, cfg, ingest_no="no").first()
    assert looked.monotonic is False and looked.status == "FAIL"


def test_stream_takes_tau_row_by_row_and_keeps_equal_times(spark, tmp_path):
    _, df = frame(spark, 200, 9, keys=("a",))
    df = df.withColumn("tau", F.when(F.col("row_no") % 50 < 25, 0.9).otherwise(0.5)).select("k", "ts", "score", "tau")

    def flags_of(rows, folder):
        step = FlagSteps(AuditConfig(), ["k"], folder)
        return windows.replay(rows, ["2024-01-03"], lambda s: s, folder, step=step, schema=step.schema(rows.schema))

    out, twice = flags_of(df, f"{tmp_path}/tau"), flags_of(df.union(df), f"{tmp_path}/twice")
    assert out.count() == 200 and out.where("flag is null").isEmpty()
    assert twice.count() == 400 and twice.where("flag is null").isEmpty()
    rows = df.orderBy("ts").collect()
    on, raw, flags = 0, [], []
    for r in rows:
        on = 1 if r.score > r.tau else 0 if r.score < r.tau * AuditConfig().low_ratio else on
        raw.append(on)
        flags.append(int(sum(raw[-AuditConfig().w :]) >= AuditConfig().k))
    assert [r.flag for r in out.orderBy("ts").collect()] == flags


def test_a_closed_stream_gives_every_hour(spark):
    _, df = frame(spark, 100, 10, keys=("a", "b"))
    d = df.select("k", "ts", "score")
    out = replay(d, ["2024-01-02"], lambda s: hourly_rollup(s, "ts", "score", ["k"]), "t-roll", close=True)
    assert out.count() == d.groupBy("k", F.date_trunc("hour", "ts")).count().count()
    assert out.where("k is null").isEmpty()


def test_a_short_series_does_not_stop_the_others(spark):
    s = synthetic_series(spark, days=60).select(F.lit("long").alias("k"), "ts", "y")
    s = s.unionByName(s.where("ts < '2023-01-10'").withColumn("k", F.lit("short")))
    cfg = AuditConfig(profile="paper", calib_start="2023-02-05", test_start="2023-02-17")
    res = run_audit(prepared(s, "y", (1, 24), ["k"], complete=True), cfg, ["k"])
    assert [r.k for r in res.certificates.collect()] == ["long"]
    assert [(r.k, r.rule_id) for r in res.refused.collect()] == [("short", "split")]
