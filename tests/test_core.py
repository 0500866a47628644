import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loops import budget, edges, flags, hold, k_of_w, rolling, sessions, tune
from tidewatch.config import AuditConfig
from tidewatch.operators import calibrate, contracts, decide
from tidewatch.operators import flags as fl
from tidewatch.operators.features import densify, dedupe_first, merge_target, rollup
from tidewatch.operators.quantile import exact_quantiles
from tidewatch.operators.sequence import index_rows, lagged
from tidewatch.operators import shift
from tidewatch.operators.shift import circular_shift, xcorr_lag

T0 = pd.Timestamp("2024-01-01")


def frame(spark, n, seed, keys=("a", "b", "c"), gaps=True, hot=1):
    """Keyed random series with gaps; the first key is ``hot`` times as long."""
    rng = np.random.default_rng(seed)
    parts = []
    for j, k in enumerate(keys):
        m = n * (hot if j == 0 else 1)
        step = np.where(rng.random(m) < (0.05 if gaps else 0), rng.integers(2, 60, m), 1)
        hour = np.cumsum(step)
        calm = np.repeat(rng.random(m // 8 + 1), 8)[:m]
        parts.append(
            pd.DataFrame(
                {
                    "k": k,
                    "row_no": np.arange(m),
                    "sec": hour * 3600,
                    "score": np.round(calm + 0.4 * rng.random(m), 3),
                    "reason": np.where(rng.random(m) < 0.5, "LEVEL_RESIDUAL", "SHAPE_GRAD"),
                }
            )
        )
    pdf = pd.concat(parts, ignore_index=True)
    pdf["ts"] = T0 + pd.to_timedelta(pdf["sec"], unit="s")
    shuffled = pdf.sample(frac=1, random_state=seed)
    return pdf, spark.createDataFrame(shuffled).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("span", [None, 40 * 3600 * 1_000_000])
def test_index_rows_matches_rank(spark, span):
    pdf, df = frame(spark, 120, 1, hot=10)
    got = index_rows(df.drop("row_no"), ["k"], "ts", span, bound=50).toPandas()
    both = got.merge(pdf, on=["k", "sec"], suffixes=("", "_want"))
    assert len(both) == len(pdf) and (both["row_no"] == both["row_no_want"]).all()


def test_index_rows_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("v"))
    got = index_rows(df, [], "v", span=50).orderBy("v").toPandas()
    assert got["row_no"].tolist() == list(range(1000))


def test_lags_cross_blocks(spark):
    pdf, df = frame(spark, 100, 2)
    got = lagged(df, ["k"], {"l1": ("score", 1), "l9": ("score", 9)}, rows=11).toPandas()
    got = got.sort_values(["k", "row_no"])
    for n, c in ((1, "l1"), (9, "l9")):
        want = pdf.sort_values(["k", "row_no"]).groupby("k")["score"].shift(n)
        assert np.array_equal(got[c].to_numpy(), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("rows", [8, 8192])
@pytest.mark.parametrize("w,k", [(5, 3), (3, 1), (7, 4)])
def test_flags_match_loop(spark, w, k, rows):
    pdf, df = frame(spark, 200, 3, hot=3)
    out = fl.flag_streams(
        df, {"f": ("score", 0.9), "g": ("score", 0.6)}, w, k, 0.9, ["k"], rows, keep=["f_raw", "f_edge"]
    )
    got = out.toPandas().sort_values(["k", "row_no"])
    for key, part in got.groupby("k"):
        s = pdf[pdf.k == key]["score"].tolist()
        raw = hold(s, 0.9, 0.9)
        assert part["f_raw"].tolist() == raw
        assert part["f"].tolist() == k_of_w(raw, w, k)
        assert part["f_edge"].sum() == edges(k_of_w(raw, w, k))
        assert part["g"].tolist() == flags(s, 0.6, w, k, 0.9)


def test_flags_with_nan_and_own_w(spark):
    rows = [("a", i, v) for i, v in enumerate([0.1, 2.0, float("nan"), 2.0, 0.99, 0.1, 3.0])]
    rows += [("b", i, v) for i, v in enumerate([2.0, 2.0, 0.1, 2.0])]
    df = spark.createDataFrame(rows, "k string, row_no long, s double")
    df = df.withColumn("w", F.when(F.col("k") == "a", 3).otherwise(2)).withColumn("n", F.lit(2))
    out = fl.flag_streams(df, {"f": ("s", 1.0)}, "w", "n", 0.98, ["k"], 4, w_grid=[2, 3])
    got = {k: p.sort_values("row_no")["f"].tolist() for k, p in out.toPandas().groupby("k")}
    assert got == {"a": [0, 0, 1, 1, 1, 1, 1], "b": [0, 1, 0, 0]}


@pytest.mark.parametrize("rows", [6, 8192])
@pytest.mark.parametrize("cooldown", [1, 30])
def test_events_match_loop(spark, rows, cooldown):
    pdf, df = frame(spark, 150, 4, hot=3)
    df = df.withColumn("flag", (F.col("score") > 1.1).cast("int")).withColumn(
        "tau_cap_hit", (F.col("row_no") % 2).cast("int")
    )
    got = fl.events(df, "flag", cooldown, ["k"], rows).toPandas()
    for key, part in pdf.groupby("k"):
        part = part.reset_index(drop=True)
        want = sessions(part["sec"].tolist(), (part["score"] > 1.1).tolist(), cooldown * 3600)
        mine = got[got.k == key].sort_values("event_row")
        assert list(zip(mine["event_row"], mine["event_row"] + mine["hours"] - 1)) == want
        for (a, b), row in zip(want, mine.itertuples()):
            seg = part.iloc[a : b + 1]
            assert row.start == part["ts"][a] and row.end == part["ts"][b]
            assert row.peak_score == seg["score"].max() and row.peak_row == seg["score"].idxmax()
            counts = seg["reason"].value_counts()
            top = set(counts[counts == counts.max()].index)
            assert row.reason_major == next(r for r in seg["reason"] if r in top)
            assert row.action.startswith("[重要]") == bool(row.peak_row % 2)


@pytest.mark.parametrize("one_run", [5, 10**6])
def test_quantiles_exact(spark, one_run):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=3000), 2)
    a[:1000] = 0.25  # a third are copies
    pdf = pd.DataFrame({"g": ["x"] * 3000 + ["y"], "v": [*a, 7.0]})
    qs = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", qs, one_run=one_run)
    got = {r["g"]: r["quantiles"] for r in got.collect()}
    assert np.allclose(got["x"], np.quantile(a, qs), atol=1e-12) and got["y"] == [7.0] * 6
    flat = exact_quantiles(spark.createDataFrame(pdf), [], "v", [0.5], one_run=one_run).first()
    assert flat["n"] == 3001 and np.isclose(flat["quantiles"][0], np.median(pdf["v"]))


@pytest.mark.parametrize("rows", [20, 8192])
def test_candidate_counts_match_loop(spark, rows):
    pdf, df = frame(spark, 150, 6, keys=("a", "b"))
    settings = [(5, 3), (3, 2), (7, 4), (5, 1)]
    got = calibrate.candidate_events(df, "score", settings, 0.95, ["k"], rows=rows).toPandas()
    assert len(got) == 2 * 200 * 4
    for r in got.itertuples():
        if r.cand % 20:
            continue
        s = pdf[pdf.k == r[1]]["score"].tolist()
        assert r.events == edges(flags(s, r.tau, r.w_rows, r.k_hits, 0.95))


def test_budget_and_tuner_match_loop(spark):
    pdf, df = frame(spark, 300, 7, keys=("a", "b"))
    df = df.withColumnRenamed("k", "key")
    cfg = AuditConfig(events_per_period=2.0, rows_per_period=100)
    b = {r["key"]: r for r in calibrate.budget_tau(df, "score", cfg, ["key"], rows=64).collect()}
    t = {r["key"]: r for r in calibrate.tune_wk(df, "score", cfg, ["key"], rows=64).collect()}
    for key in ("a", "b"):
        s = pdf[pdf.k == key]["score"].to_numpy()
        assert np.isclose(b[key]["tau_budget"], budget(s, 5, 3, 0.98, 2.0, 100), atol=1e-12)
        tau, w, k = tune(s, calibrate.settings_grid(cfg), 0.98, 2.0, 100)
        assert (t[key]["w_rows"], t[key]["k_hits"]) == (w, k) and np.isclose(t[key]["tau_budget"], tau)
    assert (3, 4) not in calibrate.settings_grid(cfg)
    assert (3, 4) in calibrate.settings_grid(cfg.with_(allow_unsatisfiable=True))


@pytest.mark.parametrize("cap,span", [(1.5, 512), (1.5, 2), (0.95, 5)])
def test_rolling_matches_loop(spark, cap, span):
    pdf, df = frame(spark, 200, 8, keys=("a", "b"), hot=2)
    cfg = AuditConfig(
        rolling_days=3, block_days=1, min_rolling_rows=20, events_per_period=1.0, rows_per_period=24, cap_ratio=cap
    )
    df = df.withColumnRenamed("k", "key").withColumn(
        "period", F.when(F.col("row_no") < 40, "fit").when(F.col("row_no") < 100, "calib").otherwise("test")
    )
    taus = spark.createDataFrame(
        [("a", 1.1, 1.2, 5, 3), ("b", 1.0, 0.9, 3, 2)], "key string, tau_fixed double, tau_budget double, w_rows int, k_hits int"
    )
    got = decide.decide_rolling(df, taus, cfg, ["key"], span_blocks=span).toPandas().sort_values(["key", "row_no"])
    for key, fixed, first, w, k in (("a", 1.1, 1.2, 5, 3), ("b", 1.0, 0.9, 3, 2)):
        part = pdf[(pdf.k == key) & (pdf.row_no >= 40)].reset_index(drop=True)
        want = rolling(part["sec"].tolist(), part["score"].tolist(), 60, fixed, first, w, k, cfg)
        mine = got[got.key == key]
        cols = ["tau_budget", "tau_sci", "tau_cap_hit", "flag_budget", "flag_sci"]
        assert np.allclose(mine[cols].to_numpy(dtype=float), np.asarray(want, dtype=float), atol=1e-12)


def test_rolling_without_enough_rows_is_frozen(spark):
    _, df = frame(spark, 120, 9, keys=("a",))
    df = df.withColumnRenamed("k", "key").withColumn(
        "period", F.when(F.col("row_no") < 60, "calib").otherwise("test")
    )
    cfg = AuditConfig(min_rolling_rows=10**6)
    taus = calibrate.capped(
        spark.createDataFrame([("a", 0.7, 0.9, 5, 3)], "key string, tau_fixed double, tau_budget double, w_rows int, k_hits int"), 1.5
    )
    a = decide.decide_rolling(df, taus, cfg, ["key"]).select("row_no", "flag_sci", "flag_budget", "tau_sci")
    b = decide.decide_frozen(df, taus, cfg, ["key"]).select("row_no", "flag_sci", "flag_budget", "tau_sci")
    assert sorted(a.collect()) == sorted(b.collect())


def test_xcorr_matches_numpy(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=300)
    rows = []
    for key, cur in (("same", base), ("moved", np.roll(base, -17)), ("noise", rng.normal(size=300))):
        rows += [(key, i, float(a), float(b)) for i, (a, b) in enumerate(zip(base, cur))]
    df = spark.createDataFrame(rows, "key string, row_no long, a double, b double")
    got = xcorr_lag(df.select("key", "row_no", F.col("a").alias("v")), df.select("key", "row_no", F.col("b").alias("v")), "v", ["key"])
    got = {r["key"]: r for r in got.collect()}
    for key, part in pd.DataFrame(rows, columns=["key", "i", "a", "b"]).groupby("key"):
        full = np.correlate(part.a - part.a.mean(), part.b - part.b.mean(), mode="full")
        assert got[key]["shift"] == int(np.argmax(full)) - 299
        assert np.isclose(got[key]["corr"], full.max())


def test_xcorr_of_long_and_short_series(spark, monkeypatch):
    """Every series at its own length: short ones in common groups, long ones split, the same lags."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for key, n in [(f"s{i}", int(rng.integers(2, 120))) for i in range(60)] + [("long", 3000), ("pair", 2)]:
        a = rng.normal(size=n)
        b = np.roll(a, int(rng.integers(n))) + rng.normal(size=n) * 0.1
        full = np.correlate(a - a.mean(), b - b.mean(), mode="full")
        want[key] = (int(np.argmax(full)) - n + 1, full.max())
        rows += [(key, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "key string, row_no long, a double, b double")
    a, b = (df.select("key", "row_no", F.col(c).alias("v")) for c in "ab")
    for short, pack in ((1 << 14, 1 << 20), (1 << 7, 300), (0, 1)):
        monkeypatch.setattr(shift, "SHORT_CELLS", short)
        monkeypatch.setattr(shift, "PACK_CELLS", pack)
        got = {r.key: r for r in xcorr_lag(a, b, "v", ["key"]).collect()}
        assert set(got) == set(want)
        assert all(got[k]["shift"] == lag and np.isclose(got[k]["corr"], corr) for k, (lag, corr) in want.items())


def test_xcorr_of_constant_is_none(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "row_no long, v double")
    assert xcorr_lag(df, df, "v").take(1) == []


@pytest.mark.parametrize(
    "body,by,want",
    [
        ([f"l{i}" for i in range(50)], 7, 7),
        (["x"] * 30 + ["y"] + ["x"] * 19, 13, 13),  # one line repeated 49 times
        (["a", "b"] * 12, 0, None),  # unchanged
        (["a", "b", "c"] * 8, 4, 22),  # periodic: the earliest fit counts
        ([f"l{i}" for i in range(50)], None, None),  # two lines swapped
    ],
)
def test_circular_shift(spark, body, by, want):
    cur = body[by:] + body[:by] if by is not None else [body[1], body[0], *body[2:]]
    make = lambda x: spark.createDataFrame(list(enumerate(x)), "row_no long, line string")
    got = circular_shift(make(body), make(cur)).first()
    n = len(body)
    brute = next((i for i in range(n) if all(body[k] == cur[(i + k) % n] for k in range(n))), None)
    expected = None if brute in (None, 0) else (n - brute) % n
    assert (got["shift"] if got else None) == expected
    if by:
        assert expected == want


def test_rollup_densify_dedupe(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.5, 3), ("a", "2024-01-01 03:59:59", 2.25, 1), ("a", "2024-01-01 03:00:00", 1.0, 2)]
    df = spark.createDataFrame(rows, "k string, t string, v double, no int").withColumn("ts", F.col("t").cast("timestamp"))
    full = densify(rollup(df, "ts", "v", keys=["k"]), keys=["k"]).orderBy("ts").toPandas()
    assert full["y"].tolist() == [1.5, 0.0, 0.0, 3.25]
    one = dedupe_first(df.withColumn("ts", F.date_trunc("hour", "ts")), "ts", ["k"], "no").orderBy("ts").toPandas()
    assert one["v"].tolist() == [1.5, 2.25]


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_merge_report(spark, how):
    cov = spark.createDataFrame([(i, float(i)) for i in range(10)], "ts int, temp double")
    tgt = spark.createDataFrame([(i, 1.0 if i != 5 else None) for i in range(4, 14)], "ts int, y double")
    merged, report = merge_target(cov, tgt, how)
    r = report.first()
    assert (r["covariate_rows"], r["target_rows"], r["merged_rows"]) == (10, 10, merged.count())
    assert merged.count() == {"inner": 5, "left": 5, "outer": 9}[how]


def test_contract_rules(spark):
    pdf, df = frame(spark, 100, 11, keys=("a",), gaps=False)
    series = df.select("ts", F.col("score").alias("y"), "row_no")
    cfg = AuditConfig()
    clean = contracts.series_report(series, cfg, ingest_no="row_no")
    assert clean.first()["status"] == "PASS"
    assert contracts.enforce(contracts.series_violations(clean, cfg), cfg).count() == 0
    back = series.withColumn("row_no", 99 - F.col("row_no"))
    copies = series.unionByName(series.where("row_no < 5"))
    gap = series.where("row_no % 3 != 0")
    off = series.withColumn("ts", F.expr("ts + interval 5 minutes"))
    for bad, rule in ((back, "monotonic"), (copies, "duplicates"), (gap, "continuity"), (off, "grid")):
        rep = contracts.series_report(bad, cfg, ingest_no="row_no" if rule == "monotonic" else None)
        found = contracts.series_violations(rep, cfg)
        assert rule in {r["rule_id"] for r in found.collect()} and rep.first()["status"] == "FAIL"
        with pytest.raises(ValueError):
            contracts.enforce(found, cfg)
        assert contracts.enforce(found, cfg.with_(profile="demo")).count() > 0
    for bad in (AuditConfig(profile="demo"), AuditConfig(synthetic=True), AuditConfig(profile="x")):
        with pytest.raises(ValueError):
            bad.check_profile()


@pytest.mark.parametrize("few", [0, 64])
def test_rotations_by_rare_lines_and_by_correlation(spark, monkeypatch, few):
    monkeypatch.setattr(shift, "FEW", few)
    make = lambda x: spark.createDataFrame(list(enumerate(x)), "row_no long, line string")
    for body, by, want in (([f"l{i}" for i in range(40)], 7, 7), (["x"] * 30 + ["y"] + ["x"] * 9, 13, 13), (["a", "b", None] * 8, 4, 22), (["a", "b"] * 9, 0, None)):
        got = circular_shift(make(body), make(body[by:] + body[:by])).first()
        assert (got["shift"] if got else None) == want


def test_unshifted_series_and_rare_lines_need_no_transform(spark, monkeypatch):
    def never(*_):
        raise AssertionError("transformed")

    monkeypatch.setattr(shift, "correlate", never)
    monkeypatch.setattr(shift, "SHORT_CELLS", 0)
    v = np.random.default_rng(14).normal(size=500)
    series = lambda x: spark.createDataFrame([(i, float(y)) for i, y in enumerate(x)], "row_no long, v double")
    one = v.copy()
    one[17] *= 1.0001
    for now in (v, v * 1.05, one):
        got = xcorr_lag(series(v), series(now), "v").collect()
        assert [r["shift"] for r in got] == [0]
    lines = lambda x: spark.createDataFrame([(i, f"{y}") for i, y in enumerate(x)], "row_no long, line string")
    assert circular_shift(lines(v), lines(np.roll(v, -24))).first()["shift"] == 24
    with pytest.raises(AssertionError, match="transformed"):
        xcorr_lag(series(v), series(np.roll(v, -24)), "v")
