import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from test_core import frame
from tidewatch.config import AuditConfig
from tidewatch.operators import decide
from tidewatch.operators.flags import flag_streams
from tidewatch.plans.queries import replay
from tidewatch.operators.sweep import step_flags
from tidewatch.streaming import windows
from tidewatch.streaming.decide import decide_stream
from tidewatch.streaming.flags import FlagSteps
from tidewatch.streaming.state import KeyedState

CUTS = ["2024-01-05", "2024-01-11"]


def test_steps_equal_one_pass():
    rng = np.random.default_rng(1)
    s = rng.random(200)
    whole, *_ = step_flags(s, 0.7, 5, 3, 0.9, 0, [])
    on, tail, parts = 0, [], []
    for part in np.split(s, [3, 50, 51, 120]):
        f, on, tail = step_flags(part, 0.7, 5, 3, 0.9, on, tail)
        parts += f.tolist()
    assert parts == whole.tolist()


def flags_of(given, folder, cuts=CUTS, cfg=AuditConfig(), **options):
    step = FlagSteps(cfg, ["k"], str(folder), **options)
    return windows.replay(given, cuts, lambda s: s, str(folder), step=step, schema=step.schema(given.schema))


def test_stream_flags_equal_batch(spark, tmp_path):
    _, df = frame(spark, 250, 21, keys=("a", "b"))
    df = df.withColumn("tau", F.lit(0.9))
    batch = flag_streams(df, {"flag": ("score", "tau")}, 5, 3, 0.98, ["k"]).select("k", "ts", "flag")
    stream = flags_of(df.select("k", "ts", "score", "tau"), tmp_path)
    assert sorted(stream.select("k", "ts", "flag").collect()) == sorted(batch.collect())


@pytest.mark.parametrize(("w", "k"), [(1, 1), (7, 4)])
def test_a_hot_key_in_one_micro_batch_runs_in_many_groups(spark, tmp_path, w, k):
    """A key with nearly all rows, also before 1970, with ties in time, thresholds that change and a null key."""
    rng = np.random.default_rng(3)
    n = 120_000
    at = np.sort(rng.integers(-(10**15), 10**15, n))
    at[1000:1010] = at[1000]
    score, tau = rng.random(n), rng.choice([0.8, 0.9, 0.95], n)
    score[rng.random(n) < 0.01] = np.nan
    key = np.where(np.arange(n) % 50 == 0, None, "hot")
    pdf = pd.DataFrame({"k": key, "us": at, "score": score, "tau": tau})
    rows = spark.createDataFrame(pdf, "k string, us long, score double, tau double")
    rows = rows.select("k", F.timestamp_micros("us").alias("ts"), "score", "tau").repartition(6)
    cfg = AuditConfig(w=w, k=k)
    got = flags_of(rows, tmp_path, ["1970-01-02", "1975-01-01"], cfg, rows=1000)
    got = got.select("k", F.unix_micros("ts").alias("us"), "score", "flag").toPandas()
    assert len(got) == n
    for name, part in pdf.groupby("k", dropna=False):
        part = part.sort_values(["us", "score"], kind="stable", na_position="last")
        flags, *_ = step_flags(part["score"].to_numpy(), part["tau"].to_numpy(), w, k, cfg.low_ratio, 0, [])
        mine = got[got["k"].isna()] if pd.isna(name) else got[got["k"] == name]
        mine = mine.sort_values(["us", "score"], kind="stable", na_position="last")
        assert mine["us"].tolist() == part["us"].tolist()
        np.testing.assert_array_equal(mine["flag"].to_numpy(), flags)


def test_late_rows_come_out_without_a_flag_and_batches_can_run_again(spark, tmp_path):
    step = FlagSteps(AuditConfig(w=3, k=2), ["k"], str(tmp_path))
    make = lambda *rows: spark.createDataFrame(rows, "k string, s long, score double, tau double").select(
        "k", F.timestamp_seconds("s").alias("ts"), "score", "tau"
    )
    flags = lambda df: sorted((r.k, r.ts.timestamp(), r.flag) for r in df.collect())
    assert flags(step(make(("a", 10, 1.0, 0.5), ("a", 20, 1.0, 0.5)), 0)) == [("a", 10.0, 0), ("a", 20.0, 1)]
    second = make(("a", 5, 1.0, 0.5), ("a", 30, 0.0, 0.5), ("b", 1, 1.0, 0.5))
    for _ in range(2):
        assert [f for _, _, f in flags(step(second, 1))] == [None, 1, 0]
    # a key without rows in a batch keeps its state
    assert flags(step(make(("b", 2, 1.0, 0.5)), 2)) == [("b", 2.0, 1)]
    assert flags(step(make(("a", 40, 0.0, 0.5)), 3)) == [("a", 40.0, 0)]


def test_state_versions(spark, tmp_path):
    state = KeyedState(str(tmp_path), ["k"], T.StructType.fromDDL("k string, x int"), compact=4)
    held = {}
    for batch in range(11):
        assert {r.k: r.x for r in state.before(spark, batch).collect()} == held
        new = {k: batch for k in ("a", "b", "c") if (batch + ord(k)) % 3 == 0}
        for _ in range(2):
            state.write(spark.createDataFrame(list(new.items()), "k string, x int"), batch)
        held |= new


TAUS = "key string, tau_fixed double, tau_budget double, w_rows int, k_hits int"
DECIDED = ["key", "ts", "flag_budget", "flag_sci", "tau_cap_hit", "tau_budget"]


def decided(rows, cfg, folder, cuts=CUTS):
    out = windows.replay(rows, cuts, lambda s: decide_stream(s, cfg, ["key"]), str(folder), close=True)
    return sorted(map(tuple, out.where("key IS NOT NULL").select(*DECIDED).collect()))


@pytest.mark.parametrize("years", [0, 80])
def test_stream_decisions_equal_batch(spark, tmp_path, years):
    """However rows are dealt to micro-batches, also before 1970."""
    _, df = frame(spark, 300, 22, keys=("a", "b"))
    cfg = AuditConfig(rolling_days=3, min_rolling_rows=20, rows_per_period=24, cap_ratio=1.0)
    df = df.withColumnRenamed("k", "key").withColumn("period", F.when(F.col("row_no") < 80, "calib").otherwise("test"))
    # whole days, so that the cuts between the runs move along
    df = df.withColumn("ts", F.col("ts") - F.make_dt_interval(F.lit(365 * years)))
    taus = spark.createDataFrame([("a", 1.1, 1.2, 5, 3), ("b", 1.0, 0.9, 3, 2)], TAUS)
    batch = sorted(map(tuple, decide.decide_rolling(df, taus, cfg, ["key"]).select(*DECIDED).collect()))
    rows = df.join(taus, "key").select("key", "ts", "score", "period", "tau_fixed", "tau_budget", "w_rows", "k_hits")
    cuts = [str(pd.Timestamp(c) - pd.Timedelta(days=365 * years)) for c in CUTS]
    assert decided(rows, cfg, tmp_path / "stream", cuts) == batch


def test_late_rows_have_no_decision_and_open_blocks_wait(spark, tmp_path):
    _, df = frame(spark, 200, 23, keys=("a",))
    cfg = AuditConfig(rolling_days=3, min_rolling_rows=20, rows_per_period=24)
    df = df.withColumnRenamed("k", "key").withColumn("period", F.when(F.col("row_no") < 80, "calib").otherwise("test"))
    taus = spark.createDataFrame([("a", 1.1, 1.2, 5, 3)], TAUS)
    rows = df.join(taus, "key").select("key", "ts", "score", "period", "tau_fixed", "tau_budget", "w_rows", "k_hits", "row_no")
    ends = rows.agg(F.max("ts")).first()[0]
    rows, late = rows.where("row_no <> 90").drop("row_no"), rows.where("row_no = 90").drop("row_no")
    folder = str(tmp_path / "late")

    def feed(part):
        part.write.mode("append").parquet(f"{folder}/in")
        return windows.run_to_end(decide_stream(windows.file_stream(spark, rows.schema, f"{folder}/in"), cfg, ["key"]), folder)

    feed(rows)
    early = feed(late)
    got = {r.ts: r for r in early.collect()}
    open_rows = rows.where(F.col("period") == "test").count() - (len(got) - 1)
    assert 0 < open_rows <= 25 and max(got) < ends
    last = late.first().ts
    assert got[last].flag_sci is None and got[last].score == late.first().score
    assert all(r.flag_sci is not None for t, r in got.items() if t != last)
    feed(windows.closing_row(rows))
    closed = feed(rows.limit(0))
    assert closed.where("key = 'a'").count() == rows.where(F.col("period") == "test").count() + 1


def test_a_block_takes_the_settings_of_its_first_row(spark, tmp_path):
    """Taus, W and K that change inside a micro-batch change with the next block, however rows are dealt."""
    _, df = frame(spark, 240, 24, keys=("a",))
    cfg = AuditConfig(rolling_days=3, min_rolling_rows=20, rows_per_period=24, cap_ratio=1.0)
    later = F.col("row_no") >= 150
    rows = df.withColumnRenamed("k", "key").select(
        "key", "ts", "score", F.when(F.col("row_no") < 80, "calib").otherwise("test").alias("period"),
        F.when(later, 0.2).otherwise(1.1).alias("tau_fixed"), F.lit(1.2).alias("tau_budget"),
        F.when(later, 3).otherwise(5).alias("w_rows"), F.when(later, 1).otherwise(3).alias("k_hits"),
    )
    one, many = decided(rows, cfg, tmp_path / "one", []), decided(rows, cfg, tmp_path / "many", ["2024-01-05", "2024-01-07", "2024-01-08 07:00:00"])
    assert one == many
    hits = [r[4] for r in one]
    assert 0 in hits and 1 in hits
