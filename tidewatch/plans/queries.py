"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DAILY, AuditConfig
from tidewatch.functions.calendar import add_calendar, add_cyclic
from tidewatch.functions.digest import changed_rows, row_text, table_digest
from tidewatch.functions.text import float_token, tokens
from tidewatch.operators import calibrate, contracts, decide, diff, faults, features, flags, health, predict, ridge
from tidewatch.operators import score as scoring
from tidewatch.operators.integrity import IntegrityAudit
from tidewatch.operators.quantile import exact_quantiles, quantile_columns
from tidewatch.operators.sequence import attach
from tidewatch.operators.shift import circular_shift, xcorr_lag
from tidewatch.operators.split import period_ranges, split_spec
from tidewatch.plans.audit import metrics_of, run_audit
from tidewatch.plans.relations import (
    DK,
    HK,
    customer_lines,
    daily,
    daily_audit,
    daily_scored,
    daily_split,
    hourly,
    hourly_banded,
    indexed_hourly,
    ntz,
    once,
    order_lines,
    table,
)
from tidewatch.plans.scenarios import CONFIG, scenario_matrix
from tidewatch.session import shared_dir, stage_table
from tidewatch.sources.files import file_digests, file_ranges
from tidewatch.sources.monthly import union_parts
from tidewatch.streaming import windows
from tidewatch.streaming.decide import decide_stream
from tidewatch.streaming.flags import FlagSteps
from tidewatch.streaming.windows import event_sessions, hourly_rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: weeks of four in the budget, W and K as given
BUDGET = DAILY.with_(auto_tune=False, events_per_period=2.0)
ROLLING = DAILY.with_(auto_tune=False, rows_per_period=28)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf: ntz(fn(spark, sf))
    return fn


def r6(*cols: str) -> dict[str, object]:
    return {c: F.round(c, 6) for c in cols}


def shown(*cols: str) -> list[Column]:
    """Six places; three places of a million for residuals over a floor near zero."""
    small = lambda c: F.abs(c) < 1e6
    return [
        F.when(small(c), F.round(c, 6)).otherwise(F.round(F.col(c) / 1e6, 3) * 1e6).alias(c) for c in cols
    ]


def flag_tau(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Scored rows with the 0.9 quantile of the calibration scores as ``tau``."""
    calib = scored.where("period = 'calib'")
    return attach(scored, quantile_columns(calib, keys, {"tau": ("score", 0.9)}), keys)


def flagged(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    def make() -> DataFrame:
        d = flag_tau(daily_scored(spark, sf, keys), keys)
        keep = ["flag_raw", "flag_edge"]
        return flags.flag_streams(d, {"flag": ("score", "tau")}, 5, 3, 0.98, keys, keep=keep)

    return once("daily-flagged", spark, sf, keys, make)


# ---- series and features -----------------------------------------------------


@query
def hourly_series(spark, sf):
    return hourly(spark, sf).select("ts", F.round("y", 6).alias("y"))


@query
def hourly_series_by_type(spark, sf):
    return hourly(spark, sf, HK).select(*HK, "ts", F.round("y", 6).alias("y"))


@query
def daily_series_by_status(spark, sf):
    return daily(spark, sf, DK).select(*DK, "ts", F.round("y", 6).alias("y"))


@query
def calendar_features(spark, sf):
    d = add_cyclic(add_calendar(hourly(spark, sf)).withColumn("temp", F.col("y")))
    cols = ["hour", "dayofyear", "weekday", "is_weekend", "sin_doy", "cos_doy", "temp2"]
    return d.select("ts", *cols).withColumns(r6("sin_doy", "cos_doy", "temp2"))


@query
def lag_features(spark, sf):
    full = features.prepared(hourly(spark, sf, HK), "y", (1, 24, 168), HK, 3600)
    values = [F.round(c, 6).alias(c) for c in ("y", "lag_1", "lag_24", "lag_168")]
    return full.select(*HK, "ts", *values, F.col("row_no").cast("bigint"))


@query
def dedupe_series(spark, sf):
    """First event of every type in every hour, in the order of arrival."""
    e = table(spark, sf, "events").withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return features.dedupe_first(e, "ts", HK, "event_id").select(*HK, "ts", "user_id", "value")


@query
def part_union(spark, sf):
    """Two overlapping parts of one series read as one."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp"), F.col("value").alias("y"), "event_id")
    half = F.to_timestamp(F.lit("2024-01-16"))
    parts = e.where(F.col("ts") < half + F.expr("interval 2 days")).unionByName(e.where(F.col("ts") >= half))
    out = union_parts(parts, "2024-01-03 00:00:00", "2024-01-28 12:00:00", "event_id")
    return out.select("ts", F.round("y", 6).alias("y"))


@query
def clip_and_recent(spark, sf):
    """Clicks inside the time range of the errors, of the last ten days of these."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pick = lambda t: e.where(F.col("event_type") == t).select("event_id", "ts", "value")
    return features.recent(features.clip_range(pick("click"), pick("error")), 10.0)


@query
def merge_report(spark, sf):
    """Hourly clicks as covariate of hourly purchases, undensified."""
    return _merged(spark, sf)[1].withColumns(r6("overlap_ratio", "overlap_of_larger"))


@query
def contract_merge(spark, sf):
    merged, _ = _merged(spark, sf)
    return merged.select("ts", *[F.round(c, 6).alias(c) for c in ("temp", "y")])


def _merged(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda t: e.where(F.col("event_type") == t)
    cov = features.rollup(pick("click"), "ts", "value", "hour", "avg", out="temp")
    tgt = features.rollup(pick("purchase"), "ts", "value", "hour", "sum")
    return features.merge_target(cov, tgt)


# ---- contracts ---------------------------------------------------------------


@query
def contract_hourly(spark, sf):
    """The series contract on densified hours, which hold by construction."""
    return _contract(hourly(spark, sf, HK), HK)


@query
def contract_raw_hours(spark, sf):
    """The same contract on raw hours with copies: it fails."""
    e = table(spark, sf, "events")
    rolled = features.rollup(e, "ts", "value", "hour", "sum", HK)
    return _contract(rolled.unionByName(rolled.where(F.hour("ts") == 3)), HK)


def _contract(series: DataFrame, keys: list[str]) -> DataFrame:
    rep = contracts.series_report(series, AuditConfig(), ("y",), keys)
    return rep.select(
        *keys, "n", "duplicates", F.round("continuity", 6).alias("continuity"), "off_grid_rows", "status"
    )


@query
def contract_violations(spark, sf):
    """Broken rules of the raw events as rows: off the grid, gaps, copies."""
    e = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp"), F.col("value").alias("y"))
    cfg = AuditConfig()
    v = contracts.series_violations(contracts.series_report(e, cfg, ("y",), HK), cfg, HK)
    return v.withColumn("value", F.round("value", 6))


@query
def ingest_order(spark, sf):
    """Did events arrive in time order, and orders in date order?"""
    e = table(spark, sf, "events").select("event_type", "event_id", F.col("ts").cast("timestamp"))
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("event_type"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    return contracts.is_monotonic(e.unionByName(o), "event_id", "ts", HK)


# ---- split, prediction, scores -----------------------------------------------


@query
def split_ratio(spark, sf):
    full = features.prepared(daily(spark, sf, DK), "y", DAILY.lags, DK, 86400, complete=True)
    return split_spec(full, DK, "ts", (0.60, 0.20))


@query
def split_fixed(spark, sf):
    return split_spec(daily(spark, sf, DK), DK, "ts", dates=("1999-01-01", "2000-06-01"))


@query
def split_periods(spark, sf):
    return period_ranges(daily_split(spark, sf, DK), DK)


@query
def seasonal_naive(spark, sf):
    a = daily_audit(spark, sf, DK)
    return a.select(*DK, "ts", "period", F.round("pred_naive", 6).alias("pred_naive"))


@query
def level_residual(spark, sf):
    d = scoring.residuals(daily_audit(spark, sf, DK), "y", "pred_naive", "pred_naive", DK)
    return d.select(*DK, "ts", *shown("res", "res_naive"))


@query
def gradient_residual(spark, sf):
    d = scoring.residuals(daily_audit(spark, sf, DK), "y", "pred_naive", "pred_naive", DK)
    return d.select(*DK, "ts", *shown("grad_res"))


@query
def threshold_table(spark, sf):
    s = daily_scored(spark, sf, DK)
    t1, t2, t3 = scoring.threshold_tables(s, DAILY.season, DAILY.fallback, keys=DK)
    none = F.lit(None).cast("int")
    parts = [
        t1.withColumn("lv", F.lit(1)),
        t2.withColumns({"lv": F.lit(2), "is_weekend": none}),
        t3.withColumns({"lv": F.lit(3), "month": none, "is_weekend": none}),
    ]
    cols = [*DK, "lv", "month", "is_weekend", "n", "thr_res", "thr_grad_res"]
    out = parts[0].select(cols).unionByName(parts[1].select(cols)).unionByName(parts[2].select(cols))
    return out.select(*cols[:-2], *shown("thr_res", "thr_grad_res"))


@query
def threshold_lookup(spark, sf):
    d = hourly_banded(spark, sf)
    return d.select("ts", "thr_level", *shown("thr_res", "thr_grad_res"))


@query
def scores(spark, sf):
    d = daily_scored(spark, sf, DK)
    return d.select(*DK, "ts", "reason", *shown("s_res", "s_grad", "score"))


@query
def zscore_reference(spark, sf):
    d = decide.zscore_flags(daily_scored(spark, sf, DK), "y", DAILY.with_(z_threshold=1.5), DK)
    return d.select(*DK, "ts", "outlier", *[F.round(c, 6).alias(c) for c in ("mu", "sd", "z")])


# ---- flags and events --------------------------------------------------------


@query
def hysteresis(spark, sf):
    return flagged(spark, sf, DK).select(*DK, "ts", F.col("flag_raw").cast("int").alias("raw"))


@query
def persistence(spark, sf):
    return flagged(spark, sf, DK).select(*DK, "ts", "flag")


@query
def rising_edges(spark, sf):
    f = flagged(spark, sf, DK)
    return f.groupBy(*DK, "period").agg(
        F.sum("flag").cast("bigint").alias("rows_on"), F.sum("flag_edge").cast("bigint").alias("n_events")
    )


#: rows in a block of the queries that have to cross many block borders
SMALL = 64


def _flagged_blocked(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        d = flag_tau(daily_scored(spark, sf, DK), DK)
        keep = ["flag_raw", "flag_edge"]
        return flags.flag_streams(d, {"flag": ("score", "tau")}, 5, 3, 0.98, DK, rows=SMALL, keep=keep)

    return once("daily-flagged-blocked", spark, sf, DK, make)


@query
def hysteresis_blocked(spark, sf):
    """States carried over some forty blocks per series."""
    return _flagged_blocked(spark, sf).select(*DK, "ts", F.col("flag_raw").cast("int").alias("raw"))


@query
def persistence_blocked(spark, sf):
    return _flagged_blocked(spark, sf).select(*DK, "ts", "flag")


@query
def rising_edges_blocked(spark, sf):
    return _flagged_blocked(spark, sf).groupBy(*DK, "period").agg(
        F.sum("flag").cast("bigint").alias("rows_on"), F.sum("flag_edge").cast("bigint").alias("n_events")
    )


@query
def event_sessions_blocked(spark, sf):
    e = flags.events(_flagged_blocked(spark, sf), "flag", DAILY.cooldown_hours, DK, rows=SMALL)
    return e.select(
        *DK, "start", "end", "hours", F.round("peak_score", 6).alias("peak_score"), "reason_major", "action"
    )


@query
def tau_fixed_blocked(spark, sf):
    """The threshold's quantile from parts of a few values each."""
    t = exact_quantiles(_calib(spark, sf), DK, "score", [DAILY.threshold_q], one_run=5)
    return t.select(*DK, F.round(F.col("quantiles")[0], 6).alias("tau_fixed"))


@query
def candidate_counts_blocked(spark, sf):
    c = calibrate.candidate_events(
        _calib(spark, sf), "score", calibrate.settings_grid(DAILY), DAILY.low_ratio, DK, rows=SMALL
    )
    return c.groupBy(*DK, F.col("w_rows").alias("w"), F.col("k_hits").alias("k")).agg(
        F.sum("events").cast("bigint").alias("sum_events"),
        F.max("events").cast("bigint").alias("max_events"),
        F.count_if(F.col("events") > 0).alias("firing"),
    )


def _events(spark, sf, keys):
    return flags.events(flagged(spark, sf, keys), "flag", DAILY.cooldown_hours, keys)


@query
def event_sessions_by_status(spark, sf):
    e = _events(spark, sf, DK)
    return e.select(
        *DK, "start", "end", "hours", F.round("peak_score", 6).alias("peak_score"), "reason_major", "action"
    )


@query
def event_sessions_daily(spark, sf):
    e = _events(spark, sf, [])
    return e.select("start", "end", "hours", F.round("peak_score", 6).alias("peak_score"), "reason_major")


@query
def event_top(spark, sf):
    t = flags.top_event(_events(spark, sf, DK), DK)
    return t.select(*DK, "start", "end", "hours", F.round("peak_score", 6).alias("peak_score"), "reason_major")


# ---- calibration and decision ------------------------------------------------


def _calib(spark, sf):
    return daily_scored(spark, sf, DK).where("period = 'calib'")


@query
def tau_fixed(spark, sf):
    t = calibrate.fixed_tau(_calib(spark, sf), "score", DAILY.threshold_q, DK)
    return t.withColumns(r6("tau_fixed"))


@query
def candidate_counts(spark, sf):
    """Event counts of all 200 candidates under the eight usable settings."""
    c = calibrate.candidate_events(
        _calib(spark, sf), "score", calibrate.settings_grid(DAILY), DAILY.low_ratio, DK
    )
    return c.groupBy(*DK, F.col("w_rows").alias("w"), F.col("k_hits").alias("k")).agg(
        F.sum("events").cast("bigint").alias("sum_events"),
        F.max("events").cast("bigint").alias("max_events"),
        F.count_if(F.col("events") > 0).alias("firing"),
    )


@query
def tau_budget(spark, sf):
    t = calibrate.budget_tau(_calib(spark, sf), "score", BUDGET.with_(k=1), DK)
    return t.select(*DK, F.round("tau_budget", 6).alias("tau_budget"), F.col("events").cast("bigint").alias("events"))


@query
def tune_wk(spark, sf):
    t = calibrate.tune_wk(_calib(spark, sf), "score", BUDGET, DK)
    return t.select(
        *DK, F.col("w_rows").alias("w"), F.col("k_hits").alias("k"), F.round("tau_budget", 6).alias("tau_budget")
    )


@query
def tau_policies(spark, sf):
    t = calibrate.tau_policies(_calib(spark, sf), "score", BUDGET.with_(threshold_q=0.9, cap_ratio=1.05), DK)
    cols = ["tau_fixed", "tau_budget", "tau_sci"]
    return t.select(*DK, *[F.round(c, 6).alias(c) for c in cols], "tau_cap_hit")


#: a low fixed threshold and a tight cap, so that cap and both streams matter
FROZEN = BUDGET.with_(threshold_q=0.9, cap_ratio=1.05)


def _decided(spark, sf):
    def make() -> DataFrame:
        s = daily_scored(spark, sf, DK)
        taus = calibrate.tau_policies(s.where("period = 'calib'"), "score", FROZEN, DK)
        z = decide.zscore_flags(s, "y", FROZEN.with_(z_threshold=1.5), DK)
        return decide.decide_frozen(z, taus, FROZEN, DK)

    return once("daily-frozen", spark, sf, DK, make)


@query
def decide_frozen(spark, sf):
    d = _decided(spark, sf)
    return d.select(
        *DK, "ts", "flag_budget", "flag_sci", "tau_cap_hit", F.round("tau_sci", 6).alias("tau_sci")
    )


@query
def decide_rolling(spark, sf):
    s = daily_scored(spark, sf, DK)
    taus = stage_table(calibrate.tau_policies(s.where("period = 'calib'"), "score", ROLLING, DK), "taus")
    d = decide.decide_rolling(s, taus, ROLLING, DK)
    cols = ["tau_budget", "tau_sci"]
    return d.select(
        *DK, "ts", "flag_budget", "flag_sci", "tau_cap_hit", *[F.round(c, 6).alias(c) for c in cols]
    )


# ---- health and verdict ------------------------------------------------------


@query
def flag_metrics(spark, sf):
    m = health.flag_metrics(_decided(spark, sf), DK)
    rates = ["flag_rate", "outlier_rate", "overlap_both", "flag_only", "outlier_only"]
    return m.withColumns(r6(*rates))


def _with_lag_model(spark, sf):
    """Scored rows with the value of a week ago as the model under test."""
    return daily_scored(spark, sf, DK).withColumn("pred", F.col("lag_7"))


@query
def health_model(spark, sf):
    t = health.health_model(_with_lag_model(spark, sf), "y", DAILY, "pred", "pred_naive", DK)
    return t.withColumns(r6("model_rmse", "naive_rmse", "model_vs_naive_ratio"))


@query
def health_drift(spark, sf):
    t = health.health_drift(_with_lag_model(spark, sf), "y", DAILY, "pred", DK)
    return t.withColumns(r6("rmse_calib", "rmse_recent", "drift_ratio"))


@query
def health_shift(spark, sf):
    t = health.health_shift(daily_scored(spark, sf, DK), DAILY, "score", DK)
    return t.withColumns(r6("q_calib", "q_recent", "shift_ratio"))


@query
def verdict(spark, sf):
    s = _with_lag_model(spark, sf)
    m = metrics_of(s, _decided(spark, sf), "y", DAILY, "pred", DK)
    return health.verdict(m, DAILY).select(*DK, "verdict", "verdict_reason", "one_liner", "next_action", "badge")


# ---- tables and texts against a baseline -------------------------------------


def _fields(df: DataFrame) -> DataFrame:
    return df.withColumns(r6("missing_rate", "mean", "std", "bad_numbers"))


def _orders_text(spark, sf) -> DataFrame:
    """All of orders, dates as text."""
    return table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query
def profile_table(spark, sf):
    return _fields(diff.profile(_orders_text(spark, sf)))


def _customer_pair(spark, sf):
    """customer, and a copy with nulls, broken numbers and a missing column."""
    base = table(spark, sf, "customer")
    key = F.col("c_custkey")
    cur = base.select(
        "c_custkey",
        *[c for c in base.columns if c not in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")],
        F.when(key % 5 != 0, F.col("c_name")).alias("c_name"),
        F.when(key % 7 == 0, "broken").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    )
    return base, cur


@query
def contract_diff(spark, sf):
    base, cur = _customer_pair(spark, sf)
    v = diff.contract_diff(diff.profile(cur), diff.profile(base))
    return v.select("column", "rule", F.round("value", 6).alias("value"))


def _orders_faulted(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o, faults.table_blank(faults.table_rescale(o, ["o_totalprice"], 1.05), "o_orderkey", "o_custkey")


@query
def column_diff(spark, sf):
    base, cur = _orders_faulted(spark, sf)
    d = diff.column_diff(base, cur, ["o_orderkey"])
    return d.withColumns(
        {
            **{c: F.round(c, 2) for c in ("l1_diff", "l1_base")},
            **r6("diff_score", "max_rel_change", "null_rate_delta"),
        }
    )


@query
def column_reasons(spark, sf):
    base, cur = _orders_faulted(spark, sf)
    r = diff.column_reasons(diff.column_diff(base, cur, ["o_orderkey"]), CONFIG["threshold"])
    return r.select("rule_id", "metric", F.round("value", 6).alias("value"), "column")


@query
def null_injection(spark, sf):
    """Null rates of a copy in which pending orders lost their customer."""
    o = _orders_text(spark, sf)
    cur = o.withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    d = diff.column_diff(o, cur, ["o_orderkey"])
    return d.select("column", "null_delta", F.round("null_rate_delta", 6).alias("null_rate_delta"))


@query
def truncation(spark, sf):
    """Row counts after dropping the last lines of the text."""
    base = order_lines(spark, sf)
    cut = faults.truncate(base)
    n = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    both = n(base).select(F.col("n").alias("base_rows"), n(cut).select("n").scalar().alias("cur_rows"))
    return both.withColumn("truncated", diff.truncation(F.col("base_rows"), F.col("cur_rows")))


@query
def token_diff(spark, sf):
    base = order_lines(spark, sf)
    d = diff.token_diff(base, faults.rescale(base))
    return d.withColumns(r6("diff_score", "max_rel_change"))


@query
def token_spike(spark, sf):
    base = order_lines(spark, sf)
    d = diff.token_diff(base, faults.spike(base))
    return diff.token_reasons(d, CONFIG["threshold"]).withColumn("value", F.round("value", 6))


def _doc_lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query
def blank_count(spark, sf):
    """Blank fields per document after every comma of a line was doubled."""
    lines = _doc_lines(spark, sf).withColumn("line", F.regexp_replace("line", ",", ",,"))
    return diff.blank_count(lines, ["doc_id"])


@query
def header_lines(spark, sf):
    h = diff.header_lines(_doc_lines(spark, sf), ["doc_id"], " ")
    return h.select("doc_id", F.col("header_count").cast("bigint"), "n_lines")


@query
def header_digest(spark, sf):
    return diff.header_digest(_doc_lines(spark, sf), ["doc_id"], " ")


@query
def number_tokens(spark, sf):
    """Numbers among the words of each document, and the sum of their magnitudes."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.transform(tokens(F.col("text"), r"\s"), float_token).alias("v")
    )
    num = F.filter("v", lambda x: x.isNotNull())
    total = F.aggregate(num, F.lit(0.0), lambda a, x: a + F.log10(F.abs(x) + 1))
    return d.select("doc_id", F.size(num).cast("bigint").alias("numbers"), F.round(total, 6).alias("magnitude"))


def _orders_exact(spark, sf) -> DataFrame:
    """All of orders, prices and dates as text of a fixed format."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return _orders_text(spark, sf).withColumn("o_totalprice", price)


@query
def row_digest(spark, sf):
    o = _orders_exact(spark, sf)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return o.select("o_orderkey", F.sha2(row_text(cols), 256).alias("sha"))


@query
def digest_tree_changes(spark, sf):
    """Rows that were changed, left out or added, found by the leaves in which two digest trees differ."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    before = _orders_exact(spark, sf).select(*cols)
    no = F.col("o_orderkey")
    status = F.when(no % 997 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    now = before.where(no % 1009 != 1).withColumn("o_orderstatus", status)
    now = now.unionByName(now.where(no % 1013 == 2))
    return changed_rows(before, now)


@query
def table_digests(spark, sf):
    o = _orders_exact(spark, sf)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    return table_digest(o, cols, ["o_orderpriority"])


@query
def circular_shift_hours(spark, sf):
    """The hourly series against itself, rotated by a day."""
    h = _rotated_pair(spark, sf)
    line = F.concat_ws(",", F.hour("ts"), F.round("y", 2).cast("string"))
    moved = h.withColumn("row_no", F.pmod(F.col("row_no") - 24, F.col("n")))
    return circular_shift(h.withColumn("line", line), moved.withColumn("line", line))


def _rotated_pair(spark, sf):
    h = indexed_hourly(spark, sf)
    return attach(h, h.agg(F.count(F.lit(1)).alias("n")), [])


@query
def xcorr_shift(spark, sf):
    h = _rotated_pair(spark, sf)
    moved = h.withColumn("row_no", F.pmod(F.col("row_no") - 24, F.col("n")))
    x = xcorr_lag(h.select("row_no", "y"), moved.select("row_no", "y"), "y")
    return x.select(F.col("shift").cast("bigint"), F.round("corr", 2).alias("corr"))


# ---- runs as a whole ---------------------------------------------------------


def _run(spark, sf):
    series = lambda: daily_split(spark, sf, DK).drop("period")
    files = file_digests(spark, f"{sf}/lineitem.parquet").withColumn("path", F.substring_index("path", "/", -1))
    files = files.withColumn("role", F.lit("target"))
    given = {"label": "lineitem", "files": files, "features": ("lag_1", "lag_7", "lag_28"), "target": "l_quantity"}
    return once("run", spark, sf, DK, lambda: run_audit(series(), ROLLING, DK, **given), False)


@query
def certificate(spark, sf):
    c = _run(spark, sf).certificates
    return c.select(*DK, "certificate_id", "badge", "human_summary.verdict", "content_sha256")


@query
def ledger(spark, sf):
    return _run(spark, sf).ledger.drop("issued_at_utc", "certificate_sha256", "ledger_row_sha256")


@query
def evidence(spark, sf):
    return _run(spark, sf).evidence.withColumns(r6("pred_naive", "res", "score", "tau_sci", "tau_budget"))


@query
def integrity_scenarios(spark, sf):
    return scenario_matrix(order_lines(spark, sf), customer_lines(spark, sf))


@query
def verify_integrity(spark, sf):
    """A clean run verifies; the same certificate over a changed text does not."""
    main = order_lines(spark, sf)
    audit = IntegrityAudit({"orders": main}, CONFIG)
    reasons, cert = audit.run(audit.base, CONFIG, "clean")
    ledger = audit.ledger_entry(cert)
    out = None
    for name, text in (("clean", main), ("spike", faults.spike(main)), ("cut", faults.truncate(main))):
        row = audit.verify(cert, {"orders": text}, reasons, CONFIG, ledger).withColumn("current", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query
def file_fingerprints(spark, sf):
    """Digests of the table files themselves."""
    d = file_digests(spark, f"{sf}/*.parquet")
    return d.select(F.substring_index("path", "/", -1).alias("file"), "bytes", "sha256")


@query
def file_range_digests(spark, sf):
    """Digests of the byte ranges of the table files."""
    d = file_ranges(spark, f"{sf}/*.parquet", 1 << 20)
    return d.select(F.substring_index("path", "/", -1).alias("file"), "bytes", "start", "size", "sha256")


@query
def business_summary(spark, sf):
    return _run(spark, sf).summary.drop("certificate_sha256")


@query
def predict_gbt(spark, sf):
    """A boosted model per table, with early stopping on the calibration period."""
    split = stage_table(add_calendar(daily_split(spark, sf, DK)), "gbt-input")
    names = ["weekday", "is_weekend", "dayofyear", "lag_1", "lag_7", "lag_28"]
    model = predict.fit_predictor(split, names, "y", "gbt", 42, max_iter=10)
    out = predict.predict(model, split.where("period != 'fit'"))
    return out.select(*DK, "ts", "period", "y", F.round("pred", 6).alias("pred"))


@query
def predict_linear(spark, sf):
    split = stage_table(add_calendar(daily_split(spark, sf, DK)), "linear-input")
    names = ["weekday", "is_weekend", "lag_1", "lag_7", "lag_28"]
    model = predict.fit_predictor(split, names, "y", "linear")
    out = predict.predict(model, split.where("period != 'fit'"))
    return out.select(*DK, "ts", "period", "y", F.round("pred", 4).alias("pred"))


@query
def predict_ridge(spark, sf):
    """A model for each series, its penalty chosen on the calibration period."""
    split = stage_table(add_calendar(daily_split(spark, sf, DK)), "ridge-input")
    names = ["weekday", "is_weekend", "dayofyear", "lag_1", "lag_7", "lag_28"]
    out = ridge.predict_ridge(ridge.fit_ridge(split, names, "y", DK), split.where("period != 'fit'"), names, DK)
    return out.select(*DK, "ts", "period", "y", F.round("pred", 4).alias("pred"))


@query
def predict_line(spark, sf):
    """Least squares on the value a week ago, for each series."""
    split = daily_split(spark, sf, DK)
    models = ridge.fit_ridge(split, ["lag_7"], "y", DK, path=(0.0,))
    out = ridge.predict_ridge(models, split.where("period != 'fit'"), ["lag_7"], DK)
    return out.select(*DK, "ts", "period", "y", F.round("pred", 4).alias("pred"))


# ---- streams -----------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def replay(df: DataFrame, cuts: list[str], build, name: str, close: bool = False) -> DataFrame:
    """Feed rows in runs of one stream, cut at the given times; state is carried between the runs."""
    return windows.replay(df, cuts, build, _folder(df.sparkSession, name), close)


@query
def stream_hourly_rollup(spark, sf):
    """All hours of the event stream, fed in three runs and closed at the end."""
    d = table(spark, sf, "events").select(*HK, F.col("ts").cast("timestamp").alias("ts"), "value")
    a, b = d.agg(F.min("ts"), F.max("ts")).first()
    cuts = [str(a + (b - a) * part / 3) for part in (1, 2)]
    out = replay(d, cuts, lambda s: hourly_rollup(s, "ts", "value", HK), "stream-rollup", close=True)
    return out.select(*HK, "ts", F.round("y", 6).alias("y"))


@query
def stream_flags(spark, sf):
    d = flag_tau(daily_scored(spark, sf, DK), DK).select(*DK, "ts", "score", "tau")
    folder = _folder(spark, "stream-flags")
    step = FlagSteps(DAILY, DK, folder)
    cuts = ["1999-10-01", "2000-09-01"]
    out = windows.replay(d, cuts, lambda s: s, folder, step=step, schema=step.schema(d.schema))
    return out.select(*DK, "ts", "flag")


@query
def stream_sessions(spark, sf):
    d = flagged(spark, sf, DK).select(*DK, "ts", "score", "flag")
    build = lambda s: event_sessions(s, "168 hours", DK, "1 hour")
    out = replay(d, ["1999-10-01", "2000-09-01"], build, "stream-sessions", close=True)
    return out.select(*DK, "start", "end", "flagged", F.round("peak_score", 6).alias("peak_score"))


@query
def stream_decide(spark, sf):
    """The rolling decision on a replayed stream."""
    s = daily_scored(spark, sf, DK)
    taus = calibrate.tau_policies(s.where("period = 'calib'"), "score", ROLLING, DK)
    d = attach(s, taus, DK).select(*DK, "ts", "score", "period", "tau_fixed", "tau_budget", "w_rows", "k_hits")
    out = replay(d, ["2000-09-01", "2001-03-01"], lambda x: decide_stream(x, ROLLING, DK), "stream-decide", close=True)
    cols = ["tau_budget", "tau_sci"]
    return out.select(
        *DK, "ts", "flag_budget", "flag_sci", "tau_cap_hit", *[F.round(c, 6).alias(c) for c in cols]
    )
