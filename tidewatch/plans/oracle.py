"""The registered queries once more as plain SQL, written independently of them."""

from __future__ import annotations

import numpy as np

from tidewatch.functions.labels import BADGE, PLAYBOOK, REASON_TEXT

DK = ["l_returnflag", "l_linestatus"]
HK = ["event_type"]
CAND = "[" + ", ".join(repr(float(q)) for q in np.linspace(0.90, 0.999, 200)) + "]"


def cols(keys: list[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def part(keys: list[str]) -> str:
    return f"PARTITION BY {', '.join(keys)} " if keys else ""


def using(keys: list[str], *more: str) -> str:
    names = [*keys, *more]
    return f"USING ({', '.join(names)})" if names else "ON true"


def by(keys: list[str], *more: str) -> str:
    names = [*keys, *more]
    return f"GROUP BY {', '.join(names)}" if names else ""


def rolled(kind: str, keys: list[str]) -> str:
    src, ts, val, unit = {
        "h": ("events", "ts", "value", "hour"),
        "d": ("lineitem", "l_shipdate", "l_quantity", "day"),
    }[kind]
    return (
        f"raw AS (SELECT {cols(keys)}date_trunc('{unit}', {ts})::TIMESTAMP AS ts, "
        f"fsum({val}) AS y FROM {src} GROUP BY ALL)"
    )


def series(kind: str, keys: list[str]) -> str:
    unit = "hour" if kind == "h" else "day"
    ids = f", (SELECT DISTINCT {', '.join(keys)} FROM raw)" if keys else ""
    return f"""{rolled(kind, keys)},
ends AS (SELECT min(ts) AS a, max(ts) AS b FROM raw),
spine AS (SELECT {cols(keys)}unnest(generate_series(a, b, INTERVAL 1 {unit})) AS ts FROM ends{ids}),
s AS (SELECT {cols(keys)}ts, coalesce(raw.y, 0) AS y FROM spine LEFT JOIN raw {using(keys, 'ts')})"""


def prepared(kind: str, keys: list[str], lags: tuple[int, ...]) -> str:
    w = f"OVER ({part(keys)}ORDER BY ts)"
    lagged = ", ".join(f"lag(y, {n}) {w} AS lag_{n}" for n in lags)
    return f"""{series(kind, keys)},
lagged AS (SELECT *, {lagged}, row_number() {w} - 1 AS r0 FROM s),
p AS (SELECT * EXCLUDE (r0), r0 - {max(lags)} AS row_no FROM lagged WHERE r0 >= {max(lags)}),
lim0 AS (SELECT {cols(keys)}count(*) AS n, greatest(1, floor(count(*) * 0.6::DOUBLE))::BIGINT AS f FROM p {by(keys)}),
lim AS (SELECT *, least(greatest(f + 1, floor(n * (0.6::DOUBLE + 0.2::DOUBLE))::BIGINT), n - 1) AS t FROM lim0),
sp AS (SELECT {cols(keys)}min(ts) AS fit_start, min(ts) FILTER (row_no = f) AS calib_start,
  min(ts) FILTER (row_no = t) AS test_start, max(n) AS n FROM p JOIN lim {using(keys)} {by(keys)}),
pp AS (SELECT p.*, CASE WHEN ts < calib_start THEN 'fit' WHEN ts < test_start THEN 'calib' ELSE 'test' END AS period
  FROM p JOIN sp {using(keys)})"""


def scored(kind: str, keys: list[str]) -> str:
    if kind == "d":
        lags, season, fallback = (1, 7, 28), ["month", "is_weekend"], "month"
    else:
        lags, season, fallback = (1, 24, 168), ["band", "is_weekend"], "day"
    w = f"OVER ({part(keys)}ORDER BY ts)"
    sea = ", ".join(season)
    quant = "quantile_cont(res, 0.999) AS q1, quantile_cont(grad_res, 0.999) AS q2"
    return f"""{prepared(kind, keys, lags)},
a AS (SELECT *, row_no - min(row_no) OVER ({part(keys)}) AS i, month(ts)::INT AS month,
  (isodow(ts) >= 6)::INT AS is_weekend, (hour(ts) // 6)::INT AS band, day(ts)::INT AS day FROM pp WHERE period <> 'fit'),
m1 AS (SELECT {cols(keys)}{sea}, avg(y) AS m1 FROM a WHERE period = 'calib' GROUP BY {cols(keys)}{sea}),
m2 AS (SELECT {cols(keys)}avg(y) AS m2 FROM a WHERE period = 'calib' {by(keys)}),
nv AS (SELECT a.*, coalesce(m1, m2) AS pred_naive FROM a LEFT JOIN m1 {using(keys, *season)} LEFT JOIN m2 {using(keys)}),
df AS (SELECT *, y - lag(y, 1, y) {w} AS dy, pred_naive - lag(pred_naive, 1, pred_naive) {w} AS dp FROM nv),
fl AS (SELECT {cols(keys)}quantile_cont(y, 0.5) AS y0, quantile_cont(CASE WHEN i > 0 THEN abs(dy) END, 0.5) AS d0
  FROM df WHERE period = 'calib' {by(keys)}),
r AS (SELECT df.*, abs(y - pred_naive) / (greatest(y, y0) + 1e-9) AS res,
  abs(dy - dp) / (greatest(abs(dy), d0) + 1e-9) AS grad_res FROM df JOIN fl {using(keys)}),
t1 AS (SELECT {cols(keys)}{sea}, count(*) AS n, {quant} FROM r WHERE period = 'calib' GROUP BY {cols(keys)}{sea}),
t2 AS (SELECT {cols(keys)}{fallback}, count(*) AS n, {quant} FROM r WHERE period = 'calib' GROUP BY {cols(keys)}{fallback}),
t3 AS (SELECT {cols(keys)}count(*) AS n, {quant} FROM r WHERE period = 'calib' {by(keys)}),
t1f AS (SELECT {cols(keys)}{sea}, q1 AS a1, q2 AS a2 FROM t1 WHERE n >= 6),
t2f AS (SELECT {cols(keys)}{fallback}, q1 AS b1, q2 AS b2 FROM t2),
t3f AS (SELECT {cols(keys)}q1 AS c1, q2 AS c2 FROM t3),
l AS (SELECT r.*, coalesce(a1, b1, c1) AS thr_res, coalesce(a2, b2, c2) AS thr_grad_res,
  CASE WHEN a1 IS NOT NULL THEN 1 WHEN b1 IS NOT NULL THEN 2 ELSE 3 END AS thr_level FROM r
  LEFT JOIN t1f {using(keys, *season)} LEFT JOIN t2f {using(keys, fallback)} LEFT JOIN t3f {using(keys)}),
sc0 AS (SELECT *, res / (thr_res + 1e-9) AS s_res, grad_res / (thr_grad_res + 1e-9) AS s_grad FROM l),
sc AS (SELECT *, greatest(s_res, s_grad) AS score,
  CASE WHEN s_res >= s_grad THEN 'LEVEL_RESIDUAL' ELSE 'SHAPE_GRAD' END AS reason FROM sc0)"""


def stream(src: str, out: str, keys: list[str], score: str, tau: str, name: str, w: int = 5, k: int = 3, order: str = "ts") -> str:
    """CTEs ``out`` = ``src`` + name_raw, name, name_edge."""
    win = f"{part(keys)}ORDER BY {order}"
    return f"""{out}_e AS (SELECT *, CASE WHEN {score} > {tau} THEN 1 WHEN {score} < {tau} * 0.98::DOUBLE THEN 0 END AS ev FROM {src}),
{out}_r AS (SELECT * EXCLUDE (ev), coalesce(last_value(ev IGNORE NULLS) OVER ({win} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {name}_raw FROM {out}_e),
{out}_f AS (SELECT *, (sum({name}_raw) OVER ({win} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) >= {k})::INT AS {name} FROM {out}_r),
{out} AS (SELECT *, ({name} = 1 AND lag({name}, 1, 0) OVER ({win}) = 0)::INT AS {name}_edge FROM {out}_f)"""


def flagged(keys: list[str]) -> str:
    return f"""{scored('d', keys)},
tq AS (SELECT {cols(keys)}quantile_cont(score, 0.9) AS tau FROM sc WHERE period = 'calib' {by(keys)}),
sct AS (SELECT sc.*, tau FROM sc JOIN tq {using(keys)}),
{stream('sct', 'f', keys, 'score', 'tau', 'flag')}"""


def events(keys: list[str]) -> str:
    w = f"OVER ({part(keys)}ORDER BY ts)"
    same = "".join(f" AND f.{k} = x.{k}" for k in keys)
    xk = "".join(f"x.{k}, " for k in keys)
    return f"""{flagged(keys)},
g AS (SELECT *, CASE WHEN lag(i) {w} IS NULL OR (i <> lag(i) {w} + 1
  AND epoch(ts) - epoch(lag(ts) {w}) > 168 * 3600) THEN 1 ELSE 0 END AS fresh FROM f WHERE flag = 1),
g2 AS (SELECT *, sum(fresh) {w} AS ev FROM g),
x AS (SELECT {cols(keys)}ev, min(i) AS i0, max(i) AS i1 FROM g2 GROUP BY {cols(keys)}ev),
seg AS (SELECT {xk}x.ev, f.i, f.ts, f.score, f.reason FROM x JOIN f ON f.i BETWEEN x.i0 AND x.i1{same}),
rc AS (SELECT {cols(keys)}ev, reason, count(*) AS c, min(i) AS i0 FROM seg GROUP BY {cols(keys)}ev, reason),
rm AS (SELECT {cols(keys)}ev, reason AS reason_major FROM rc
  QUALIFY row_number() OVER (PARTITION BY {cols(keys)}ev ORDER BY c DESC, i0) = 1),
ev AS (SELECT {cols(keys)}ev, min(i) AS i0, min(ts) AS "start", max(ts) AS "end", count(*) AS hours,
  max(score) AS peak_score FROM seg GROUP BY {cols(keys)}ev),
evs AS (SELECT * FROM ev JOIN rm {using(keys, 'ev')})"""


def candidates(settings: list[tuple[int, int]], need_rows: bool = True) -> str:
    """``cc``: event counts per key, candidate and setting on calibration scores."""
    k = ", ".join(DK)
    w = f"PARTITION BY {k}, ci ORDER BY ts"
    sums = ", ".join(
        f"sum(raw) OVER ({w} ROWS BETWEEN {x - 1} PRECEDING AND CURRENT ROW) AS s{x}" for x in sorted({a for a, _ in settings})
    )
    flags = ", ".join(f"(s{a} >= {b})::INT AS f_{a}_{b}" for a, b in settings)
    edges = ", ".join(f"(f_{a}_{b} = 1 AND lag(f_{a}_{b}, 1, 0) OVER ({w}) = 0)::INT AS e_{a}_{b}" for a, b in settings)
    counts = " UNION ALL ".join(
        f"SELECT {k}, ci, tau, {a} AS w, {b} AS k, sum(e_{a}_{b}) AS events, count(*) AS n FROM c5 GROUP BY {k}, ci, tau"
        for a, b in settings
    )
    return f"""{scored('d', DK)},
cal AS (SELECT {k}, ts, score FROM sc WHERE period = 'calib'),
ql AS (SELECT {k}, quantile_cont(score, {CAND}) AS ql FROM cal GROUP BY {k}),
qs AS (SELECT {k}, unnest(range(200)) AS ci, unnest(ql) AS tau FROM ql),
c1 AS (SELECT cal.*, ci, tau, CASE WHEN score > tau THEN 1 WHEN score < tau * 0.98::DOUBLE THEN 0 END AS e FROM cal JOIN qs USING ({k})),
c2 AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS raw FROM c1),
c3 AS (SELECT *, {sums} FROM c2),
c4 AS (SELECT *, {flags} FROM c3),
c5 AS (SELECT *, {edges} FROM c4),
cc AS ({counts})"""


def budget(settings: list[tuple[int, int]], per: float) -> str:
    """``bt``: the chosen candidate per key and setting."""
    k = ", ".join(DK)
    return f"""{candidates(settings)},
mx AS (SELECT {k}, max(score) AS top FROM cal GROUP BY {k}),
bt0 AS (SELECT {k}, w, k, max(n) AS n, max(ci) FILTER (events <= {per}::DOUBLE * (n / 168.0::DOUBLE)) AS ci FROM cc GROUP BY {k}, w, k),
bt AS (SELECT {", ".join("bt0." + c for c in DK)}, bt0.w, bt0.k, coalesce(cc.tau, top) AS tau_budget, coalesce(cc.events, 0)::BIGINT AS events
  FROM bt0 JOIN mx USING ({k}) LEFT JOIN cc ON cc.ci = bt0.ci AND cc.w = bt0.w AND cc.k = bt0.k
  AND {" AND ".join(f"cc.{c} = bt0.{c}" for c in DK)})"""


SETTINGS = [(w, k) for w in (3, 5, 7) for k in (2, 3, 4) if k <= w]


def policies(cap: float) -> str:
    k = ", ".join(DK)
    return f"""{budget([(5, 3)], 2.0)},
tf AS (SELECT {k}, quantile_cont(score, 0.9) AS tau_fixed FROM cal GROUP BY {k}),
pol AS (SELECT {k}, tau_fixed, tau_budget, least(tau_budget, tau_fixed * {cap}::DOUBLE) AS tau_sci,
  (tau_budget > tau_fixed * {cap}::DOUBLE)::INT AS tau_cap_hit FROM bt JOIN tf USING ({k}))"""


def zscores(src: str = "sc") -> str:
    k = ", ".join(DK)
    stat = "count(*) AS n, avg(y) AS mu, stddev_pop(y) AS sd"
    return f"""z1 AS (SELECT {k}, month, is_weekend, {stat} FROM {src} WHERE period = 'calib' GROUP BY {k}, month, is_weekend),
z2 AS (SELECT {k}, month, {stat} FROM {src} WHERE period = 'calib' GROUP BY {k}, month),
z3 AS (SELECT {k}, {stat} FROM {src} WHERE period = 'calib' GROUP BY {k}),
zz AS (SELECT {src}.*, CASE WHEN z1.n >= 6 AND z1.sd > 0 THEN z1.mu WHEN z2.n >= 6 AND z2.sd > 0 THEN z2.mu ELSE z3.mu END AS mu,
  greatest(CASE WHEN z1.n >= 6 AND z1.sd > 0 THEN z1.sd WHEN z2.n >= 6 AND z2.sd > 0 THEN z2.sd ELSE z3.sd END, 1e-9) AS sd
  FROM {src} LEFT JOIN z1 USING ({k}, month, is_weekend) LEFT JOIN z2 USING ({k}, month) JOIN z3 USING ({k})),
zv AS (SELECT *, abs(y - mu) / (sd + 1e-9) AS z FROM zz),
{stream('zv', 'zf', DK, 'z', '1.5::DOUBLE', 'outlier')}"""


def frozen() -> str:
    k = ", ".join(DK)
    return f"""{policies(1.05)},
{zscores()},
dt AS (SELECT zf.*, tau_fixed, tau_budget, tau_sci, tau_cap_hit FROM zf JOIN pol USING ({k}) WHERE period = 'test'),
{stream('dt', 'db', DK, 'score', 'tau_budget', 'flag_budget')},
{stream('db', 'dd', DK, 'score', 'tau_sci', 'flag_sci')}"""


def metrics() -> str:
    k = ", ".join(DK)
    w = f"OVER (PARTITION BY {k} ORDER BY ts)"
    edge = lambda c: f"({c} = 1 AND lag({c}, 1, 0) {w} = 0)::INT AS {c}_e"
    return f"""{frozen()},
du AS (SELECT *, (flag_sci = 1 AND flag_budget = 0)::INT AS suppressed FROM dd),
de AS (SELECT *, {edge('suppressed')}, {edge('outlier')}, {edge('flag_sci')}, {edge('flag_budget')} FROM du),
fm AS (SELECT {k}, count(DISTINCT CASE WHEN tau_cap_hit = 1 THEN ts::DATE END) AS cap_hit_days,
  sum(tau_cap_hit)::BIGINT AS cap_hit_hours, avg(flag_sci) AS flag_rate, sum(flag_sci_e)::BIGINT AS flag_events,
  sum(flag_budget_e)::BIGINT AS flag_events_budget, sum(suppressed)::BIGINT AS suppressed_hours,
  sum(suppressed_e)::BIGINT AS suppressed_events, avg(outlier) AS outlier_rate, sum(outlier_e)::BIGINT AS outlier_events,
  avg((flag_sci = 1 AND outlier = 1)::INT) AS overlap_both, avg((flag_sci = 1 AND outlier = 0)::INT) AS flag_only,
  avg((flag_sci = 0 AND outlier = 1)::INT) AS outlier_only FROM de GROUP BY {k})"""


def health_parts() -> str:
    k = ", ".join(DK)
    return f"""hx AS (SELECT *, lag_7 AS pred, max(ts) FILTER (period = 'test') OVER (PARTITION BY {k}) AS last FROM sc),
hy AS (SELECT *, (period = 'test' AND ts >= last - INTERVAL 14 DAY) AS rec FROM hx),
hm AS (SELECT {k}, sqrt(avg((y - pred) ** 2)) AS model_rmse, sqrt(avg((y - pred_naive) ** 2)) AS naive_rmse
  FROM hy WHERE period = 'test' GROUP BY {k}),
hd AS (SELECT {k}, sqrt(avg((y - pred) ** 2) FILTER (period = 'calib')) AS rmse_calib,
  sqrt(avg((y - pred) ** 2) FILTER (rec)) AS rmse_recent FROM hy GROUP BY {k}),
hs AS (SELECT {k}, quantile_cont(CASE WHEN period = 'calib' THEN score END, 0.95) AS q_calib,
  quantile_cont(CASE WHEN rec THEN score END, 0.95) AS q_recent FROM hy GROUP BY {k})"""


def choose(col: str, table: dict[str, str]) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {col} {arms} END"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def shown(*names: str) -> str:
    return ", ".join(big(n, n) for n in names)


def big(expr: str, name: str) -> str:
    return f"CASE WHEN abs({expr}) < 1e6 THEN round({expr}, 6) ELSE round({expr} / 1e6::DOUBLE, 3) * 1e6::DOUBLE END AS {name}"


def oracle() -> dict[str, str]:
    k = ", ".join(DK)
    q: dict[str, str] = {}
    q["hourly_series"] = f"WITH {series('h', [])} SELECT ts, round(y, 6) AS y FROM s"
    q["hourly_series_by_type"] = f"WITH {series('h', HK)} SELECT event_type, ts, round(y, 6) AS y FROM s"
    q["daily_series_by_status"] = f"WITH {series('d', DK)} SELECT {k}, ts, round(y, 6) AS y FROM s"
    q["calendar_features"] = f"""WITH {series('h', [])} SELECT ts, hour(ts)::INT AS hour, dayofyear(ts)::INT AS dayofyear,
(isodow(ts) - 1)::INT AS weekday, (isodow(ts) >= 6)::INT AS is_weekend, round(sin(2 * pi() * dayofyear(ts) / 366.0), 6) AS sin_doy,
round(cos(2 * pi() * dayofyear(ts) / 366.0), 6) AS cos_doy, round(y * y, 6) AS temp2 FROM s"""
    q["lag_features"] = f"WITH {prepared('h', HK, (1, 24, 168))} SELECT event_type, ts, round(y, 6) AS y, round(lag_1, 6) AS lag_1, round(lag_24, 6) AS lag_24, round(lag_168, 6) AS lag_168, row_no FROM p"
    q["dedupe_series"] = """SELECT event_type, date_trunc('hour', ts) AS ts, user_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) = 1"""
    q["part_union"] = """WITH o AS (SELECT ts, value FROM events QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1)
SELECT date_trunc('hour', ts) AS ts, round(fsum(value) / count(value), 6) AS y
FROM o WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 12:00:00' GROUP BY 1"""
    q["clip_and_recent"] = """WITH e AS (SELECT min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'error'),
c AS (SELECT event_id, ts, value FROM events, e WHERE event_type = 'click' AND ts BETWEEN a AND b)
SELECT event_id, ts, value FROM c WHERE floor(epoch(ts)) >= (SELECT floor(epoch(max(ts))) FROM c) - 864000"""
    mrg = """cv AS (SELECT date_trunc('hour', ts) AS ts, fsum(value) / count(value) AS temp
FROM events WHERE event_type = 'click' GROUP BY 1),
tg AS (SELECT date_trunc('hour', ts) AS ts, fsum(value) AS y
FROM events WHERE event_type = 'purchase' GROUP BY 1),
mg AS (SELECT ts, temp, y FROM cv JOIN tg USING (ts))"""
    q["contract_merge"] = f"WITH {mrg} SELECT ts, round(temp, 6) AS temp, round(y, 6) AS y FROM mg"
    q["merge_report"] = f"""WITH {mrg}, n AS (SELECT (SELECT count(*) FROM cv) AS covariate_rows,
(SELECT count(*) FROM tg) AS target_rows, (SELECT count(*) FROM mg) AS merged_rows)
SELECT *, round(merged_rows / greatest(1, least(covariate_rows, target_rows))::DOUBLE, 6) AS overlap_ratio,
round(merged_rows / greatest(covariate_rows, target_rows)::DOUBLE, 6) AS overlap_of_larger, 'inner' AS merge_how FROM n"""
    rep = """x AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS gap FROM src),
rp AS (SELECT event_type, count(*) AS n, count(*) - count(DISTINCT ts) AS duplicates,
count(*) FILTER (gap = 3600) / (count(*) - 1)::DOUBLE AS continuity,
count(*) FILTER (minute(ts) <> 0 OR floor(second(ts)) <> 0) AS off_grid_rows FROM x GROUP BY event_type)"""
    final = """SELECT event_type, n, duplicates, round(continuity, 6) AS continuity, off_grid_rows,
CASE WHEN duplicates = 0 AND off_grid_rows = 0 AND continuity >= 0.98 THEN 'PASS' ELSE 'FAIL' END AS status FROM rp"""
    q["contract_hourly"] = f"WITH {series('h', HK)}, src AS (SELECT * FROM s), {rep} {final}"
    q["contract_raw_hours"] = f"WITH {rolled('h', HK)}, src AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE hour(ts) = 3), {rep} {final}"
    q["contract_violations"] = f"""WITH src AS (SELECT event_type, ts FROM events), {rep}
SELECT event_type, 'duplicates' AS rule_id, round(duplicates::DOUBLE, 6) AS value FROM rp WHERE duplicates > 0
UNION ALL SELECT event_type, 'grid', round(off_grid_rows::DOUBLE, 6) FROM rp WHERE off_grid_rows > 0
UNION ALL SELECT event_type, 'continuity', round(continuity, 6) FROM rp WHERE continuity < 0.98"""
    q["ingest_order"] = """WITH e AS (SELECT event_type, event_id, ts FROM events
UNION ALL SELECT o_orderpriority, o_orderkey, o_orderdate FROM orders),
x AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS pt FROM e)
SELECT event_type, count(*) FILTER (pt > ts) = 0 AS monotonic FROM x GROUP BY event_type"""
    q["split_ratio"] = f"WITH {prepared('d', DK, (1, 7, 28))} SELECT {k}, 'dynamic_ratio' AS split_type, fit_start, calib_start, test_start, n FROM sp"
    q["split_fixed"] = f"""WITH {series('d', DK)} SELECT {k}, 'fixed_date' AS split_type, min(ts) AS fit_start,
TIMESTAMP '1999-01-01' AS calib_start, TIMESTAMP '2000-06-01' AS test_start, count(*) AS n FROM s GROUP BY {k}"""
    q["split_periods"] = f"WITH {prepared('d', DK, (1, 7, 28))} SELECT {k}, period, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM pp GROUP BY {k}, period"
    d = scored("d", DK)
    q["seasonal_naive"] = f"WITH {d} SELECT {k}, ts, period, {r6('pred_naive')} FROM nv"
    q["predict_line"] = f"""WITH {prepared('d', DK, (1, 7, 28))},
m AS (SELECT {k}, regr_slope(y, lag_7) AS a, regr_intercept(y, lag_7) AS b FROM pp WHERE period = 'fit' GROUP BY {k})
SELECT {k}, ts, period, y, round(b + a * lag_7, 4) AS pred FROM pp JOIN m USING ({k}) WHERE period <> 'fit'"""
    q["level_residual"] = f"WITH {d} SELECT {k}, ts, {shown('res')}, {big('res', 'res_naive')} FROM r"
    q["gradient_residual"] = f"WITH {d} SELECT {k}, ts, {shown('grad_res')} FROM r"
    thr = f"{big('q1', 'thr_res')}, {big('q2', 'thr_grad_res')}"
    q["threshold_table"] = f"""WITH {d} SELECT {k}, 1 AS lv, month, is_weekend, n, {thr} FROM (SELECT * REPLACE (CASE WHEN n >= 6 THEN q1 END AS q1, CASE WHEN n >= 6 THEN q2 END AS q2) FROM t1)
UNION ALL SELECT {k}, 2, month, NULL, n, {thr} FROM t2 UNION ALL SELECT {k}, 3, NULL, NULL, n, {thr} FROM t3"""
    q["threshold_lookup"] = f"WITH {scored('h', [])} SELECT ts, thr_level, {shown('thr_res', 'thr_grad_res')} FROM l"
    q["scores"] = f"WITH {d} SELECT {k}, ts, reason, {shown('s_res', 's_grad', 'score')} FROM sc"
    q["zscore_reference"] = f"WITH {d}, {zscores()} SELECT {k}, ts, outlier, {r6('mu', 'sd', 'z')} FROM zf"
    q["hysteresis"] = f"WITH {flagged(DK)} SELECT {k}, ts, flag_raw::INT AS raw FROM f"
    q["persistence"] = f"WITH {flagged(DK)} SELECT {k}, ts, flag FROM f"
    q["rising_edges"] = f"WITH {flagged(DK)} SELECT {k}, period, sum(flag)::BIGINT AS rows_on, sum(flag_edge)::BIGINT AS n_events FROM f GROUP BY {k}, period"
    steps = choose("reason_major", {r: " / ".join(t[:3]) for r, t in PLAYBOOK.items()})
    q["event_sessions_by_status"] = f"""WITH {events(DK)} SELECT {k}, "start", "end", hours, {r6('peak_score')}, reason_major, {steps} AS action FROM evs"""
    q["event_sessions_daily"] = f"""WITH {events([])} SELECT "start", "end", hours, {r6('peak_score')}, reason_major FROM evs"""
    q["event_top"] = f"""WITH {events(DK)} SELECT {k}, "start", "end", hours, {r6('peak_score')}, reason_major FROM evs
QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY evs.peak_score DESC, i0) = 1"""
    q["tau_fixed"] = f"WITH {d} SELECT {k}, round(quantile_cont(score, 0.999), 6) AS tau_fixed FROM sc WHERE period = 'calib' GROUP BY {k}"
    q["candidate_counts"] = f"""WITH {candidates(SETTINGS)} SELECT {k}, w, k, sum(events)::BIGINT AS sum_events,
max(events)::BIGINT AS max_events, count(*) FILTER (events > 0) AS firing FROM cc GROUP BY {k}, w, k"""
    q["tau_budget"] = f"WITH {budget([(5, 1)], 2.0)} SELECT {k}, {r6('tau_budget')}, events FROM bt"
    q["tune_wk"] = f"""WITH {budget(SETTINGS, 2.0)} SELECT {k}, w, k, {r6('tau_budget')} FROM bt
QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY bt.tau_budget, w, k) = 1"""
    q["tau_policies"] = f"WITH {policies(1.05)} SELECT {k}, {r6('tau_fixed', 'tau_budget', 'tau_sci')}, tau_cap_hit FROM pol"
    q["decide_frozen"] = f"WITH {frozen()} SELECT {k}, ts, flag_budget, flag_sci, tau_cap_hit, {r6('tau_sci')} FROM dd"
    rates = ("flag_rate", "outlier_rate", "overlap_both", "flag_only", "outlier_only")
    q["flag_metrics"] = f"WITH {metrics()} SELECT * EXCLUDE ({', '.join(rates)}), {r6(*rates)} FROM fm"
    h = f"{d}, {health_parts()}"
    q["health_model"] = f"""WITH {h} SELECT {k}, {r6('model_rmse', 'naive_rmse')}, round(model_rmse / greatest(naive_rmse, 1e-9), 6) AS model_vs_naive_ratio,
(model_rmse / greatest(naive_rmse, 1e-9) > 1.05)::INT AS model_underperform FROM hm"""
    q["health_drift"] = f"""WITH {h} SELECT {k}, {r6('rmse_calib', 'rmse_recent')}, round(rmse_recent / greatest(rmse_calib, 1e-9), 6) AS drift_ratio,
(rmse_recent / greatest(rmse_calib, 1e-9) > 1.25)::INT AS drift_alert FROM hd"""
    q["health_shift"] = f"""WITH {h} SELECT {k}, {r6('q_calib', 'q_recent')}, round(q_recent / greatest(q_calib, 1e-9), 6) AS shift_ratio,
(q_recent / greatest(q_calib, 1e-9) > 1.25)::INT AS shift_alert FROM hs"""
    q["verdict"] = f"""WITH {metrics()}, {health_parts()},
v AS (SELECT {k}, CASE WHEN cap_hit_days > 0 THEN 'TAU_CAP_HIT' WHEN model_rmse / greatest(naive_rmse, 1e-9) > 1.05 THEN 'BEACON_UNDERPERFORM'
WHEN rmse_recent / greatest(rmse_calib, 1e-9) > 1.25 THEN 'MODEL_DRIFT' WHEN q_recent / greatest(q_calib, 1e-9) > 1.25 THEN 'SCORE_SHIFT'
ELSE 'BASELINE_STABLE' END AS verdict_reason FROM fm JOIN hm USING ({k}) JOIN hd USING ({k}) JOIN hs USING ({k})),
u AS (SELECT *, CASE WHEN verdict_reason = 'BASELINE_STABLE' THEN 'OK' ELSE 'NG' END AS verdict FROM v)
SELECT {k}, verdict, verdict_reason, {choose('verdict_reason', {a: b[0] for a, b in REASON_TEXT.items()})} AS one_liner,
{choose('verdict_reason', {a: b[1] for a, b in REASON_TEXT.items()})} AS next_action, {choose('verdict', BADGE)} AS badge FROM u"""

    def prof(src: str, names: list[str], numeric: list[str]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls, "
            f"round(avg(({c} IS NULL)::INT), 6) AS missing_rate, {str(c in numeric).lower()} AS is_numeric, "
            + (f"round(avg({c}), 6)::DOUBLE AS mean, round(stddev_samp({c}), 6)::DOUBLE AS std, " if c in numeric else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, ")
            + f"round(avg((try_cast({c}::VARCHAR AS DOUBLE) IS NULL)::INT), 6) AS bad_numbers FROM {src}"
            for c in names
        )

    q["profile_table"] = prof(
        "(SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders)",
        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"],
        ["o_orderkey", "o_custkey", "o_totalprice"],
    )
    q["contract_diff"] = """WITH c AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name,
CASE WHEN c_custkey % 7 = 0 THEN 'broken' ELSE c_acctbal::VARCHAR END AS c_acctbal FROM customer),
b AS (SELECT avg((c_name IS NULL)::INT) AS bn, avg((c_acctbal IS NULL)::INT) AS ba FROM customer),
m AS (SELECT avg((c_name IS NULL)::INT) AS cn, avg((try_cast(c_acctbal AS DOUBLE) IS NULL)::INT) AS ca FROM c)
SELECT 'c_mktsegment' AS "column", 'missing_column' AS rule, 1.0::DOUBLE AS value
UNION ALL SELECT 'c_name', 'missing_rate', round(cn - bn, 6) FROM b, m WHERE cn - bn > 0.10
UNION ALL SELECT 'c_acctbal', 'numeric_corruption', round(ca - ba, 6) FROM b, m WHERE ca - ba > 0.05"""
    flt = """cur AS (SELECT o_orderkey, CASE WHEN o_orderkey <> (SELECT min(o_orderkey) FROM orders) THEN o_custkey END AS o_custkey,
o_totalprice * 1.05::DOUBLE AS o_totalprice FROM orders)"""

    def cdiff(base: str, cur: str, names: list[str], numeric: list[str]) -> str:
        def one(c: str) -> str:
            x = f"coalesce(b.{c}, 0)::DOUBLE" if c in numeric else "0.0::DOUBLE"
            y = f"coalesce(c.{c}, 0)::DOUBLE" if c in numeric else "0.0::DOUBLE"
            return f"""SELECT '{c}' AS "column", count(*) AS n_rows, sum(abs({y} - {x})) AS l1_diff, sum(abs({x})) AS l1_base,
max(abs({y} - {x}) / greatest(abs({x}), 1e-9)) AS max_rel_change,
count(*) FILTER (c.{c} IS NULL) - count(*) FILTER (b.{c} IS NULL) AS null_delta FROM {base} b JOIN {cur} c USING (o_orderkey)"""

        return "cd AS (" + " UNION ALL ".join(one(c) for c in names) + ")"

    two = cdiff("orders", "cur", ["o_custkey", "o_totalprice"], ["o_custkey", "o_totalprice"])
    q["column_diff"] = f"""WITH {flt}, {two} SELECT "column", n_rows, round(l1_diff, 2) AS l1_diff, round(l1_base, 2) AS l1_base,
round(l1_diff / l1_base, 6) AS diff_score, round(max_rel_change, 6) AS max_rel_change, null_delta,
round(null_delta / n_rows::DOUBLE, 6) AS null_rate_delta FROM cd"""
    q["column_reasons"] = f"""WITH {flt}, {two}
SELECT 'local_spike_detected' AS rule_id, 'max_rel_change' AS metric, round(max_rel_change, 6) AS value, "column" FROM cd WHERE max_rel_change >= 0.08
UNION ALL SELECT 'near_threshold_perturbation', 'l1_diff_score', round(l1_diff / l1_base, 6), "column" FROM cd
  WHERE l1_diff > 0 AND abs(l1_diff / l1_base - 0.05) <= 0.01
UNION ALL SELECT 'missing_injection_detected', 'null_rate_delta', round(null_delta / n_rows::DOUBLE, 6), "column" FROM cd
  WHERE null_delta / n_rows::DOUBLE > 0.001"""
    q["null_injection"] = """WITH cur AS (SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey FROM orders)
SELECT 'o_custkey' AS "column", count(*) FILTER (o_custkey IS NULL) AS null_delta,
round(count(*) FILTER (o_custkey IS NULL) / count(*)::DOUBLE, 6) AS null_rate_delta FROM cur
UNION ALL SELECT unnest(['o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']), 0, 0.0"""
    q["truncation"] = "SELECT count(*) + 1 AS base_rows, count(*) - 4 AS cur_rows, count(*) - 4 > 0 AND count(*) - 4 < count(*) + 1 AS truncated FROM orders"
    toks = """t AS (SELECT o_orderkey, unnest([o_totalprice, o_custkey::DOUBLE, o_orderkey::DOUBLE]) AS x,
unnest([2, 0, 0]) AS p FROM orders),
u AS (SELECT x, round(x * 1.05::DOUBLE, 3) AS y FROM t)"""
    q["token_diff"] = f"""WITH {toks} SELECT round(sum(abs(y - x)) / sum(abs(x)), 6) AS diff_score, count(*) FILTER (y <> x) AS changed_tokens,
round(max(abs(y - x) / CASE WHEN abs(x) < 1e-9 THEN 1 ELSE abs(x) END), 6) AS max_rel_change FROM u"""
    q["token_spike"] = """WITH o AS (SELECT o_totalprice AS x, round(o_totalprice * 1.15::DOUBLE, 2) AS y FROM orders ORDER BY o_orderkey LIMIT 1)
SELECT 'local_spike_detected' AS rule_id, 'max_rel_change' AS metric, round(abs(y - x) / x, 6) AS value FROM o"""
    lines = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"""
    # runs of commas are doubled, so a run of n commas holds n pairs of neighbours
    q["blank_count"] = f"""WITH {lines} SELECT doc_id, sum(length(line) - length(replace(line, ',', '')))::BIGINT AS blank_fields FROM l GROUP BY doc_id"""
    num = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    has = f"len(list_filter(string_split(line, ' '), lambda x: regexp_matches(trim(x), '{num}'))) > 0"
    q["header_lines"] = f"""WITH {lines} SELECT doc_id, coalesce(min(line_no) FILTER ({has}), max(line_no) + 1)::BIGINT AS header_count,
count(*) AS n_lines FROM l GROUP BY doc_id"""
    q["header_digest"] = f"""WITH {lines}, hc AS (SELECT doc_id, coalesce(min(line_no) FILTER ({has}), max(line_no) + 1) AS c FROM l GROUP BY doc_id),
hl AS (SELECT doc_id, line_no, line, min(line_no) FILTER (regexp_matches(line, '\\S')) OVER w AS a,
  max(line_no) FILTER (regexp_matches(line, '\\S')) OVER w AS b FROM l JOIN hc USING (doc_id) WHERE line_no < c WINDOW w AS (PARTITION BY doc_id)),
ch AS (SELECT doc_id, (line_no - a) // 4096 AS n, sha256(string_agg(regexp_replace(CASE WHEN line_no = a THEN regexp_replace(line, '^\\s+', '') ELSE line END, '\\s+$', ''), chr(10) ORDER BY line_no)) AS h
  FROM hl WHERE line_no BETWEEN a AND b GROUP BY doc_id, n),
hs AS (SELECT doc_id, sha256(string_agg(h, chr(10) ORDER BY n)) AS s FROM ch GROUP BY doc_id)
SELECT doc_id, coalesce(s, sha256('')) AS header_sha FROM (SELECT DISTINCT doc_id FROM l) LEFT JOIN hs USING (doc_id)"""
    q["number_tokens"] = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s'), lambda x: regexp_matches(trim(x), '{num}')) AS v FROM documents)
SELECT doc_id, len(v)::BIGINT AS numbers, round(coalesce(list_sum(list_transform(v, lambda x: log10(abs(x::DOUBLE) + 1))), 0), 6) AS magnitude FROM w"""
    fld = lambda c: f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    price, day = "o_totalprice::DECIMAL(18,2)", "strftime(o_orderdate, '%Y-%m-%d')"
    row = " || '|' || ".join(fld(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", price, day, "o_orderpriority"))
    q["row_digest"] = f"SELECT o_orderkey, sha256({row}) AS sha FROM orders"
    row3 = " || '|' || ".join(fld(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", price, day))
    cols5 = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate"
    exact = f"SELECT o_orderkey, o_custkey, o_orderstatus, ({price})::VARCHAR AS o_totalprice, {day} AS o_orderdate FROM orders"
    # a tree of leaves of 1,024 rows on average and of nodes of 256 below each other
    q["table_digests"] = f"""WITH h AS (SELECT o_orderpriority AS p, sha256({row3}) AS s FROM orders),
c AS (SELECT p, s, count(*)::BIGINT AS c FROM h GROUP BY p, s),
n AS (SELECT p, sum(c)::BIGINT AS n, CASE WHEN sum(c) > 262144 THEN 2 WHEN sum(c) > 1024 THEN 1 ELSE 0 END AS l FROM c GROUP BY p),
leaf AS (SELECT p, l, substr(s, 1, 2 * l) AS node, sha256('leaf|' || string_agg(s || ':' || c, ',' ORDER BY s)) AS sha FROM c JOIN n USING (p) GROUP BY p, l, node),
m AS (SELECT p, substr(node, 1, 2) AS node, sha256('node|' || string_agg(node || ':' || sha, ',' ORDER BY node)) AS sha FROM leaf WHERE l = 2 GROUP BY p, substr(node, 1, 2)
  UNION ALL SELECT p, node, sha FROM leaf WHERE l = 1),
root AS (SELECT p, sha256('node|' || string_agg(node || ':' || sha, ',' ORDER BY node)) AS sha FROM m GROUP BY p UNION ALL SELECT p, sha FROM leaf WHERE l = 0)
SELECT p AS o_orderpriority, n AS n_rows, sha256(n::VARCHAR || '|' || sha ||
'|[["o_orderkey","bigint"],["o_custkey","bigint"],["o_orderstatus","string"],["o_totalprice","string"],["o_orderdate","string"]]') AS table_sha FROM root JOIN n USING (p)"""
    q["digest_tree_changes"] = f"""WITH a AS ({exact}),
kept AS (SELECT * REPLACE (CASE WHEN o_orderkey % 997 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM a WHERE o_orderkey % 1009 <> 1),
b AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE o_orderkey % 1013 = 2),
x AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b),
g AS (SELECT {cols5}, sum(s) AS s FROM x GROUP BY ALL HAVING sum(s) <> 0)
SELECT {cols5}, CASE WHEN s > 0 THEN 'before' ELSE 'now' END AS side, abs(s)::BIGINT AS times FROM g"""
    q["circular_shift_hours"] = f"""WITH {series('h', [])},
z AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, hour(ts)::VARCHAR || ',' || round(y, 2)::VARCHAR AS line, count(*) OVER () AS n FROM s),
m AS (SELECT (i - 24 + n) % n AS j, line FROM z)
SELECT ((z.i - m.j + n) % n)::BIGINT AS shift FROM z JOIN m USING (line) GROUP BY 1, n HAVING count(*) = n"""
    q["xcorr_shift"] = f"""WITH {series('h', [])}, z AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, y - avg(y) OVER () AS v, count(*) OVER () AS n FROM s),
m AS (SELECT (i - 24 + n) % n AS j, v FROM z),
c AS (SELECT z.i - m.j AS lag, sum(z.v * m.v) AS corr FROM z, m GROUP BY 1)
SELECT lag::BIGINT AS shift, round(corr, 2) AS corr FROM c ORDER BY c.corr DESC, lag LIMIT 1"""
    q["stream_hourly_rollup"] = f"""WITH {rolled('h', HK)} SELECT event_type, ts, round(y, 6) AS y FROM raw"""
    q["stream_flags"] = f"WITH {flagged(DK)} SELECT {k}, ts, flag FROM f"
    q["stream_sessions"] = f"""WITH {flagged(DK)}, g AS (SELECT *, lag(ts) OVER (PARTITION BY {k} ORDER BY ts) AS pt FROM f WHERE flag = 1),
g2 AS (SELECT *, sum((pt IS NULL OR ts - pt > INTERVAL 168 HOUR)::INT) OVER (PARTITION BY {k} ORDER BY ts) AS ev FROM g),
x AS (SELECT {k}, ev, min(ts) AS "start", max(ts) AS "end", count(*) AS flagged, round(max(score), 6) AS peak_score FROM g2 GROUP BY {k}, ev)
SELECT * EXCLUDE (ev) FROM x"""
    # small blocks change how work is spread, not what comes out
    for name in ("hysteresis", "persistence", "rising_edges", "tau_fixed", "candidate_counts"):
        q[f"{name}_blocked"] = q[name]
    q["event_sessions_blocked"] = q["event_sessions_by_status"]
    return q


