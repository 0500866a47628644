"""State loops written from the description of the operators, for comparison only."""

import numpy as np


def hold(scores, tau, low_ratio, on=0):
    """Hysteresis; ``tau`` is a number or one per row."""
    taus = np.broadcast_to(np.asarray(tau, dtype=float), (len(scores),))
    out = []
    for s, t in zip(scores, taus):
        if s > t:
            on = 1
        elif s < t * low_ratio:
            on = 0
        out.append(on)
    return out


def k_of_w(raw, w, k):
    return [int(sum(raw[max(0, i - w + 1) : i + 1]) >= k) for i in range(len(raw))]


def edges(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def flags(scores, tau, w, k, low_ratio=0.98):
    return k_of_w(hold(scores, tau, low_ratio), w, k)


def budget(scores, w, k, low_ratio, per, rows_per):
    allowed = per * max(max(len(scores), 1) / rows_per, 1e-9)
    for q in reversed(np.linspace(0.90, 0.999, 200)):
        tau = float(np.quantile(scores, q))
        if edges(flags(scores, tau, w, k, low_ratio)) <= allowed:
            return tau
    return float(max(scores))


def tune(scores, grid, low_ratio, per, rows_per):
    return min((budget(scores, w, k, low_ratio, per, rows_per), w, k) for w, k in grid)


def sessions(secs, flag, cooldown):
    """``(first row, last row)`` of every event."""
    out = []
    for i, f in enumerate(flag):
        if not f:
            continue
        if out and (i == out[-1][1] + 1 or secs[i] - secs[out[-1][1]] <= cooldown):
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tuple(x) for x in out]


def rolling(secs, scores, test_from, tau_fixed, tau_budget, w, k, cfg):
    """Block by block over one series; returns one tuple per test row."""
    n = len(secs)
    block, window = cfg.block_days * 86400, cfg.rolling_days * 86400
    cap = tau_fixed * cfg.cap_ratio
    tau, excluded = tau_budget, [0] * n
    taus, hits, f_b, f_s = [None] * n, [0] * n, [0] * n, [0] * n
    start = secs[test_from]
    while start <= secs[-1]:
        inside = [i for i in range(n) if start - window <= secs[i] < start and not excluded[i]]
        if len(inside) >= cfg.min_rolling_rows:
            tau = budget([scores[i] for i in inside], w, k, cfg.low_ratio, cfg.events_per_period, cfg.rows_per_period)
        for i in range(test_from, n):
            if start <= secs[i] < start + block:
                taus[i], hits[i] = tau, int(tau > cap)
        upto = [i for i in range(test_from, n) if secs[i] < start + block]
        x = [scores[i] for i in upto]
        f_b[test_from : test_from + len(upto)] = k_of_w(hold(x, [taus[i] for i in upto], cfg.low_ratio), w, k)
        f_s[test_from : test_from + len(upto)] = k_of_w(
            hold(x, [min(taus[i], cap) for i in upto], cfg.low_ratio), w, k
        )
        for i in upto:
            excluded[i] = max(f_s[i], hits[i])
        start += block
    return [(taus[i], min(taus[i], cap), hits[i], f_b[i], f_s[i]) for i in range(test_from, n)]
