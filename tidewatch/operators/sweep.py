"""Numpy steps that run inside tasks, on one bounded run of scores at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sweep(
    scores: np.ndarray,
    taus: np.ndarray,
    settings: list[tuple[int, int]],
    low_ratio: float,
    halo: int = 0,
    tail: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Rising edges after ``halo`` rows, for both states the run may be entered in.

    Returns ``edges[entry, setting, tau]`` and ``last[tau]``: the state the run
    leaves behind ``tail`` rows before its end, -1 when it never left its entry
    state.  Runs of blocks compose from these two.
    """
    n, m = len(scores), len(taus)
    s = np.asarray(scores, dtype=float)[:, None]
    on = s > taus[None, :]
    changed = on | (s < (taus * low_ratio)[None, :])
    at = np.maximum.accumulate(np.where(changed, np.arange(n)[:, None], -1), axis=0)
    known = at >= 0
    state = np.take_along_axis(on, np.maximum(at, 0), axis=0) & known
    edges = np.zeros((2, len(settings), m), dtype=np.int64)
    for entry in (0, 1):
        raw = state | (~known if entry else np.zeros_like(known))
        total = np.vstack([np.zeros((1, m), dtype=np.int32), np.cumsum(raw, axis=0, dtype=np.int32)])
        for w in sorted({w for w, _ in settings}):
            rolled = total[1:] - total[np.maximum(np.arange(1, n + 1) - w, 0)]
            for i, (sw, k) in enumerate(settings):
                if sw != w:
                    continue
                flag = rolled >= k
                up = flag.copy()
                up[1:] &= ~flag[:-1]
                edges[entry, i] = up[halo:].sum(axis=0)
    end = n - tail
    last = np.where(known[end - 1], state[end - 1], -1) if end > 0 else np.full(m, -1)
    return edges, last.astype(np.int64)


def budget_tau(
    scores: np.ndarray, qs: np.ndarray, w: int, k: int, low_ratio: float, per_period: float, rows_per_period: int
) -> float:
    """Highest candidate quantile whose event count fits the budget, else the maximum."""
    taus = np.quantile(scores, qs)
    edges, _ = sweep(scores, taus, [(w, k)], low_ratio)
    allowed = per_period * max(max(len(scores), 1) / rows_per_period, 1e-9)
    fits = np.flatnonzero(edges[0, 0] <= allowed)
    return float(taus[fits[-1]]) if len(fits) else float(np.max(scores))


def step_flags(
    scores: np.ndarray, tau: float | np.ndarray, w: int, k: int, low_ratio: float, on: int, tail: list[int]
) -> tuple[np.ndarray, int, list[int]]:
    """Flags of the next rows of a series, given the state and the last raw states."""
    n = len(scores)
    up, down = scores > tau, scores < tau * low_ratio
    at = np.maximum.accumulate(np.where(up | down, np.arange(n), -1))
    raw = np.where(at >= 0, up[np.maximum(at, 0)], bool(on)).astype(int)
    both = np.concatenate([np.asarray(tail, dtype=int), raw])
    total = np.concatenate([[0], np.cumsum(both)])
    end = np.arange(len(tail) + 1, len(both) + 1)
    flags = (total[end] - total[np.maximum(end - w, 0)] >= k).astype(int)
    keep = both[max(0, len(both) - (w - 1)) :] if w > 1 else both[:0]
    return flags, int(raw[-1]) if n else on, keep.tolist()


@dataclass
class Carry:
    """What a series takes from one run of blocks into the next."""

    tau: float
    on_b: int = 0
    tail_b: list[int] = field(default_factory=list)
    on_s: int = 0
    tail_s: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Rules:
    """Settings of a rolling decision; times in seconds."""

    block: int
    window: int
    min_rows: int
    low_ratio: float
    per_period: float
    rows_per_period: int
    qs: tuple[float, ...]


def roll(
    past: tuple[np.ndarray, np.ndarray, np.ndarray],
    sec: np.ndarray,
    score: np.ndarray,
    t0: int,
    blocks: tuple[int, int],
    cap: float,
    w: int,
    k: int,
    carry: Carry,
    rules: Rules,
) -> dict[str, np.ndarray]:
    """Decide rows block after block; ``carry`` is moved along.

    ``past``: time, score and exclusion of the rows before, at least one window of
    them.  The threshold is learned again at the start of every block of ``blocks``
    (first, last), also of blocks without rows.  Rows of earlier blocks belong to a
    block that was opened before and keep its threshold.
    """
    m, n = len(past[0]), len(sec)
    all_sec = np.concatenate([past[0], sec])
    all_score = np.concatenate([past[1], score])
    out_x = np.concatenate([past[2], np.zeros(n, dtype=int)])
    of = (sec - t0) // rules.block
    out = {
        "tau_budget": np.zeros(n),
        "tau_sci": np.zeros(n),
        "tau_cap_hit": np.zeros(n, dtype=int),
        "flag_budget": np.zeros(n, dtype=int),
        "flag_sci": np.zeros(n, dtype=int),
    }
    qs = np.asarray(rules.qs)

    def apply(lo: int, hi: int) -> None:
        if lo >= hi:
            return
        sci, hit = min(carry.tau, cap), int(carry.tau > cap)
        x = score[lo:hi]
        f_b, carry.on_b, carry.tail_b = step_flags(x, carry.tau, w, k, rules.low_ratio, carry.on_b, carry.tail_b)
        f_s, carry.on_s, carry.tail_s = step_flags(x, sci, w, k, rules.low_ratio, carry.on_s, carry.tail_s)
        for name, v in zip(out, (carry.tau, sci, hit, f_b, f_s)):
            out[name][lo:hi] = v
        out_x[m + lo : m + hi] = np.maximum(f_s, hit)

    first, last = blocks
    at = int(np.searchsorted(of, first))
    apply(0, at)
    for d in range(first, last + 1):
        end = t0 + d * rules.block
        a, b = np.searchsorted(all_sec, [end - rules.window, end])
        if b - a >= rules.min_rows:
            kept = all_score[a:b][out_x[a:b] == 0]
            if len(kept) >= rules.min_rows:
                carry.tau = budget_tau(kept, qs, w, k, rules.low_ratio, rules.per_period, rules.rows_per_period)
        upto = int(np.searchsorted(of, d, side="right"))
        apply(at, upto)
        at = upto
    out["excluded"] = out_x[m:]
    return out
