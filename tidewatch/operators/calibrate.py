"""Thresholds learned on the calibration period."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import AuditConfig
from tidewatch.operators.quantile import exact_quantiles
from tidewatch.operators.sequence import BLOCK_ROWS, attach, blocked
from tidewatch.operators.sweep import sweep
from tidewatch.session import spread

# The candidate quantiles of the budget search.
CANDIDATES = [float(q) for q in np.linspace(0.90, 0.999, 200)]


def fixed_tau(calib: DataFrame, score: str, q: float, keys: Sequence[str] = (), out: str = "tau_fixed") -> DataFrame:
    t = exact_quantiles(calib, keys, score, [q])
    return t.select(*keys, F.col("quantiles")[0].alias(out))


def candidate_events(
    calib: DataFrame,
    score: str,
    settings: Sequence[tuple[int, int]],
    low_ratio: float,
    keys: Sequence[str] = (),
    qs: Sequence[float] = CANDIDATES,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``keys, n, cand, tau, w_rows, k_hits, events``: event count of every candidate threshold.

    Rows are shuffled once, by block, next to one row with the candidates of their
    key.  A block is evaluated for both states it may be entered in, and the blocks
    of a key are then chained in a small table, so a long series is spread over
    many tasks and no candidate multiplies the shuffled rows.  Scores crowd a few units
    below 1 where the gradient residual saturates, so candidates are taken by the gap
    between two scores: they never fall from one to the next.
    """
    keys, settings = list(keys), [(int(w), int(k)) for w, k in settings]
    width = max(w for w, _ in settings)
    rows = max(rows, width + 1)
    cands = exact_quantiles(calib, keys, score, qs, by_gap=True)
    d = calib.where(F.col(score).isNotNull()).select(*keys, "row_no", F.col(score).alias("_s"))
    d = blocked(d, rows, width)
    blocks = attach(d.select(*keys, "_blk").distinct(), cands, keys)
    blocks = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])
    by = [*keys, "_blk"]
    schema = T.StructType(
        [calib.schema[k] for k in keys]
        + [
            T.StructField("_blk", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("taus", T.ArrayType(T.DoubleType())),
            T.StructField("last", T.ArrayType(T.LongType())),
            T.StructField("e0", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("e1", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )

    def evaluate(pdf: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        halo = int(pdf["_halo"].sum())
        full = len(pdf) - halo == rows
        taus = np.asarray(cand["quantiles"].iloc[0], dtype=float)
        edges, last = sweep(
            pdf["_s"].to_numpy(dtype=float), taus, settings, low_ratio, halo, width if full else 0
        )
        head = {k: cand[k].iloc[0] for k in keys}
        return pd.DataFrame(
            [
                {
                    **head,
                    "_blk": cand["_blk"].iloc[0],
                    "n": cand["n"].iloc[0],
                    "taus": taus.tolist(),
                    "last": last.tolist(),
                    "e0": edges[0].tolist(),
                    "e1": edges[1].tolist(),
                }
            ]
        )

    d, blocks = spread(d, *by), spread(blocks, *by)
    per_block = d.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(evaluate, schema)
    # one row per block and candidate; the entry state is the last state left before it
    flat = per_block.select(
        *by, "n", F.posexplode(F.arrays_zip("taus", "last")).alias("cand", "_l"), "e0", "e1"
    ).select(
        *by,
        "n",
        "cand",
        F.col("_l.taus").alias("tau"),
        F.nullif(F.col("_l.last"), F.lit(-1)).alias("_last"),
        F.transform("e0", lambda a: a[F.col("cand")]).alias("_e0"),
        F.transform("e1", lambda a: a[F.col("cand")]).alias("_e1"),
    )
    chain = Window.partitionBy(*keys, "cand").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("_in", F.coalesce(F.last("_last", True).over(chain), F.lit(0)))
    chosen = F.when(F.col("_in") == 1, F.col("_e1")).otherwise(F.col("_e0"))
    counts = flat.select(*keys, "n", "cand", "tau", F.posexplode(chosen).alias("_i", "_e"))
    counts = counts.groupBy(*keys, "n", "cand", "tau", "_i").agg(F.sum("_e").alias("events"))
    pairs = F.array(*[F.struct(F.lit(w).alias("w_rows"), F.lit(k).alias("k_hits")) for w, k in settings])
    return counts.select(
        *keys,
        "n",
        "cand",
        "tau",
        pairs[F.col("_i")]["w_rows"].alias("w_rows"),
        pairs[F.col("_i")]["k_hits"].alias("k_hits"),
        "events",
    )


def _pick(counts: DataFrame, calib: DataFrame, score: str, cfg: AuditConfig, keys: list[str]) -> DataFrame:
    """Per setting: the highest feasible candidate, else the highest score."""
    allowed = F.lit(cfg.events_per_period) * F.greatest(
        F.col("n") / F.lit(float(cfg.rows_per_period)), F.lit(1e-9)
    )
    fit = F.when(F.col("events") <= allowed, F.struct("cand", "tau", "events"))
    best = counts.groupBy(*keys, "w_rows", "k_hits").agg(F.max("n").alias("n"), F.max(fit).alias("_b"))
    top = calib.groupBy(*keys).agg(F.max(score).alias("_top"))
    return attach(best, top, keys).select(
        *keys,
        "n",
        "w_rows",
        "k_hits",
        F.coalesce(F.col("_b.tau"), F.col("_top")).alias("tau_budget"),
        F.coalesce(F.col("_b.events"), F.lit(0)).alias("events"),
    )


def budget_tau(calib: DataFrame, score: str, cfg: AuditConfig, keys: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """Highest of 200 upper quantiles whose event count fits the budget."""
    keys = list(keys)
    counts = candidate_events(calib, score, [(cfg.w, cfg.k)], cfg.low_ratio, keys, rows=rows)
    return _pick(counts, calib, score, cfg, keys)


def settings_grid(cfg: AuditConfig) -> list[tuple[int, int]]:
    """K above W can never fire, so such settings are left out unless asked for."""
    grid = [(w, k) for w in cfg.w_grid for k in cfg.k_grid]
    return grid if cfg.allow_unsatisfiable else [(w, k) for w, k in grid if k <= w]


def tune_wk(calib: DataFrame, score: str, cfg: AuditConfig, keys: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """W and K with the lowest feasible threshold; all settings share one pass."""
    keys = list(keys)
    counts = candidate_events(calib, score, settings_grid(cfg), cfg.low_ratio, keys, rows=rows)
    each = _pick(counts, calib, score, cfg, keys)
    ok = F.col("events") <= F.lit(cfg.events_per_period) * (
        F.col("n") / F.lit(float(cfg.rows_per_period)) + F.lit(1e-9)
    )
    rank = F.struct(
        F.when(ok, 0).otherwise(1).alias("not_ok"),
        F.when(ok, F.col("tau_budget")).otherwise(F.col("events").cast("double")).alias("cost"),
        "w_rows",
        "k_hits",
        "tau_budget",
        "events",
    )
    best = each.groupBy(*keys).agg(F.min(rank).alias("_b"))
    return best.select(*keys, "_b.w_rows", "_b.k_hits", "_b.tau_budget", "_b.events")


def tau_policies(calib: DataFrame, score: str, cfg: AuditConfig, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed and budget threshold, the capped one derived from both, and W and K.

    With tuning on, every key gets the W and K that suit it.
    """
    keys = list(keys)
    fixed = fixed_tau(calib, score, cfg.threshold_q, keys)
    chosen = (tune_wk if cfg.auto_tune else budget_tau)(calib, score, cfg, keys)
    return capped(attach(fixed, chosen.select(*keys, "tau_budget", "w_rows", "k_hits"), keys), cfg.cap_ratio)


def w_values(cfg: AuditConfig) -> list[int]:
    """Every W a series may have been given."""
    return sorted({cfg.w, *cfg.w_grid})


def capped(taus: DataFrame, cap_ratio: float) -> DataFrame:
    cap = F.col("tau_fixed") * F.lit(cap_ratio)
    return taus.withColumns(
        {
            "tau_sci": F.least(F.col("tau_budget"), cap),
            "tau_cap_hit": (F.col("tau_budget") > cap).cast("int"),
        }
    )
