"""Persistent excursions of a score: hysteresis, K of W, edges, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import action_col
from tidewatch.operators.sequence import (
    BLOCK_ROWS,
    after_blocks,
    attach,
    before_blocks,
    block_window,
    blocked,
)


def trigger(score: Column, tau: Column, low_ratio: float) -> Column:
    """1 where the state must be on, 0 where it must be off, null where it holds."""
    s = F.nanvl(score, F.lit(None).cast("double"))
    return F.when(s > tau, 1).when(s < tau * F.lit(low_ratio), 0)


def flag_streams(
    df: DataFrame,
    streams: dict[str, tuple[str, str | float]],
    w: int | str,
    k: int | str,
    low_ratio: float,
    keys: Sequence[str] = (),
    rows: int = BLOCK_ROWS,
    keep: Sequence[str] = (),
    w_grid: Sequence[int] = (),
) -> DataFrame:
    """Flag one or more scores: ``{"name": (score column, tau column or number)}``.

    Adds ``name`` (0/1 after hysteresis and K-of-W), and ``name_raw`` (hysteresis
    only) and ``name_edge`` (rising edges) when listed in ``keep``.  Needs
    ``row_no``.  A block starts from the last trigger before it, which comes from a
    one-row-per-block table, and from a halo of ``w`` rows.  W and K may be columns
    that differ between series; ``w_grid`` then lists the values W takes.
    """
    keys = list(keys)
    grid = [w] if isinstance(w, int) else sorted(set(w_grid))
    halo = max(grid)
    rows = max(rows, halo + 1)
    col = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    d = df.withColumns(
        {f"_t_{n}": trigger(col(s), col(t), low_ratio) for n, (s, t) in streams.items()}
    )
    # blocks shifted by the halo: carry b is the state where the halo of block b begins
    last = lambda n: F.max(
        F.when(F.col(f"_t_{n}").isNotNull(), F.struct(F.col("row_no"), F.col(f"_t_{n}").alias("t")))
    ).alias(f"_l_{n}")
    carry = (
        d.groupBy(*keys, F.floor((F.col("row_no") + halo) / rows).alias("_blk"))
        .agg(*[last(n) for n in streams])
        .select(
            *keys,
            "_blk",
            *[
                F.coalesce(F.last(f"_l_{n}", True).over(before_blocks(keys))["t"], F.lit(0)).alias(f"_c_{n}")
                for n in streams
            ],
        )
    )
    d = blocked(d, rows, halo).join(carry, [*keys, "_blk"])
    win = block_window(keys)
    upto = win.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns(
        {f"{n}_raw": F.coalesce(F.last(f"_t_{n}", True).over(upto), F.col(f"_c_{n}")) for n in streams}
    )
    need = F.col(k) if isinstance(k, str) else F.lit(k)

    def rolled(n: str, back: int) -> Column:
        """Sum of the last W raw states, ``back`` rows ago."""
        sums = [F.sum(f"{n}_raw").over(win.rowsBetween(-(x - 1) - back, -back)) for x in grid]
        if isinstance(w, int):
            return F.coalesce(sums[0], F.lit(0))
        return F.coalesce(*[F.when(F.col(w) == x, s) for x, s in zip(grid, sums)], F.lit(0))

    d = d.withColumns({n: (rolled(n, 0) >= need).cast("int") for n in streams})
    d = d.withColumns(
        {f"{n}_edge": ((F.col(n) == 1) & (rolled(n, 1) < need)).cast("int") for n in streams}
    )
    drop = [f"{p}_{n}" for n in streams for p in ("_t", "_c")]
    drop += [f"{n}_{x}" for n in streams for x in ("raw", "edge") if f"{n}_{x}" not in keep]
    return d.where(~F.col("_halo")).drop("_blk", "_halo", *drop)


def rising_edges(
    df: DataFrame, flags: Sequence[str], keys: Sequence[str] = (), rows: int = BLOCK_ROWS
) -> DataFrame:
    """``<flag>_edge`` for any 0/1 column: on now, off on the row before."""
    d = blocked(df, rows, 1)
    w = block_window(keys)
    d = d.withColumns(
        {f"{f}_edge": ((F.col(f) == 1) & (F.lag(f, 1, 0).over(w) == 0)).cast("int") for f in flags}
    )
    return d.where(~F.col("_halo")).drop("_blk", "_halo")


def events(
    df: DataFrame,
    flag: str,
    cooldown_hours: float,
    keys: Sequence[str] = (),
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Group flagged rows into events and describe each.

    Flagged rows join when they are neighbours or no further apart than the
    cooldown.  An event covers every row from its first to its last flagged row.
    Needs ``row_no, ts, score, reason``; uses ``tau_cap_hit`` when present.

    Events are built per block as fragments; a fragment that continues an earlier
    event finds its start in a one-row-per-block table.
    """
    keys = list(keys)
    gap = int(cooldown_hours * 3600)
    sec = F.unix_seconds("ts")
    here = F.when(F.col(flag) == 1, F.struct(F.col("row_no").alias("r"), sec.alias("s")))
    cap = F.col("tau_cap_hit") if "tau_cap_hit" in df.columns else F.lit(0)
    d = blocked(
        df.select(*keys, "row_no", "ts", "score", "reason", cap.alias("_cap"), here.alias("_f")), rows
    ).drop("_halo")

    def is_new(cur: Column, prev: Column) -> Column:
        far = (cur["r"] != prev["r"] + 1) & (cur["s"] - prev["s"] > gap)
        return prev.isNull() | far

    # per block: first and last flagged row; then what precedes and what follows
    ends = d.groupBy(*keys, "_blk").agg(F.min("_f").alias("_first"), F.max("_f").alias("_last"))
    ends = ends.withColumn("_before", F.last("_last", True).over(before_blocks(keys)))
    ends = ends.withColumn(
        "_first_new",
        F.when(F.col("_first").isNotNull(), is_new(F.col("_first"), F.col("_before"))),
    )
    ends = ends.withColumn("_after_new", F.first("_first_new", True).over(after_blocks(keys)))
    d = d.join(ends.select(*keys, "_blk", "_before", "_after_new"), [*keys, "_blk"])

    w = block_window(keys)
    prev = F.coalesce(
        F.last("_f", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before")
    )
    d = d.withColumn("_prev", prev)
    d = d.withColumn("_new", F.when(F.col("_f").isNotNull(), is_new(F.col("_f"), F.col("_prev"))))
    d = d.withColumn(
        "_start",
        F.max(F.when(F.col("_new"), F.col("row_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )
    following = F.coalesce(
        F.first("_new", True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("_after_new")
    )
    inside = F.col("_f").isNotNull() | (F.col("_prev").isNotNull() & ~F.coalesce(F.col("_next_new"), F.lit(True)))
    d = d.withColumn("_next_new", following)
    starts = (
        d.groupBy(*keys, "_blk")
        .agg(F.max(F.when(F.col("_new"), F.col("row_no"))).alias("_s"))
        .select(*keys, "_blk", F.last("_s", True).over(before_blocks(keys)).alias("_open"))
    )
    peak = F.struct("score", (-F.col("row_no")).alias("r"), F.col("_cap").alias("cap"))
    fragments = (
        d.where(inside)
        .groupBy(*keys, "_blk", "_start", "reason")
        .agg(
            F.min("ts").alias("a"),
            F.max("ts").alias("b"),
            F.count(F.lit(1)).alias("n"),
            F.min("row_no").alias("r0"),
            F.max(peak).alias("p"),
        )
    )
    whole = (
        fragments.join(starts, [*keys, "_blk"])
        .withColumn("event_row", F.coalesce("_start", "_open"))
        .groupBy(*keys, "event_row", "reason")
        .agg(
            F.min("a").alias("a"),
            F.max("b").alias("b"),
            F.sum("n").alias("n"),
            F.min("r0").alias("r0"),
            F.max("p").alias("p"),
        )
    )
    # the most frequent reason; on a tie the one seen first
    major = F.max(F.struct(F.col("n"), (-F.col("r0")).alias("r"), F.col("reason")))["reason"]
    out = whole.groupBy(*keys, "event_row").agg(
        F.min("a").alias("start"),
        F.max("b").alias("end"),
        F.sum("n").alias("hours"),
        F.max("p").alias("_p"),
        major.alias("reason_major"),
    )
    return out.select(
        *keys,
        "event_row",
        "start",
        "end",
        "hours",
        F.col("_p.score").alias("peak_score"),
        (-F.col("_p.r")).alias("peak_row"),
        "reason_major",
        action_col(F.col("reason_major"), F.col("_p.cap") == 1).alias("action"),
    )


def top_event(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The event with the highest peak per key; the earlier one on a tie."""
    names = ["start", "end", "hours", "peak_score", "reason_major", "action"]
    best = F.max_by(F.struct(*names), F.struct("peak_score", (-F.col("event_row")).alias("r")))
    return found.groupBy(*keys).agg(best.alias("_e")).select(*keys, "_e.*")
