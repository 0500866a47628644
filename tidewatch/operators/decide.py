"""Apply thresholds to the test period: frozen or recalibrated block by block."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import AuditConfig
from tidewatch.operators.sweep import Carry, Rules, roll
from tidewatch.operators.calibrate import CANDIDATES, w_values
from tidewatch.operators.flags import flag_streams
from tidewatch.operators.score import lookup_mean_std, mean_std_tables, zscore
from tidewatch.operators.sequence import BLOCK_ROWS, attach
from tidewatch.session import spread, stage_table


SPAN_ROWS = 16_384


def test_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test rows, numbered from the first one."""
    d = df.where(F.col("period") == "test")
    start = d.groupBy(*keys).agg(F.min("row_no").alias("_s"))
    return attach(d, start, list(keys)).withColumn("row_no", F.col("row_no") - F.col("_s")).drop("_s")


def zscore_flags(
    df: DataFrame,
    y: str,
    cfg: AuditConfig,
    keys: Sequence[str] = (),
    rows: int = BLOCK_ROWS,
    taus: DataFrame | None = None,
) -> DataFrame:
    """The plain three-sigma detector, over calibration and test.

    W and K come from ``taus`` when given (tuned per key), else from ``cfg``.
    """
    tables = mean_std_tables(df, y, cfg.season, cfg.fallback, cfg.min_n, keys)
    d = lookup_mean_std(df, tables, cfg.season, cfg.fallback, keys)
    d = d.withColumn("z", zscore(F.col(y), F.col("mu"), F.col("sd")))
    w, k = cfg.w, cfg.k
    if taus is not None:
        d = attach(d, taus.select(*keys, F.col("w_rows").alias("_w"), F.col("k_hits").alias("_k")), list(keys))
        w, k = "_w", "_k"
    d = flag_streams(
        d, {"outlier": ("z", cfg.z_threshold)}, w, k, cfg.low_ratio, keys, rows, w_grid=w_values(cfg)
    )
    return d.drop("_w", "_k")


def decide_frozen(
    df: DataFrame, taus: DataFrame, cfg: AuditConfig, keys: Sequence[str] = (), rows: int = BLOCK_ROWS
) -> DataFrame:
    """Constant thresholds over the test period."""
    keys = list(keys)
    cols = ["tau_fixed", "tau_budget", "tau_sci", "tau_cap_hit", "w_rows", "k_hits"]
    d = attach(test_rows(df, keys), taus.select(*keys, *cols), keys)
    return flag_streams(
        d,
        {"flag_budget": ("score", "tau_budget"), "flag_sci": ("score", "tau_sci")},
        "w_rows",
        "k_hits",
        cfg.low_ratio,
        keys,
        rows,
        w_grid=w_values(cfg),
    )


def rules_of(cfg: AuditConfig) -> Rules:
    return Rules(
        int(cfg.block_days * 86400),
        int(cfg.rolling_days * 86400),
        cfg.min_rolling_rows,
        cfg.low_ratio,
        cfg.events_per_period,
        cfg.rows_per_period,
        tuple(CANDIDATES),
    )


def decide_rolling(
    df: DataFrame,
    taus: DataFrame,
    cfg: AuditConfig,
    keys: Sequence[str] = (),
    span_blocks: int | None = None,
) -> DataFrame:
    """Before every block, learn the budget threshold again from the rows before it.

    Rows already flagged or under a touched cap are left out of that window, so a
    block depends on earlier flags.  A series is cut into spans of blocks, and all
    spans of all series are solved at once from what is known at their start: the
    exclusions in the window before them and the state carried in.  Spans whose
    start turns out different are solved again until none is.  A span only looks
    back, so round ``r`` has the first ``r`` spans right whatever the others hold,
    and a round without changes is the exact answer.  Series of one span need no
    second round.  Unless given, the span is as many blocks as hold about 16,384 rows.
    """
    keys = list(keys)
    rules = rules_of(cfg)
    sec = F.unix_seconds("ts")
    test = df.where(F.col("period") == "test")
    ends = test.groupBy(*keys).agg(
        F.min(sec).alias("_t0"),
        F.max(sec).alias("_t1"),
        F.min("row_no").alias("_r0"),
        F.count(F.lit(1)).alias("_n"),
    )
    ends = stage_table(ends, "rolling-ends")
    if span_blocks is None:
        per_block = F.col("_n") / (F.floor((F.col("_t1") - F.col("_t0")) / rules.block) + 1)
        densest = ends.agg(F.max(per_block)).first()[0] or 1.0
        span_blocks = max(1, int(SPAN_ROWS / densest))
    span = rules.block * span_blocks
    base = taus.select(*keys, "tau_fixed", F.col("tau_budget").alias("_tau0"), "w_rows", "k_hits")
    ends = attach(ends.drop("_n"), base, keys).withColumn("_last", F.floor((F.col("_t1") - F.col("_t0")) / span))
    rows_in = attach(df.where(F.col("period") != "fit"), ends, keys)
    since = sec - F.col("_t0")
    rows_in = rows_in.where(since >= -rules.window).withColumn("_span", F.floor(since / span))
    rows_in = stage_table(rows_in, "rolling-input")
    initial = F.struct(
        F.col("_tau0").alias("tau"),
        F.lit(0).alias("on_b"),
        F.array().cast("array<int>").alias("tail_b"),
        F.lit(0).alias("on_s"),
        F.array().cast("array<int>").alias("tail_s"),
    )
    spans = stage_table(
        ends.select(
            *keys,
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("_span"),
            initial.alias("_start"),
            "_t0",
            "_t1",
            (F.col("tau_fixed") * F.lit(cfg.cap_ratio)).alias("_cap"),
            "w_rows",
            "k_hits",
        ),
        "rolling-spans",
    )
    on = [*keys, "_span"]
    # the spans in whose first window a row lies
    leads = F.sequence(
        F.greatest(F.floor(since / span) + 1, F.lit(0)),
        F.least(F.floor((since + rules.window) / span), F.col("_last")),
    )
    leads = F.when(
        F.greatest(F.floor(since / span) + 1, F.lit(0))
        <= F.least(F.floor((since + rules.window) / span), F.col("_last")),
        leads,
    ).otherwise(F.array().cast("array<bigint>"))
    carry_type = T.StructType(
        [
            T.StructField("tau", T.DoubleType()),
            T.StructField("on_b", T.IntegerType()),
            T.StructField("tail_b", T.ArrayType(T.IntegerType())),
            T.StructField("on_s", T.IntegerType()),
            T.StructField("tail_s", T.ArrayType(T.IntegerType())),
        ]
    )
    decided = {
        "tau_budget": T.DoubleType(),
        "tau_sci": T.DoubleType(),
        "tau_cap_hit": T.IntegerType(),
        "flag_budget": T.IntegerType(),
        "flag_sci": T.IntegerType(),
        "excluded": T.IntegerType(),
    }
    schema = T.StructType(
        [df.schema[c] for c in keys]
        + [T.StructField("_span", T.LongType()), T.StructField("row_no", T.LongType())]
        + [T.StructField(c, t) for c, t in decided.items()]
        + list(carry_type.fields)
    )
    names = [f.name for f in schema.fields]

    def solve(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        """One span: its rows and one window of rows before it."""
        if not len(start):
            return pd.DataFrame(columns=names)
        s = start.iloc[0]
        rows = rows.sort_values("row_no")
        lead, own = rows[rows["_lead"]], rows[~rows["_lead"]]
        carry = Carry(s["tau"], int(s["on_b"]), list(s["tail_b"]), int(s["on_s"]), list(s["tail_s"]))
        first = int(s["_span"]) * span_blocks
        last = min(first + span_blocks - 1, int((s["_t1"] - s["_t0"]) // rules.block))
        got = roll(
            (lead["sec"].to_numpy(), lead["score"].to_numpy(dtype=float), lead["_x"].to_numpy()),
            own["sec"].to_numpy(),
            own["score"].to_numpy(dtype=float),
            int(s["_t0"]),
            (first, last),
            float(s["_cap"]),
            int(s["w_rows"]),
            int(s["k_hits"]),
            carry,
            rules,
        )
        # the rows of the span, and one more row with what it leaves behind
        left = vars(carry)
        n = len(own)
        cols = {c: [s[c]] * (n + 1) for c in on}
        cols["row_no"] = [*own["row_no"].tolist(), None]
        cols.update({c: [*got[c].tolist(), None] for c in decided})
        cols.update({c: [*[None] * n, left[c]] for c in left})
        return pd.DataFrame(cols, dtype=object)[names]

    def evaluate(which: DataFrame, solved: DataFrame | None) -> DataFrame:
        """Solve the spans of ``which`` (``keys, _span, _start, ...``)."""
        known = rows_in
        if solved is None:
            known = known.withColumn("_x", F.lit(0))
        else:
            marks = solved.where(F.col("row_no").isNotNull()).select(*keys, "row_no", F.col("excluded").alias("_x"))
            known = known.join(marks, [*keys, "row_no"], "left").withColumn("_x", F.coalesce("_x", F.lit(0)))
        own = F.when(
            F.col("period") == "test", F.array(F.struct(F.col("_span").alias("s"), F.lit(False).alias("l")))
        ).otherwise(F.array().cast("array<struct<s:bigint,l:boolean>>"))
        ahead = F.transform(leads, lambda t: F.struct(t.alias("s"), F.lit(True).alias("l")))
        parts = known.select(
            *keys, "row_no", sec.alias("sec"), "score", "_x", F.explode(F.concat(own, ahead)).alias("_to")
        )
        parts = parts.select(
            *keys, F.col("_to.s").alias("_span"), F.col("_to.l").alias("_lead"), "row_no", "sec", "score", "_x"
        )
        if solved is not None:
            parts = parts.join(which.select(*on), on, "left_semi")
        starts = which.select(*on, "_t0", "_t1", "_cap", "w_rows", "k_hits", "_start.*")
        starts = starts.select(*[F.col(c).alias(c) for c in starts.columns])
        a, b = spread(parts, *on), spread(starts, *on)
        return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(solve, schema)

    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    solved = stage_table(evaluate(spans, None), "rolling-round")
    starts, marks_before = spans, None
    longest = spans.agg(F.max("_span")).first()[0]
    while longest:
        ended = solved.where(F.col("row_no").isNull()).select(
            *on, F.struct(*[f.name for f in carry_type.fields]).alias("_end")
        )
        now = spans.join(ended, on, "left").withColumn(
            "_start", F.coalesce(F.last("_end", True).over(before), F.col("_start"))
        )
        now = stage_table(now.drop("_end"), "rolling-starts")
        was = starts.select(*on, F.col("_start").alias("_was"))
        moved = now.join(was, on).where(~F.col("_start").eqNullSafe(F.col("_was"))).select(*on)
        marks = solved.where(F.col("row_no").isNotNull()).select(*keys, "row_no", "excluded")
        if marks_before is None:
            flipped = marks.where(F.col("excluded") == 1)
        else:
            old = marks_before.select(*keys, "row_no", F.col("excluded").alias("_old"))
            flipped = marks.join(old, [*keys, "row_no"]).where(F.col("excluded") != F.col("_old"))
        touched = rows_in.join(flipped.select(*keys, "row_no"), [*keys, "row_no"], "left_semi").select(
            *keys, F.explode(leads).alias("_span")
        )
        dirty = stage_table(moved.unionByName(touched).distinct(), "rolling-dirty")
        if dirty.isEmpty():
            break
        again = evaluate(now.join(dirty, on, "left_semi"), solved)
        kept = solved.join(dirty, on, "left_anti").select(names)
        starts, marks_before = now, marks
        solved = stage_table(kept.unionByName(again.select(names)), "rolling-round")
    flags = solved.where(F.col("row_no").isNotNull()).select(*keys, "row_no", *[c for c in decided if c != "excluded"])
    out = rows_in.where(F.col("period") == "test").join(flags, [*keys, "row_no"])
    out = out.withColumn("row_no", F.col("row_no") - F.col("_r0"))
    return out.drop("_t0", "_t1", "_r0", "_span", "_last", "_tau0")
