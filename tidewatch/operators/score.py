"""Residuals, season thresholds and the normalised score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exact import exact_means
from tidewatch.functions.labels import LEVEL, SHAPE
from tidewatch.operators.predict import CALIB
from tidewatch.operators.quantile import exact_quantiles, quantile_columns
from tidewatch.operators.sequence import BLOCK_ROWS, attach, lagged
from tidewatch.session import stage_table

EPS = 1e-9


def first_difference(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], rows: int = BLOCK_ROWS
) -> DataFrame:
    """``d_<col>`` = change since the row before, 0 on the first row."""
    d = lagged(df, keys, {f"_l_{c}": (c, 1) for c in cols}, rows)
    return d.withColumns(
        {f"d_{c}": F.coalesce(F.col(c) - F.col(f"_l_{c}"), F.lit(0.0)) for c in cols}
    ).drop(*[f"_l_{c}" for c in cols])


def audit_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Calibration and test rows, numbered from the first calibration row."""
    d = df.where(F.col("period") != "fit")
    start = d.groupBy(*keys).agg(F.min("row_no").alias("_s"))
    return attach(d, start, list(keys)).withColumn("row_no", F.col("row_no") - F.col("_s")).drop("_s")


def level_residual(y: Column, pred: Column, floor: Column) -> Column:
    return F.abs(y - pred) / (F.greatest(y, floor) + EPS)


def gradient_residual(dy: Column, dpred: Column, floor: Column) -> Column:
    return F.abs(dy - dpred) / (F.greatest(F.abs(dy), floor) + EPS)


def residuals(
    audit: DataFrame,
    y: str,
    pred: str = "pred",
    naive: str = "pred_naive",
    keys: Sequence[str] = (),
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Level and gradient residuals, scaled by medians of the calibration period.

    Differences run over calibration and test together, so the first test row is
    compared with the last calibration row.
    """
    keys = list(keys)
    d = first_difference(audit, keys, sorted({y, pred}), rows)
    calib = d.where(CALIB).select(
        *keys, y, F.when(F.col("row_no") > 0, F.abs(F.col(f"d_{y}"))).alias("_ady")
    )
    floors = quantile_columns(calib, keys, {"_y0": (y, 0.5), "_d0": ("_ady", 0.5)})
    d = attach(d, floors, keys)
    return d.withColumns(
        {
            "res": level_residual(F.col(y), F.col(pred), F.col("_y0")),
            "res_naive": level_residual(F.col(y), F.col(naive), F.col("_y0")),
            "grad_res": gradient_residual(F.col(f"d_{y}"), F.col(f"d_{pred}"), F.col("_d0")),
        }
    ).drop("_y0", "_d0", *{f"d_{y}", f"d_{pred}"})


def threshold_tables(
    df: DataFrame,
    season: Sequence[str],
    fallback: str,
    values: Sequence[str] = ("res", "grad_res"),
    q: float = 0.999,
    min_n: int = 6,
    keys: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quantiles per season, per fallback column, and overall, on calibration rows.

    All three levels and all values go through one quantile pass as a long table.
    Only the season level asks for ``min_n`` rows.
    """
    keys, season = list(keys), list(season)
    calib = df.where(CALIB)
    none = F.lit(None).cast("string")
    level = lambda no, cols: F.struct(
        F.lit(no).alias("lv"),
        *[
            (F.col(c).cast("string") if c in cols else none).alias(f"g{i}")
            for i, c in enumerate([*season, fallback])
        ],
    )
    parts = F.array(level(1, season), level(2, [fallback]), level(3, []))
    long = calib.select(
        *keys,
        F.explode(parts).alias("_g"),
        F.array(
            *[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("v")) for v in values]
        ).alias("_v"),
    ).select(*keys, "_g.*", F.explode("_v").alias("_s"))
    gcols = [f"g{i}" for i in range(len(season) + 1)]
    gcols_safe = [F.coalesce(F.col(g), F.lit("")).alias(g) for g in gcols]
    long = long.select(
        *keys, "lv", *gcols_safe, F.col("_s.m").alias("m"), F.col("_s.v").alias("x")
    )
    table = exact_quantiles(long, [*keys, "lv", *gcols, "m"], "x", [q])
    wide = table.groupBy(*keys, "lv", *gcols).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("m") == v, F.col("quantiles")[0])).alias(f"thr_{v}") for v in values],
    )
    thr = [f"thr_{v}" for v in values]
    types = {c: df.schema[c].dataType for c in [*season, fallback]}
    t1 = wide.where("lv = 1").select(
        *keys,
        *[F.col(f"g{i}").cast(types[c]).alias(c) for i, c in enumerate(season)],
        "n",
        *[F.when(F.col("n") >= min_n, F.col(t)).alias(t) for t in thr],
    )
    t2 = wide.where("lv = 2").select(
        *keys, F.col(f"g{len(season)}").cast(types[fallback]).alias(fallback), "n", *thr
    )
    t3 = wide.where("lv = 3").select(*keys, "n", *thr)
    return t1, t2, t3


def lookup_threshold(
    df: DataFrame,
    tables: tuple[DataFrame, DataFrame, DataFrame],
    season: Sequence[str],
    fallback: str,
    values: Sequence[str] = ("res", "grad_res"),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Season level, else fallback level, else overall; says which one was taken."""
    keys = list(keys)
    t1, t2, t3 = tables
    ren = lambda t, by, n: t.select(*by, *[F.col(f"thr_{v}").alias(f"_{n}_{v}") for v in values])
    d = df.join(ren(t1, [*keys, *season], 1), [*keys, *season], "left")
    d = d.join(ren(t2, [*keys, fallback], 2), [*keys, fallback], "left")
    d = attach(d, ren(t3, keys, 3), keys, "left")
    first = values[0]
    d = d.withColumn(
        "thr_level",
        F.when(F.col(f"_1_{first}").isNotNull(), 1).when(F.col(f"_2_{first}").isNotNull(), 2).otherwise(3),
    )
    d = d.withColumns(
        {f"thr_{v}": F.coalesce(f"_1_{v}", f"_2_{v}", f"_3_{v}") for v in values}
    )
    return d.drop(*[f"_{n}_{v}" for n in (1, 2, 3) for v in values])


def normalised(df: DataFrame) -> DataFrame:
    """``score`` is the larger of the two normalised residuals; ties count as level."""
    d = df.withColumns(
        {
            "s_res": F.nanvl(F.col("res") / (F.col("thr_res") + EPS), F.lit(None)),
            "s_grad": F.nanvl(F.col("grad_res") / (F.col("thr_grad_res") + EPS), F.lit(None)),
        }
    )
    return d.withColumns(
        {
            "score": F.greatest("s_res", "s_grad"),
            "reason": F.when(F.col("s_res") >= F.col("s_grad"), LEVEL).otherwise(SHAPE),
        }
    )


def score(
    audit: DataFrame,
    y: str,
    season: Sequence[str],
    fallback: str,
    pred: str = "pred",
    q: float = 0.999,
    min_n: int = 6,
    keys: Sequence[str] = (),
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    d = stage_table(residuals(audit, y, pred, "pred_naive", keys, rows), "residuals")
    tables = threshold_tables(d, season, fallback, ("res", "grad_res"), q, min_n, keys)
    return normalised(lookup_threshold(d, tables, season, fallback, ("res", "grad_res"), keys))


def mean_std_tables(
    df: DataFrame, y: str, season: Sequence[str], fallback: str, min_n: int = 6, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean and population deviation; the two grouped levels need ``min_n`` rows and spread."""
    calib = df.where(CALIB)
    keys = list(keys)

    def level(by: list[str], floor: bool) -> DataFrame:
        t = calib.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("sd"))
        t = attach(t, exact_means(calib, [*keys, *by], y, "mu"), [*keys, *by])
        if floor:
            return t.withColumn(
                "ms", F.struct("mu", F.when(F.col("sd") > 0, F.col("sd")).otherwise(EPS).alias("sd"))
            )
        ok = (F.col("n") >= min_n) & (F.col("sd") > 0)
        return t.withColumn("ms", F.when(ok, F.struct("mu", "sd")))

    return level(list(season), False), level([fallback], False), level([], True)


def lookup_mean_std(
    df: DataFrame,
    tables: tuple[DataFrame, DataFrame, DataFrame],
    season: Sequence[str],
    fallback: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean and deviation always come from the same level."""
    keys = list(keys)
    t1, t2, t3 = tables
    d = df.join(t1.select(*keys, *season, F.col("ms").alias("_m1")), [*keys, *season], "left")
    d = d.join(t2.select(*keys, fallback, F.col("ms").alias("_m2")), [*keys, fallback], "left")
    d = attach(d, t3.select(*keys, F.col("ms").alias("_m3")), keys, "left")
    ms = F.coalesce("_m1", "_m2", "_m3")
    return d.withColumns({"mu": ms["mu"], "sd": F.greatest(ms["sd"], F.lit(EPS))}).drop("_m1", "_m2", "_m3")


def zscore(y: Column, mu: Column, sd: Column) -> Column:
    return F.abs(y - mu) / (sd + EPS)
