"""From raw rows to a clean keyed series with features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ContractError
from tidewatch.functions.exact import exact_sums
from tidewatch.operators.sequence import BLOCK_ROWS, attach, index_grid, index_rows, lagged

STEP = {"hour": 3600, "day": 86400}


def rollup(
    df: DataFrame,
    ts: str,
    value: str,
    every: str = "hour",
    agg: str = "sum",
    keys: Sequence[str] = (),
    out: str = "y",
) -> DataFrame:
    """One row per key and time step; sums keep every digit and do not depend on the order of rows."""
    at = F.date_trunc(every, F.col(ts).cast("timestamp")).alias("ts")
    if agg == "count":
        return df.groupBy(*keys, at).agg(F.count(F.col(value)).cast("double").alias(out))
    if agg not in ("sum", "avg"):
        raise ValueError(f"unknown aggregate: {agg}")
    sums = exact_sums(df.select(*keys, at, F.col(value).alias("_value")), [*keys, "ts"], "_value")
    y = F.col("total") if agg == "sum" else F.try_divide("total", F.col("n").cast("double"))
    return sums.select(*keys, "ts", y.alias(out))


def densify(
    rolled: DataFrame,
    every: str = "hour",
    keys: Sequence[str] = (),
    value: str = "y",
    fill: float | None = 0.0,
    common_range: bool = False,
) -> DataFrame:
    """Put a row at every step between first and last timestamp of a key.

    With ``common_range`` all keys get the range of all, which one bad timestamp widens for all.

    The spine is unioned under the rolled-up rows and grouped once, which needs no
    join.  Long ranges are exploded in two steps (days, then steps of a day).
    """
    keys = list(keys)
    ends = rolled.groupBy(*([] if common_range else keys)).agg(
        F.min("ts").alias("_a"), F.max("ts").alias("_b")
    )
    if keys:
        ids = rolled.select(*keys).distinct() if common_range else ends
        ends = attach(ids, ends, []) if common_range else ends
    days = ends.withColumn(
        "_d", F.explode(F.expr("sequence(date_trunc('day', _a), date_trunc('day', _b), interval 1 day)"))
    )
    if every == "hour":
        days = days.withColumn("ts", F.explode(F.expr("sequence(_d, _d + interval 23 hours, interval 1 hour)")))
    else:
        days = days.withColumn("ts", F.col("_d"))
    spine = days.where(F.col("ts").between(F.col("_a"), F.col("_b")))
    spine = spine.select(*keys, "ts", F.lit(None).cast("double").alias(value))
    both = rolled.select(*keys, "ts", value).unionByName(spine)
    out = both.groupBy(*keys, "ts").agg(F.max(value).alias(value))
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def dedupe_first(
    df: DataFrame, ts: str = "ts", keys: Sequence[str] = (), ingest_no: str = "ingest_no"
) -> DataFrame:
    """Keep the row read first for every timestamp.

    An aggregate, not a ranking window: copies collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in (*keys, ts)]
    return (
        df.groupBy(*keys, ts)
        .agg(F.min_by(F.struct(*rest), F.col(ingest_no)).alias("_r"))
        .select(*keys, ts, *[F.col("_r")[c].alias(c) for c in rest])
    )


def add_lags(
    df: DataFrame, y: str, lags: Sequence[int], keys: Sequence[str] = (), rows: int = BLOCK_ROWS
) -> DataFrame:
    """Row lags, not time lags; needs ``row_no`` (see ``index_rows``)."""
    return lagged(df, keys, {f"lag_{n}": (y, n) for n in lags}, rows)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def clip_range(df: DataFrame, reference: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows inside the time range of another series, both ends included."""
    ends = reference.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    d = attach(df, ends, keys)
    return d.where(F.col(ts).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def recent(df: DataFrame, days: float, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows not older than ``days`` before the last one."""
    last = df.groupBy(*keys).agg(F.max(F.unix_seconds(ts)).alias("_b"))
    d = attach(df, last, keys)
    return d.where(F.unix_seconds(ts) >= F.col("_b") - int(days * 86400)).drop("_b")


def fill_missing_covariates(df: DataFrame, profile: str, defaults: dict[str, float]) -> DataFrame:
    """Only demonstrations may run with made-up covariates."""
    missing = [c for c in defaults if c not in df.columns]
    if missing and profile != "demo":
        raise ContractError(f"missing columns: {missing}")
    return df.withColumns({c: F.lit(defaults[c]) for c in missing})


def merge_target(
    covariates: DataFrame,
    target: DataFrame,
    how: str = "inner",
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    ratio_of: str = "smaller",
) -> tuple[DataFrame, DataFrame]:
    """Join on time; the report counts both sides and what met.

    ``ratio_of="smaller"`` divides by the smaller side; the ratio to the larger
    side is reported as well, since a tiny target table makes the first look good.
    """
    keys = list(keys)
    side = covariates.withColumn("_c", F.lit(1))
    merged = side.join(target, [*keys, ts], how).where(F.col(y).isNotNull())
    # one tagged union and one aggregate give all counts
    tag = lambda df, name: df.select(*keys, F.lit(name).alias("_side"))
    counts = tag(covariates, "c").unionByName(tag(target, "t")).unionByName(tag(merged, "m"))
    n = lambda s: F.count_if(F.col("_side") == s)
    report = counts.groupBy(*keys).agg(
        n("c").alias("covariate_rows"), n("t").alias("target_rows"), n("m").alias("merged_rows")
    )
    small = F.greatest(F.least("covariate_rows", "target_rows"), F.lit(1))
    large = F.greatest("covariate_rows", "target_rows", F.lit(1))
    report = report.withColumns(
        {
            "overlap_ratio": F.col("merged_rows") / (small if ratio_of == "smaller" else large),
            "overlap_of_larger": F.col("merged_rows") / large,
            "merge_how": F.lit(how),
        }
    )
    return merged.drop("_c"), report


def require_overlap(report: DataFrame, min_overlap: float) -> DataFrame:
    """Contract rows for merges below the wanted overlap."""
    return report.where(
        (F.col("merged_rows") == 0) | (F.col("overlap_ratio") < min_overlap)
    ).withColumn("rule_id", F.lit("merge_overlap"))


def prepared(
    series: DataFrame,
    y: str,
    lags: Sequence[int],
    keys: Sequence[str] = (),
    step_seconds: int = 3600,
    complete: bool = False,
) -> DataFrame:
    """Index a series, add row lags, drop the rows without full history, re-index.

    ``complete`` says the series has a non-null value at every step (``densify``
    makes it so); row numbers are then arithmetic and need no counting pass.
    """
    if complete:
        indexed = index_grid(series, keys, "ts", step_seconds)
        full = add_lags(indexed, y, lags, keys).where(F.col("row_no") >= max(lags))
        return full.withColumn("row_no", F.col("row_no") - max(lags))
    span = step_seconds * BLOCK_ROWS * 1_000_000
    indexed = index_rows(series, keys, "ts", span)
    full = drop_incomplete(add_lags(indexed, y, lags, keys)).drop("row_no")
    return index_rows(full, keys, "ts", span)
