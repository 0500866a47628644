"""Ordered work on keyed series without putting a whole series in one task.

A window ``partitionBy(keys).orderBy(ts)`` sends one key to one task.  Here every
series gets a dense row number and is cut into blocks of ``BLOCK_ROWS`` rows;
windows run per ``(keys, block)``.  What a block needs from earlier rows comes
either as a *halo* (copies of the few rows before it) or as a *carry* (one summary
row per block, scanned over blocks, which is smaller by the block size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stage_table

BLOCK_ROWS = 8192
#: rows that a partition of ordered rows is laid out for
PARTITION_ROWS = 500_000


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add per-key values.  Without keys ``small`` is one row: a scalar subquery."""
    if keys:
        return df.join(small, list(keys), how)
    one = small.select(F.struct(*small.columns)).scalar()
    return df.withColumn("_one", one).select(
        *df.columns, *[F.col("_one")[c].alias(c) for c in small.columns]
    )


def micros(ts: str | Column) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col)


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    span: int | None = None,
    out: str = "row_no",
    bound: int = PARTITION_ROWS,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Dense row number from 0 per key, in the order of a column; ``ties`` order rows that are equal in it.

    Values on a grid: ``span`` is the width of a range in the units of ``order`` (microseconds for
    timestamps).  Ranges are counted (map-side combined), counts are prefix-summed, and rows are ranked
    inside their range only.  Other values, sparse or clustered: see ``number_rows``, in partitions of about
    ``bound`` rows.
    """
    keys = list(keys)
    if span is None:
        return number_rows(df, keys, [order, *ties], out, bound)
    is_ts = df.schema[order].dataType.typeName().startswith("timestamp")
    pos = micros(F.col(order).cast("timestamp")) if is_ts else F.col(order).cast("bigint")
    d = df.withColumn("_vb", F.floor(pos / F.lit(span)))
    over = Window.partitionBy(*keys).orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_vb")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_vb", F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_off"))
    )
    rank = Window.partitionBy(*keys, "_vb").orderBy(order, *ties)
    return (
        d.join(offsets, [*keys, "_vb"])
        .withColumn(out, F.row_number().over(rank) - 1 + F.col("_off"))
        .drop("_vb", "_off")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no", bound: int = PARTITION_ROWS
) -> DataFrame:
    """Dense row number from 0 per key, in the order of some columns.

    Rows are partitioned by ranges of (keys, order), as many as the rows ask for, and sorted, so a hot key
    spreads over many partitions and small keys share one.  A row's place in its partition, less that of its
    key's first row there, plus the rows of the key in the partitions before, is its number: one small row per
    key and partition is all that is summed up.  The ordered rows are staged, as their places have to hold.
    """
    keys, by = list(keys), [*keys, *order]
    least = df.sparkSession.sparkContext.defaultParallelism
    parts = max(least, -(-df.count() // bound))
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = placed.withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    placed = stage_table(placed, "ordered")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    offset = F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")
    offsets = firsts.select(*keys, "_part", offset.alias("_off"))
    return placed.join(offsets, [*keys, "_part"]).withColumn(out, F.col("_at") + F.col("_off")).drop("_part", "_at", "_off")


def index_grid(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int, out: str = "row_no") -> DataFrame:
    """Row number of a gap-free series: plain arithmetic on the first timestamp."""
    first = df.groupBy(*keys).agg(F.min(F.unix_seconds(ts)).alias("_t0"))
    d = attach(df, first, keys)
    no = ((F.unix_seconds(ts) - F.col("_t0")) / step_seconds).cast("bigint")
    return d.withColumn(out, no).drop("_t0")


def blocked(df: DataFrame, rows: int = BLOCK_ROWS, halo: int = 0, row_no: str = "row_no") -> DataFrame:
    """Add ``_blk``; with a halo also copy each block's last rows into the next one."""
    own = F.floor(F.col(row_no) / rows)
    if not halo:
        return df.withColumn("_blk", own).withColumn("_halo", F.lit(False))
    if halo > rows:
        raise ValueError("a block must be at least as long as its halo")
    here = F.struct(own.alias("b"), F.lit(False).alias("h"))
    ahead = F.struct((own + 1).alias("b"), F.lit(True).alias("h"))
    copies = F.when(F.col(row_no) % rows >= rows - halo, F.array(here, ahead)).otherwise(F.array(here))
    return df.withColumn("_to", F.explode(copies)).select(
        *df.columns, F.col("_to.b").alias("_blk"), F.col("_to.h").alias("_halo")
    )


def block_window(keys: Sequence[str], row_no: str = "row_no"):
    return Window.partitionBy(*keys, "_blk").orderBy(row_no)


def before_blocks(keys: Sequence[str]):
    """All earlier blocks of the series, on a one-row-per-block table."""
    return Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)


def after_blocks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, tuple[str, int]],
    rows: int = BLOCK_ROWS,
    row_no: str = "row_no",
) -> DataFrame:
    """Row lags: ``{"out": (column, n)}``.  One shuffle, one sort for all of them."""
    halo = max(n for _, n in columns.values())
    d = blocked(df, max(rows, halo), halo, row_no)
    w = block_window(keys, row_no)
    for out, (col, n) in columns.items():
        d = d.withColumn(out, F.lag(col, n).over(w))
    return d.where(~F.col("_halo")).drop("_blk", "_halo")
