"""Sums and means whose last bits do not depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: powers of two that share a partial sum
BIN_BITS = 20


def _power(bin_no: Column, sign: int) -> Column:
    """2 ** (sign * BIN_BITS * bin / 2): two factors, as one alone may leave the doubles."""
    return F.pow(F.lit(2.0), F.lit(sign * BIN_BITS / 2) * bin_no)


def exact_sums(df: DataFrame, groups: Sequence[str], col: str) -> DataFrame:
    """``groups, n, total``: how many values a group has, and their sum without rounding its terms.

    A sum of doubles changes its last bits with the partitioning, and with them every
    digest over values derived from it.  Values are taken apart by magnitude: those within
    one factor of 2**20 are scaled by a power of two, which loses nothing, to a whole part and
    52 bits behind it, and both are summed as whole numbers.  A magnitude is rounded once, and
    the few of a group are added in order.  NaN and infinities count as such.  Holds up to
    some 10**12 rows per group and magnitude.
    """
    groups = list(groups)
    v = F.col(col).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    finite = F.when(~odd, v)
    bin_no = F.coalesce(F.floor(F.log2(F.abs(finite)) / BIN_BITS), F.lit(0))
    rows = df.select(*groups, v.alias("_v"), finite.alias("_f"), bin_no.alias("_bin"))
    scaled = F.col("_f") * _power(F.col("_bin"), -1) * _power(F.col("_bin"), -1)
    whole = F.floor(scaled)
    rest = ((scaled - whole) * F.lit(2.0**52)).cast("long")
    binned = rows.groupBy(*groups, "_bin").agg(
        F.count("_v").alias("_n"),
        F.sum(whole).alias("_hi"),
        F.sum(rest.cast("decimal(20,0)")).alias("_lo"),
        F.sum(F.when(F.col("_f").isNull(), F.col("_v"))).alias("_odd"),
    )
    exact = F.col("_hi").cast("decimal(19,0)") * F.lit(2**52).cast("decimal(16,0)") + F.col("_lo")
    back = exact.cast("double") * F.lit(2.0**-52) * _power(F.col("_bin"), 1) * _power(F.col("_bin"), 1)
    part = F.when(F.col("_hi").isNotNull(), F.struct("_bin", back.alias("p")))
    parts = F.reverse(F.array_sort(F.collect_list(part)))
    total = F.aggregate(parts, F.lit(0.0), lambda t, x: t + x["p"])
    total = F.when(F.count("_hi") > 0, total)
    return binned.groupBy(*groups).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_odd"), total).alias("total")
    )


def exact_means(df: DataFrame, groups: Sequence[str], col: str, out: str) -> DataFrame:
    """``groups, out``: means by ``exact_sums``; null where a group has no value."""
    sums = exact_sums(df, groups, col)
    return sums.select(*groups, F.try_divide("total", F.col("n").cast("double")).alias(out))
