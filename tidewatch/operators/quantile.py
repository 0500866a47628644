"""Exact interpolated quantiles by radix selection.

A wanted quantile lies between two ranks of its group.  Values are numbered by *cells* that
keep their order: the first digit of a cell is the value's sign, power of two and 64th of it, the
next ones are 65,536ths of the cell before.  Counting rows per cell combines before the shuffle,
a running sum over the cells of a group (at most a few hundred thousand, whatever the rows) shows
in which cells the wanted ranks lie, and only the rows of those cells are looked at again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.sequence import attach
from tidewatch.session import stage_table

#: rows in a cell beyond which it is cut finer before its values are counted
ONE_RUN = 100_000
#: cells of a power of two, and of a cell that is cut again
FIRST = 64
AGAIN = 65_536
#: digits of the finest cells; beyond them a cell holds a few thousand doubles at most
DIGITS = 3


def digits(v: Column) -> list[Column]:
    """The digits of a value's cell, each non-decreasing in the value among equal digits before.

    The power of two comes from a logarithm, which may be off by one next to a power.  It is off
    the same way for all values up to there, so the order holds, and no more is needed.
    """
    size = F.abs(v)
    sign = F.signum(v)
    power = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1100)), F.lit(1100)).cast("int")
    # two factors, as one alone may leave the doubles
    half = F.pow(F.lit(2.0), power * -0.5)
    place = F.least((size * half * half - 1.0) * FIRST, F.lit(float(2 * FIRST)))
    out, cells = [], FIRST
    for no in range(DIGITS):
        digit = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(cells - 1))
        whole = (power + 1101) * FIRST + digit if no == 0 else digit
        out.append(F.when(v == 0, F.lit(0)).otherwise(sign * whole).cast("long"))
        place, cells = (place - digit) * AGAIN, AGAIN
    return out


def wanted_ranks(n: Column, qs: Sequence[float]) -> Column:
    """The ranks on both sides of every quantile, from 0."""
    at = F.transform(F.array(*[F.lit(float(q)) for q in qs]), lambda q: q * (n - 1))
    return F.array_distinct(F.concat(F.transform(at, lambda r: F.floor(r)), F.transform(at, lambda r: F.ceil(r))))


def _join(rows: DataFrame, cells: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of the given cells, with what the cells carry; a null group is a group."""
    if not by:
        return rows if how == "left_semi" else attach(rows, cells, [])
    named = cells.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in cells.columns if c not in by])
    same = [rows[c].eqNullSafe(named[f"_by{i}"]) for i, c in enumerate(by)]
    return rows.join(named, same, how).drop(*[f"_by{i}" for i in range(len(by))])


def _holding(cells: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Cells that hold wanted ranks: ``_off`` rows come before one, ``_c`` are in it, ``_ranks`` lie there."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    off = F.col("_off") + F.coalesce(F.sum("_c").over(run), F.lit(0))
    there = lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_c"))
    return cells.withColumn("_off", off).withColumn("_ranks", F.filter("_ranks", there)).where(F.size("_ranks") > 0)


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    qs: Sequence[float],
    out: str = "quantiles",
    one_run: int = ONE_RUN,
    by_gap: bool = False,
) -> DataFrame:
    """``(groups..., n, quantiles array<double>)``, linear interpolation.

    The values are staged once.  As long as a group, or a cell with a wanted rank, has more than ``one_run``
    rows and there are digits left, its rows are counted by one more digit; then the distinct values of
    the wanted cells are counted and the ranks read off.  Selection is exact and there is one formula,
    so ``one_run`` never shows in a result.  A quantile between two equal values is that value.  Null
    and NaN values are ignored.

    Two values are weighted and summed, as Spark's ``percentile`` does it; the two products round, so between
    neighbouring doubles the sum may land on the wrong one, and fall as the quantile grows.  ``by_gap`` goes a
    share of their gap from the nearer one instead, as numpy does, which never falls.
    """
    groups = list(groups)
    qs = [float(q) for q in qs]
    v = F.col(value).cast("double")
    values = stage_table(df.select(*groups, v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)"), "values")
    names = [f"_d{i}" for i in range(DIGITS)]
    digit = dict(zip(names, digits(F.col("_v"))))
    count = F.count(F.lit(1)).alias("_c")
    whole = {"_off": F.lit(0).cast("long"), "_ranks": wanted_ranks(F.col("n"), qs)}
    most = lambda cells: cells.agg(F.max("_c")).first()[0] or 0

    by = groups
    cells = values.groupBy(*groups).agg(count).withColumn("n", F.col("_c")).withColumns(whole)
    if values.count() > one_run and most(cells.select("_c")) > one_run:
        by = [*groups, names[0]]
        counted = values.groupBy(*groups, digit[names[0]].alias(names[0])).agg(count)
        counted = counted.withColumn("n", F.sum("_c").over(Window.partitionBy(*groups))).withColumns(whole)
        cells = stage_table(_holding(counted, groups, names[0]), "cells")
        for name in names[1:]:
            if most(cells) <= one_run:
                break
            rows = _join(values.withColumns({c: digit[c] for c in by if c in digit}), cells, by, "left_semi")
            finer = rows.groupBy(*by, digit[name].alias(name)).agg(count)
            cells = stage_table(_holding(_join(finer, cells.drop("_c"), by), by, name), "cells")
            by = [*by, name]

    rows = values.withColumns({c: digit[c] for c in by if c in digit})
    rows = rows if by == groups else _join(rows, cells, by, "left_semi")
    distinct = rows.groupBy(*by, "_v").agg(count)
    hits = _holding(_join(distinct, cells.drop("_c"), by), by, "_v")
    # at most two ranks per quantile reach this map
    pairs = F.flatten(F.collect_list(F.transform("_ranks", lambda r: F.struct(r.alias("r"), F.col("_v").alias("v")))))
    found = hits.groupBy(*groups).agg(F.first("n").alias("n"), F.map_from_entries(pairs).alias("_at"))

    def between(q: Column) -> Column:
        at = q * (F.col("n") - 1)
        low, high = F.col("_at")[F.floor(at)], F.col("_at")[F.ceil(at)]
        down, up, gap = F.ceil(at) - at, at - F.floor(at), high - low
        weighted = F.when(low == high, low).otherwise(down * low + up * high)
        if not by_gap:
            return weighted
        # a gap beyond the doubles, or next to an infinity, is no number to go by
        stepped = F.when(up < 0.5, low + up * gap).otherwise(high - down * gap)
        return F.when((low != high) & (gap < float("inf")), stepped).otherwise(weighted)

    return found.select(*groups, "n", F.transform(F.array(*[F.lit(q) for q in qs]), between).alias(out))


def quantile_columns(
    df: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """Several columns, one quantile each: ``{"out": (column, q)}``, in one pass.

    The columns go into a long table first, so they share every shuffle.
    """
    qs = sorted({q for _, q in wanted.values()})
    cols = sorted({c for c, _ in wanted.values()})
    long = df.select(
        *groups,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in cols])
        ).alias("_s"),
    ).select(*groups, F.col("_s.m").alias("_m"), F.col("_s.v").alias("_x"))
    table = exact_quantiles(long, [*groups, "_m"], "_x", qs)
    return table.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("_m") == c, F.col("quantiles")[qs.index(q)])).alias(out)
            for out, (c, q) in wanted.items()
        ]
    )
