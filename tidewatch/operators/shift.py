"""How far one sequence is shifted against another, for all shifts at once.

Comparing every shift row by row needs n*n pairs.  The correlation over all shifts
is a product in Fourier space, and a transform of length n1*n2 splits into n2
transforms of length n1 and n1 of length n2.  So two shuffles with groups of about
the square root of the series length replace the pair join.  Short series are
transformed whole, many of one length class in a group.

A transform still shuffles some hundred bytes a row, so what can be told without it is: a line that is rare in
the other text leaves few rotations to verify, and series that fit at lag 0 better than the energy of their
ends allows at any other lag are not shifted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.sequence import attach
from tidewatch.session import spread, stage_table

#: cells (twice the rows, to a power of two) up to which a series is transformed whole; cells of a group of such series
SHORT_CELLS = 1 << 14
PACK_CELLS = 1 << 20
#: lines that are looked up in the other text, and rotations that are verified one by one
PROBES, FEW = 32, 64


def _sizes(n: Column) -> dict[str, Column]:
    """Both factors of the transform of a series of ``n`` rows: together a power of two of at least twice its length."""
    bits = F.greatest(F.lit(2), F.ceil(F.log2(2.0 * F.greatest(n, F.lit(1)))).cast("int"))
    half = F.floor(bits / 2).cast("int")
    return {"_n1": F.pow(F.lit(2.0), half).cast("long"), "_n2": F.pow(F.lit(2.0), bits - half).cast("long")}


def _pass(df: DataFrame, keys: list[str], length: str, spins: bool, cols: list[str]) -> DataFrame:
    """Transform each group ``g`` over its positions ``p``, as many as the series' ``length`` says; absent positions are 0."""
    parts = [f"{c}_{x}" for c in cols for x in ("re", "im")]
    whole = ["_n1", "_n2", "g", "p"]
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField(c, T.LongType()) for c in whole]
        + [T.StructField(c, T.DoubleType()) for c in parts]
    )

    def transform(rows: pa.Table) -> pa.Table:
        at = rows["p"].to_numpy()
        g, n1, n2 = (rows[c][0].as_py() for c in ("g", "_n1", "_n2"))
        n = rows[length][0].as_py()
        spin = np.exp(-2j * np.pi * g * np.arange(n) / (n1 * n2)) if spins else 1.0
        out = {k: pa.repeat(rows[k][0], n) for k in keys}
        out |= {"_n1": np.full(n, n1), "_n2": np.full(n, n2), "g": np.full(n, g), "p": np.arange(n)}
        for c in cols:
            z = np.zeros(n, dtype=complex)
            z[at] = rows[f"{c}_re"].to_numpy() + 1j * rows[f"{c}_im"].to_numpy()
            z = np.fft.fft(z) * spin
            out[f"{c}_re"], out[f"{c}_im"] = z.real, z.imag
        return pa.table(out)

    d = spread(df.select(*keys, *whole, *parts), *keys, "g")
    return d.groupBy(*keys, "g").applyInArrow(transform, schema)


def _transform(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Fourier transform over ``j``; gives the same columns over frequency ``j``."""
    first = df.withColumns({"g": F.col("j") % F.col("_n2"), "p": F.floor(F.col("j") / F.col("_n2"))})
    mid = _pass(first, keys, "_n1", True, cols)
    rest = [c for c in mid.columns if c not in ("g", "p")]
    mid = mid.select(F.col("p").alias("g"), F.col("g").alias("p"), *rest)
    done = _pass(mid, keys, "_n2", False, cols)
    return done.withColumn("j", F.col("g") + F.col("p") * F.col("_n1")).drop("g", "p")


def correlate(df: DataFrame, keys: Sequence[str] = (), length: str = "n") -> DataFrame:
    """``keys, lag, corr`` with ``corr(lag) = sum_i a[i+lag] * b[i]`` for every lag.

    Input: ``keys, j`` (position from 0), values ``a``, ``b``, and the rows of the series in ``length``: each
    series is transformed at its own length, not at that of the longest.
    """
    keys = list(keys)
    zero = F.lit(0.0)
    z = df.select(
        *keys,
        F.col("j").cast("bigint").alias("j"),
        F.col("a").cast("double").alias("a_re"),
        zero.alias("a_im"),
        F.col("b").cast("double").alias("b_re"),
        zero.alias("b_im"),
        *[size.alias(c) for c, size in _sizes(F.col(length)).items()],
    )
    s = _transform(z, keys, ["a", "b"])
    product = s.select(
        *keys,
        "_n1",
        "_n2",
        "j",
        (F.col("a_re") * F.col("b_re") + F.col("a_im") * F.col("b_im")).alias("c_re"),
        (F.col("a_re") * F.col("b_im") - F.col("a_im") * F.col("b_re")).alias("c_im"),
    )
    back = _transform(product, keys, ["c"])
    total = F.col("_n1") * F.col("_n2")
    lag = F.when(F.col("j") < total / 2, F.col("j")).otherwise(F.col("j") - total)
    return back.select(*keys, lag.alias("lag"), (F.col("c_re") / total).alias("corr"))


def _packed_lags(df: DataFrame, keys: list[str], tie: float) -> DataFrame:
    """``keys, shift, corr`` of short series: many of one length class are the rows of one matrix.

    Input: ``keys, j, a, b, _na, _norm`` and ``_cells`` (a power of two), ``_pack`` (a bounded share of a class).
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("shift", T.LongType()), T.StructField("corr", T.DoubleType())])

    def best(rows: pa.Table) -> pa.Table:
        cells = rows["_cells"][0].as_py()
        series = rows.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(rows), np.int64)
        _, first = np.unique(series, return_index=True)
        a, b = np.zeros((len(first), cells)), np.zeros((len(first), cells))
        at = rows["j"].to_numpy()
        a[series, at], b[series, at] = rows["a"].to_numpy(), rows["b"].to_numpy()
        corr = np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), cells)
        lag = np.arange(cells)
        lag = np.where(lag < cells // 2, lag, lag - cells)
        order = np.argsort(lag, kind="stable")
        lag, corr = lag[order], corr[:, order]
        corr[np.abs(lag) >= rows["_na"].to_numpy()[first][:, None]] = -np.inf
        top = corr.max(axis=1)
        near = corr >= (top - tie * rows["_norm"].to_numpy()[first])[:, None]
        out = {k: rows[k].take(first) for k in keys}
        return pa.table(out | {"shift": lag[near.argmax(axis=1)].astype(np.int64), "corr": top})

    by = ["_cells", "_pack"]
    return spread(df, *by).groupBy(*by).applyInArrow(best, schema)


def _not_shifted(df: DataFrame, keys: list[str], tie: float) -> DataFrame:
    """``keys, shift, corr`` of centred series for which no lag but 0 can come near.

    Every other lag leaves out the first row of one series and the last of the other, so its correlation is at most
    the root of the energies without those (Cauchy-Schwarz).  Where lag 0 lies above that by more than ties and
    rounding, it is the answer.  Input: ``keys, j, a, b, _na, _norm``.
    """
    last = F.col("_na") - 1
    at = lambda c, j: F.max(F.when(F.col("j") == j, F.col(c) * F.col(c)))
    d = df.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b")).alias("corr"),
        F.sum(F.col("a") * F.col("a")).alias("_ea"),
        F.sum(F.col("b") * F.col("b")).alias("_eb"),
        *[at(c, j).alias(f"_{c}{side}") for c in ("a", "b") for side, j in (("0", F.lit(0)), ("1", last))],
        F.max("_norm").alias("_norm"),
        ((F.min("j") == 0) & (F.max("j") == F.max("_na") - 1) & (F.count("j") == F.max("_na"))).alias("_whole"),
    )
    bound = lambda a, b: F.sqrt((F.col("_ea") - F.col(a)) * (F.col("_eb") - F.col(b)))
    most = F.greatest(bound("_a0", "_b1"), bound("_a1", "_b0"))
    sure = F.col("_whole") & (F.col("corr") - most > 2 * tie * F.col("_norm"))
    return d.where(sure).select(*keys, F.lit(0).cast("bigint").alias("shift"), "corr")


def xcorr_lag(
    base: DataFrame,
    current: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    order: str = "row_no",
    tie: float = 1e-9,
) -> DataFrame:
    """``keys, shift, corr``: where the centred series fit best, over all lags.

    Values closer than ``tie`` of the norm are equal, and then the lowest lag is
    taken.  No row when the lengths differ or a series does not vary.
    """
    keys = list(keys)
    zero = F.lit(0.0)
    a = base.select(*keys, F.col(order).alias("j"), F.coalesce(F.col(value).cast("double"), zero).alias("a"))
    b = current.select(*keys, F.col(order).alias("j"), F.coalesce(F.col(value).cast("double"), zero).alias("b"))
    both = stage_table(a.join(b, [*keys, "j"], "full"), "shift-input")
    stats = both.groupBy(*keys).agg(
        F.avg("a").alias("_ma"),
        F.avg("b").alias("_mb"),
        F.count("a").alias("_na"),
        F.count("b").alias("_nb"),
        F.sqrt(F.var_pop("a") * F.var_pop("b")).alias("_sd"),
    )
    stats = stats.where((F.col("_na") == F.col("_nb")) & (F.col("_na") > 1) & (F.col("_sd") > 0))
    sizes = _sizes(F.col("_na"))
    stats = stats.withColumns({"_norm": F.col("_sd") * F.col("_na"), "_cells": sizes["_n1"] * sizes["_n2"]})
    stats = stage_table(stats, "shift-stats")
    # a class of short series: as many to a group as fill a matrix of PACK_CELLS; some dozen classes at most
    short = F.col("_cells") <= SHORT_CELLS
    packs = {r["_cells"]: -(-r["count"] * r["_cells"] // PACK_CELLS) for r in stats.where(short).groupBy("_cells").count().collect()}
    ready = attach(both, stats, keys).where(F.col("_na").isNotNull()).select(
        *keys, "j", (F.col("a") - F.col("_ma")).alias("a"), (F.col("b") - F.col("_mb")).alias("b"), "_na", "_norm", "_cells"
    )
    found, long = [], stats.where(~short)
    if packs:
        share = F.coalesce(*[F.when(F.col("_cells") == cells, n) for cells, n in packs.items()])
        pack = F.pmod(F.xxhash64(*keys) if keys else F.lit(0).cast("long"), share.cast("long"))
        found.append(_packed_lags(ready.where(short).withColumn("_pack", pack), keys, tie))
    if not packs or not long.isEmpty():
        kept = stage_table(_not_shifted(ready.where(~short), keys, tie), "shift-none")
        found.append(kept)
        long = long.join(kept, keys, "left_anti") if keys else long.where(F.lit(kept.isEmpty()))
        if not long.isEmpty():
            rest = ready.where(~short)
            rest = rest.join(long.select(*keys), keys, "left_semi") if keys else rest
            corr = stage_table(correlate(rest, keys, "_na"), "shift-correlation")
            corr = attach(corr, long.select(*keys, "_na", "_norm"), keys).where(F.abs("lag") < F.col("_na"))
            best = corr.groupBy(*keys).agg(F.max("corr").alias("_max"))
            near = attach(corr, best, keys).where(F.col("corr") >= F.col("_max") - tie * F.col("_norm"))
            out = near.groupBy(*keys).agg(F.min("lag").alias("shift"), F.max("corr").alias("corr"))
            found.append(out.where(F.col("shift").isNotNull()))
    return functools.reduce(DataFrame.unionByName, found)


def circular_shift(base: DataFrame, current: DataFrame, line: str = "line", order: str = "row_no") -> DataFrame:
    """``shift`` when ``current`` is ``base`` rotated (not by 0), else no row.

    A line that is in few places of ``current`` leaves as many rotations.  If there is none, lines
    become random numbers by hash; a rotation that fits has the correlation of the lines with
    themselves.  Repeated lines cost nothing extra.  The earliest
    fit is then verified line by line, and the next one tried if it does not hold.
    """
    spark = base.sparkSession
    schema = "shift bigint"
    number = (F.pmod(F.xxhash64(line), F.lit(65536)) - 32768).cast("double")
    a = base.select(F.col(order).alias("j"), F.col(line).alias("x"), number.alias("v"))
    b = current.select(F.col(order).alias("j"), F.col(line).alias("y"), number.alias("v"))
    # whole numbers summed as such: exact in any order and at any length
    whole = F.col("v").cast("long")
    square = (whole * whole).cast("decimal(38,0)")
    total = lambda d: d.agg(F.count(F.lit(1)), F.sum(whole.cast("decimal(38,0)")), F.sum(square)).first()
    mine = total(a)
    if mine[0] < 2 or mine != total(b):
        return spark.createDataFrame([], schema)
    n, energy = mine[0], float(mine[2])
    a, b = stage_table(a, "rotate-a"), stage_table(b, "rotate-b")
    for at in _rotations(a, b, n, energy):
        moved = a.select(((F.col("j") + at) % n).alias("j"), "x")
        if moved.join(b, "j").where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty():
            shift = (n - at) % n
            return spark.createDataFrame([(shift,)] if shift else [], schema)
    return spark.createDataFrame([], schema)


def _rotations(a: DataFrame, b: DataFrame, n: int, energy: float) -> Iterator[int]:
    """Rotations that may fit, in order: ``a`` moved on by as many rows is ``b``."""
    few = _few_rotations(a, b, n)
    if few is not None:
        yield from few
        return
    twice = b.select(F.explode(F.array(F.col("j"), F.col("j") + n)).alias("j"), F.col("v").alias("a"))
    pairs = twice.join(a.select("j", F.col("v").alias("b")), "j", "left").na.fill(0.0, ["b"])
    corr = correlate(pairs.withColumn("n", F.lit(2 * n)))
    tol = max(1.0, energy * 1e-12)
    fits = stage_table(
        corr.where(F.col("lag").between(0, n - 1) & (F.abs(F.col("corr") - energy) <= tol)), "rotate-fits"
    )
    at = -1
    while True:
        at = fits.where(F.col("lag") > at).agg(F.min("lag")).first()[0]
        if at is None:
            return
        yield at


def _few_rotations(a: DataFrame, b: DataFrame, n: int) -> list[int] | None:
    """All rotations that may fit, if one of some lines of ``a`` is found in few places of ``b``; else None.

    The line has to be moved to one of those places.  Sums of hashes of (line, place) leave those that fit.
    """
    probes = a.where(F.col("j").isin(sorted({n * i // PROBES for i in range(PROBES)})))
    place = {r["h"]: r["j"] for r in probes.select("j", F.xxhash64("x").alias("h")).collect()}
    if not place:
        return None
    there = b.select("j", F.xxhash64("y").alias("h")).where(F.col("h").isin(list(place)))
    times = {r["h"]: r["count"] for r in there.groupBy("h").count().collect()}
    line = min(place, key=lambda h: times.get(h, 0))
    if times.get(line, 0) > FEW:
        return None
    ats = sorted((r["j"] - place[line]) % n for r in there.where(F.col("h") == line).collect())
    if not ats:
        return []
    mark = lambda line, j: F.bit_xor(F.xxhash64(F.lit("line"), line, j.cast("bigint")))
    moved = a.agg(*[mark(F.col("x"), (F.col("j") + at) % n).alias(f"m{i}") for i, at in enumerate(ats)]).first()
    wanted = b.agg(mark(F.col("y"), F.col("j"))).first()[0]
    return [at for at, m in zip(ats, moved, strict=True) if m == wanted]
