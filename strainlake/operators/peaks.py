"""Integer peaks and their refinement to fractions of a voxel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strainlake.operators.ncc import AXES, flat_index


def integer_peak(corr: DataFrame, window: tuple[int, int, int], keys: tuple[str, ...] = ("poi",)) -> DataFrame:
    """The lag of the largest value over all lags; of equal values the one first in wrapped order."""
    best = F.max(F.struct("ncc", (-flat_index(window)).alias("f"), *[f"k{a}" for a in AXES])).alias("b")
    return corr.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.k{a}").alias(f"k{a}") for a in AXES], F.col("b.ncc").alias("confidence"))


def parabola(minus: Column, zero: Column, plus: Column, eps: float = 1e-12) -> Column:
    """The vertex of a parabola through three samples, of their logs if all are positive, within half a voxel."""
    positive = (minus > 0) & (zero > 0) & (plus > 0)
    vertex = lambda a, b, c: (a - c) / F.when(F.abs(2 * (a - 2 * b + c)) < eps, F.lit(eps)).otherwise(2 * (a - 2 * b + c))
    ln = lambda x: F.log(F.when(positive, x).otherwise(1.0))
    raw = F.when(positive, vertex(ln(minus), ln(zero), ln(plus))).otherwise(vertex(minus, zero, plus))
    return F.greatest(F.lit(-0.5), F.least(F.lit(0.5), raw))


def neighbours(corr: DataFrame, peaks: DataFrame, window: tuple[int, int, int], keys: tuple[str, ...] = ("poi",)) -> DataFrame:
    """peaks with the six samples next to each, wrapping at the window's edge: one join and one aggregate."""
    p = peaks.select(*keys, *[F.col(f"k{a}").alias(f"p{a}") for a in AXES])
    t = corr.join(p, list(keys))
    off = {a: F.pmod(F.col(f"k{a}") - F.col(f"p{a}"), F.lit(w)) for a, w in zip(AXES, window, strict=True)}
    aggs = []
    for a, w in zip(AXES, window, strict=True):
        same = F.lit(True)
        for o in AXES:
            if o != a:
                same = same & (off[o] == 0)
        aggs += [F.max(F.when(same & (off[a] == (w - 1) % w), F.col("ncc"))).alias(f"m{a}"), F.max(F.when(same & (off[a] == 1 % w), F.col("ncc"))).alias(f"n{a}")]
    return peaks.join(t.groupBy(*keys).agg(*aggs), list(keys))


def subvoxel(corr: DataFrame, window: tuple[int, int, int], keys: tuple[str, ...] = ("poi",), eps: float = 1e-12) -> DataFrame:
    """keys, integer lag, fraction per axis (f*), displacement (d*) and confidence, which is that of the integer peak."""
    t = neighbours(corr, integer_peak(corr, window, keys), window, keys)
    for a in AXES:
        t = t.withColumn(f"f{a}", parabola(F.col(f"m{a}"), F.col("confidence"), F.col(f"n{a}"), eps))
    return t.select(*keys, "kz", "ky", "kx", "fz", "fy", "fx", *[(F.col(f"k{a}") + F.col(f"f{a}")).alias(f"d{a}") for a in AXES], "confidence")


def gate(peaks: DataFrame, radius: float) -> DataFrame:
    """peaks with in_range: no component of the refined displacement beyond radius."""
    return peaks.withColumn("in_range", F.greatest(*[F.abs(f"d{a}") for a in AXES]) <= radius)
