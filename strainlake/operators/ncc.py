"""Normalised cross-correlation as an equi-join of windows with themselves, aggregated by lag.

The lag is deformed minus reference, an explicit signed column, so odd windows are exact too. This kernel is for small
windows and for checks; large windows go through the transform kernel in ncc_fft.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

AXES = ("z", "y", "x")


def lag_range(w: int) -> tuple[int, int]:
    return -(w // 2), w - w // 2 - 1


def flat_index(window: tuple[int, int, int]):
    """The lag's place in an array whose negative lags wrap to the end: it settles ties."""
    wz, wy, wx = window
    return (F.pmod("kz", F.lit(wz)) * wy + F.pmod("ky", F.lit(wy))) * wx + F.pmod("kx", F.lit(wx))


def correlate(
    windows: DataFrame, window: tuple[int, int, int], mode: str = "linear", normalization: str = "overlap", eps: float = 1e-12,
    keys: tuple[str, ...] = ("poi",), reach: int | None = None,
) -> DataFrame:
    """(keys, jz, jy, jx, r, d) to (keys, kz, ky, kx, ncc). reach keeps only lags up to it on each axis: an option."""
    if mode == "cyclic" and normalization == "overlap":
        raise ValueError("cyclic correlation has no overlap normalization")
    ref = windows.select(*keys, *[F.col(f"j{a}").alias(f"r{a}") for a in AXES], F.col("r").cast("double").alias("r"))
    dfm = windows.select(*keys, *[F.col(f"j{a}").alias(f"d{a}") for a in AXES], F.col("d").cast("double").alias("d"))
    both = ref.join(dfm, list(keys))
    for a, w in zip(AXES, window, strict=True):
        lo, hi = lag_range(w)
        lag = F.col(f"d{a}") - F.col(f"r{a}")
        if mode == "cyclic":
            lag = F.pmod(lag - lo, F.lit(w)) + lo
        both = both.withColumn(f"k{a}", lag.cast("int"))
        if reach is not None:
            lo, hi = max(lo, -reach), min(hi, reach)
        both = both.where(F.col(f"k{a}").between(lo, hi))
    lags = [f"k{a}" for a in AXES]
    if normalization == "overlap":
        sums = both.groupBy(*keys, *lags).agg(F.sum(F.col("r") * F.col("d")).alias("rd"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("d") * F.col("d")).alias("dd"))
        scale = F.sqrt(F.greatest("rr", F.lit(0.0)) * F.greatest("dd", F.lit(0.0)) + eps)
        return sums.select(*keys, *lags, (F.col("rd") / scale).alias("ncc"))
    sums = both.groupBy(*keys, *lags).agg(F.sum(F.col("r") * F.col("d")).alias("rd"))
    energy = windows.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return sums.join(energy, list(keys)).select(*keys, *lags, (F.col("rd") / F.sqrt(F.col("rr") * F.col("dd") + eps)).alias("ncc"))
