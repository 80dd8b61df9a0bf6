"""Tapers and the preprocessing of windows: masked mean off, taper, masked voxels back to zero."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def tukey(index: Column, n: int, alpha: float) -> Column:
    """The Tukey taper at index 0..n-1: 1 for alpha 0, Hann for alpha 1, 1 for a single sample."""
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must lie in [0, 1], got {alpha}")
    if n == 1 or alpha == 0:
        return F.lit(1.0)
    edge = alpha * (n - 1) / 2
    near = F.least(index, F.lit(n - 1) - index).cast("double")
    return F.when(near < edge, 0.5 * (1 + F.cos(F.lit(pi) * (near / edge - 1)))).otherwise(1.0)


def tukey_of(index: Column, n: Column, alpha: Column) -> Column:
    """The taper where length and alpha differ from row to row; alpha beyond 0..1 gives null."""
    edge = alpha * (n - 1) / 2
    near = F.least(index, n - 1 - index).cast("double")
    edged = F.when(near < edge, 0.5 * (1 + F.cos(F.lit(pi) * (near / F.when(edge > 0, edge) - 1)))).otherwise(1.0)
    return F.when((alpha >= 0) & (alpha <= 1), F.when((n == 1) | (alpha == 0), 1.0).otherwise(edged))


def tukey_1d(spark: SparkSession, n: int, alpha: float) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), tukey(F.col("id"), n, alpha).alias("w"))


def tukey_3d(window: tuple[int, int, int], alpha: float) -> Column:
    """The separable taper over columns jz, jy, jx."""
    out = F.lit(1.0)
    for a, n in zip("zyx", window, strict=True):
        out = out * tukey(F.col(f"j{a}"), n, alpha)
    return out


def preprocess(windows: DataFrame, window: tuple[int, int, int], alpha: float, value: str = "v", mask: str | None = None, keys: tuple[str, ...] = ("poi",), out: str | None = None) -> DataFrame:
    """value less its masked mean (of at least one voxel), tapered, zero where masked."""
    m = F.lit(1.0) if mask is None else F.when(F.col(mask), 1.0).otherwise(0.0)
    by = Window.partitionBy(*keys)
    mean = F.sum(F.col(value) * m).over(by) / F.greatest(F.sum(m).over(by), F.lit(1.0))
    return windows.withColumn(out or value, (F.col(value) - mean) * tukey_3d(window, alpha) * m)
