"""Synthetic volumes: textures, warped copies, and phantoms with texture."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strainlake.config import Lattice, triple
from strainlake.functions import phantom, signal
from strainlake.functions.fields import Field, with_field
from strainlake.operators.lattice import lattice_table


def voxel_grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    nz, ny, nx = triple(shape, "shape")
    return spark.range(nz * ny * nx).select(F.expr(f"int(id div {ny * nx})").alias("z"), F.expr(f"int(id div {nx} % {ny})").alias("y"), F.expr(f"int(id % {nx})").alias("x"))


def white_noise(spark: SparkSession, shape: tuple[int, int, int], seed: int = 0) -> DataFrame:
    """Standard normal voxels, one generator per z slab: the same for any number of partitions."""
    nz, ny, nx = triple(shape, "shape")

    def run(batches):
        for b in batches:
            for z in b.column(0).to_pylist():
                v = np.random.default_rng([seed, z]).standard_normal(ny * nx)
                i = np.arange(ny * nx)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), z, np.int32)), pa.array((i // nx).astype(np.int32)), pa.array((i % nx).astype(np.int32)), pa.array(v)], names=["z", "y", "x", "value"])

    return spark.range(nz).mapInArrow(run, "z int, y int, x int, value double")


def standardised(voxels: DataFrame) -> DataFrame:
    """Zero mean, unit deviation; zeros if constant."""
    m, s = voxels.agg(F.avg("value"), F.stddev_pop("value")).first()
    v = (F.col("value") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
    return voxels.select("z", "y", "x", v.cast("float").alias("value"))


def grain(voxels: DataFrame, shape: tuple[int, int, int], sigma: float = 1.5) -> DataFrame:
    """voxels smoothed, with zero mean and unit deviation."""
    return standardised(signal.gaussian(voxels, shape, sigma))


def texture(spark: SparkSession, shape: tuple[int, int, int], sigma: float = 1.5, seed: int = 0) -> DataFrame:
    return grain(white_noise(spark, shape, seed), shape, sigma)


def warp(reference: DataFrame, field: Field, shape: tuple[int, int, int], order: int = 3, convention: str = "pull_back") -> DataFrame:
    """deformed(x) = reference(x - u(x)); push_forward flips the sign of u. Edges are mirrored."""
    if convention not in ("pull_back", "push_forward"):
        raise ValueError(f"unknown convention {convention}")
    sign = 1 if convention == "pull_back" else -1
    at = voxel_grid(reference.sparkSession, shape).select(F.struct("z", "y", "x").alias("poi"), *[(F.col(a) - sign * u).alias(f"p{a}") for a, u in zip("zyx", field, strict=True)])
    v = signal.sample(at, signal.spline_table(reference, shape, order), shape, order)
    return v.select("poi.*", F.col("value").cast("float").alias("value"))


def flow_tables(flow: DataFrame, shape: tuple[int, int, int], order: int = 3) -> dict[str, DataFrame]:
    """Spline coefficients of a stored flow (z, y, x, dz, dy, dx), one table for each component: make once, sample often."""
    return {a: signal.spline_table(flow.select("z", "y", "x", F.col(f"d{a}").alias("value")), shape, order) for a in "zyx"}


def sample_flow(points: DataFrame, flow: DataFrame | dict[str, DataFrame], shape: tuple[int, int, int], order: int = 3) -> DataFrame:
    """poi with tz, ty, tx: a stored flow, or its flow_tables(), interpolated at the points."""
    tables = flow if isinstance(flow, dict) else flow_tables(flow, shape, order)
    return signal.sample_all(points, {f"t{a}": tables[a] for a in "zyx"}, shape, order)


def warp_flow(reference: DataFrame, flow: DataFrame, shape: tuple[int, int, int], sign: int = 1, order: int = 3, table: DataFrame | None = None) -> DataFrame:
    """deformed(x) = reference(x - sign u(x)) for a stored flow, fractional too. table: the reference's spline_table()."""
    at = flow.select(F.struct("z", "y", "x").alias("poi"), *[(F.col(a) - sign * F.col(f"d{a}").cast("double")).alias(f"p{a}") for a in "zyx"])
    v = signal.sample(at, signal.spline_table(reference, shape, order) if table is None else table, shape, order)
    return v.select("poi.*", "value")


@dataclass
class Pair:
    reference: DataFrame
    deformed: DataFrame
    truth: DataFrame
    mask: DataFrame | None


def make_pair(spark: SparkSession, shape: tuple[int, int, int], field: Field, sigma: float = 1.5, seed: int = 0, order: int = 3, mask: DataFrame | None = None) -> Pair:
    """A texture, its warped copy, and the field on the voxel grid."""
    ref = texture(spark, shape, sigma, seed)
    return Pair(ref, warp(ref, field, shape, order), with_field(voxel_grid(spark, shape), field), mask)


def on_lattice(spark: SparkSession, lattice: Lattice, field: Field) -> DataFrame:
    """The field at the lattice's centres, as truth columns tz, ty, tx. The field must use coordinates pz, py, px."""
    return with_field(lattice_table(spark, lattice), field, ("tz", "ty", "tx"))


def trabecular(spark: SparkSession, shape: tuple[int, int, int], scale: float, porosity: float, seed: int) -> DataFrame:
    if scale <= 0:
        raise ValueError(f"scale must be positive, got {scale}")
    return phantom.above_quantile(signal.gaussian(white_noise(spark, shape, seed), shape, scale), porosity).select("z", "y", "x", "strut")


def rendered(struts: DataFrame, grains: DataFrame, spec: phantom.Phantom) -> DataFrame:
    """Scaffold over struts (z, y, x, strut) times (1 + strength x grains' value), smoothed."""
    s, t = phantom.scaffold(struts, spec), grains.withColumnRenamed("value", "t")
    v = s.join(t, ["z", "y", "x"]).select("z", "y", "x", (F.col("intensity") * (1 + spec.grain[0] * F.col("t"))).alias("value"))
    v = signal.gaussian(v, spec.shape, spec.blur) if spec.blur > 0 else v
    return v.select("z", "y", "x", F.col("value").cast("float").alias("value"))


def render(spark: SparkSession, spec: phantom.Phantom) -> DataFrame:
    """A phantom with struts and texture of white noise."""
    return rendered(trabecular(spark, spec.shape, *spec.pores, spec.seed + 1), texture(spark, spec.shape, spec.grain[1], spec.seed + 2), spec)


def default_phantom(spark: SparkSession, shape: tuple[int, int, int], seed: int = 0) -> DataFrame:
    return render(spark, phantom.bone(shape, hole=min(shape[1:]) / 12, seed=seed))
