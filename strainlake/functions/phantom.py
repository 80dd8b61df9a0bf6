"""Phantoms: an ordered list of regions over a background, each a shape with one intensity; later ones over earlier."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

Point = tuple[float, float, float]


def distance2(center: Point, along: str | None = None) -> Column:
    """Squared distance of a voxel from a point, or from a line along an axis."""
    return sum((F.pow(F.col(a).cast("double") - float(c), F.lit(2.0)) for a, c in zip("zyx", center, strict=True) if a != along), F.lit(0.0))


@dataclass(frozen=True)
class Region:
    """inner..outer around a point (axis None: a ball or shell) or a line along an axis (a rod or tube).

    Of a porous region only strut voxels count; a region leaves those it spares as they are.
    """

    name: str
    intensity: float
    center: Point
    outer: float
    inner: float = 0.0
    axis: str | None = None
    porous: bool = False
    spares: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 <= self.inner < self.outer:
            raise ValueError(f"{self.name}: 0 <= inner < outer does not hold for {self.inner}, {self.outer}")

    def holds(self) -> Column:
        r2 = distance2(self.center, self.axis)
        on = (r2 >= self.inner**2) & (r2 <= self.outer**2)
        return on & F.col("strut") if self.porous else on


@dataclass(frozen=True)
class Phantom:
    """grain: strength and smoothing of the texture; pores: smoothing of the struts' noise and share that is empty."""

    shape: tuple[int, int, int]
    regions: tuple[Region, ...]
    background: float = 0.05
    grain: tuple[float, float] = (0.2, 1.5)
    pores: tuple[float, float] = (3.0, 0.5)
    blur: float = 0.5
    seed: int = 0


def bone(shape: tuple[int, int, int], radius: float | None = None, wall: float | None = None, rod: float = 3.0, hole: float = 0.0, hole_at: Point | None = None, seed: int = 0) -> Phantom:
    """A tube of dense bone around porous bone along z, with a hole in both and a rod along x that the hole spares."""
    middle = tuple(n / 2 for n in shape)
    radius = 0.4 * min(shape[1:]) if radius is None else radius
    wall = radius / 4 if wall is None else wall
    if wall >= radius:
        raise ValueError(f"a wall of {wall} leaves nothing within {radius}")
    own = [Region("trabecular", 0.55, middle, radius - wall, axis="z", porous=True), Region("cortical", 0.9, middle, radius, radius - wall, "z")]
    if hole:
        own.append(Region("background", 0.05, hole_at or tuple(0.625 * n if i != 1 else 0.375 * n for i, n in enumerate(shape)), hole))
    own.append(Region("implant", 1.2, middle, rod, axis="x"))
    return Phantom(shape, tuple(own), seed=seed)


def above_quantile(noise: DataFrame, porosity: float) -> DataFrame:
    """noise (z, y, x, value) with strut: above its porosity quantile."""
    from strainlake.operators.profile import exact_quantile

    if not 0 < porosity < 1:
        raise ValueError(f"porosity must lie in (0, 1), got {porosity}")
    least = exact_quantile(noise.select(F.lit("noise").alias("volume_id"), "value"), porosity).get("noise")
    return noise.withColumn("strut", F.col("value") > F.lit(least))


def scaffold(voxels: DataFrame, spec: Phantom) -> DataFrame:
    """voxels (z, y, x, strut) with region and intensity."""
    pick: Callable[[Column, Column, Column], Column] = lambda on, new, old: F.when(on, new).otherwise(old)
    t = voxels.withColumns({"region": F.lit("background"), "intensity": F.lit(float(spec.background))})
    for r in spec.regions:
        on = r.holds() & ~F.col("region").isin(*r.spares) if r.spares else r.holds()
        t = t.withColumns({"region": pick(on, F.lit(r.name), F.col("region")), "intensity": pick(on, F.lit(float(r.intensity)), F.col("intensity"))})
    return t
