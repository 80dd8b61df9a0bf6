"""Analytic displacement fields as column expressions over z, y, x, and resampling by whole voxels."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

#: A field: the columns dz, dy, dx at coordinates z, y, x.
Field = tuple[Column, Column, Column]
AXIS = {"z": 0, "y": 1, "x": 2}


def _coords(coords: tuple[str, str, str]) -> list[Column]:
    return [F.col(c).cast("double") for c in coords]


def rigid(shift: tuple[float, float, float]) -> Field:
    return tuple(F.lit(float(s)) for s in shift)


def dilation(strain: float | tuple[float, float, float], center: tuple[float, float, float], coords=("z", "y", "x")) -> Field:
    """strain times the distance from the centre, per axis."""
    s = (strain,) * 3 if isinstance(strain, (int, float)) else strain
    return tuple(float(k) * (c - float(m)) for k, c, m in zip(s, _coords(coords), center, strict=True))


def shear(gamma: float, shear_axis: str, gradient_axis: str, center: float = 0.0, coords=("z", "y", "x")) -> Field:
    """gamma times the gradient coordinate, along the shear axis alone."""
    if shear_axis == gradient_axis:
        raise ValueError("shear and gradient axis must differ")
    along = float(gamma) * (_coords(coords)[AXIS[gradient_axis]] - float(center))
    return tuple(along if i == AXIS[shear_axis] else F.lit(0.0) for i in range(3))


def sinusoid(amplitude: tuple[float, float, float], wavelength: tuple[float, float, float], phase: tuple[float, float, float] = (0, 0, 0), coords=("z", "y", "x")) -> Field:
    """A sin(2 pi c / L + phase) of each axis's own coordinate."""
    if min(wavelength) <= 0:
        raise ValueError(f"wavelength must be positive, got {wavelength}")
    return tuple(float(a) * F.sin(2 * pi * c / float(w) + float(p)) for a, c, w, p in zip(amplitude, _coords(coords), wavelength, phase, strict=True))


def compose(*fields: Field) -> Field:
    """The sum of the fields at each point; not one applied after another."""
    if not fields:
        raise ValueError("compose needs a field")
    out = fields[0]
    for f in fields[1:]:
        out = tuple(a + b for a, b in zip(out, f, strict=True))
    return out


def with_field(points: DataFrame, field: Field, names=("dz", "dy", "dx")) -> DataFrame:
    return points.select("*", *[c.cast("float").alias(n) for c, n in zip(field, names, strict=True)])


def reflect(i: Column, n: int) -> Column:
    """An index beyond the edge mirrored back, the edge sample repeated: d c b a | a b c d | d c b a."""
    j = F.pmod(i, F.lit(2 * n))
    return F.when(j >= n, 2 * n - 1 - j).otherwise(j)


def warp_integer(reference: DataFrame, flow: DataFrame, shape: tuple[int, int, int], sign: int = 1) -> DataFrame:
    """deformed(x) = reference(x - sign u(x)) for a flow of whole voxels: one equi-join."""
    at = flow.select("z", "y", "x", *[reflect(F.col(a) - sign * F.bround(F.col(f"d{a}")).cast("int"), n).alias(f"r{a}") for a, n in zip("zyx", shape, strict=True)])
    ref = reference.select(F.col("z").alias("rz"), F.col("y").alias("ry"), F.col("x").alias("rx"), "value")
    return at.join(ref, ["rz", "ry", "rx"]).select("z", "y", "x", "value")
