"""Voxel spacings and their units, and the tables that viewers take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Metres in each physical unit.
METRES = {"nm": 1e-9, "um": 1e-6, "mm": 1e-3}


@dataclass(frozen=True)
class VoxelSpacing:
    z: float
    y: float
    x: float
    unit: str = "voxel"

    def __post_init__(self):
        if min(self.z, self.y, self.x) <= 0:
            raise ValueError("spacing must be positive")
        if self.unit != "voxel" and self.unit not in METRES:
            raise ValueError(f"unknown unit {self.unit}")

    def to(self, unit: str) -> VoxelSpacing:
        if unit == self.unit:
            return self
        if "voxel" in (unit, self.unit):
            raise ValueError("voxels and physical units cannot be converted into each other")
        f = METRES[self.unit] / METRES[unit]
        return VoxelSpacing(self.z * f, self.y * f, self.x * f, unit)


def unify(spacings: list[VoxelSpacing], rtol: float = 1e-6) -> VoxelSpacing:
    """One spacing in the first one's unit; mixed kinds or spacings that differ are errors."""
    first = spacings[0]
    for s in spacings[1:]:
        o = s.to(first.unit)
        if any(abs(a - b) > rtol * abs(b) for a, b in ((o.z, first.z), (o.y, first.y), (o.x, first.x))):
            raise ValueError(f"spacings differ: {s} and {first}")
    return first


def factor(unit: Column, to: str) -> Column:
    """What a length in a column of units is multiplied by to be in `to`; null where no conversion exists."""
    pairs = [x for u, m in METRES.items() for x in (F.lit(u), F.lit(m / METRES[to]))] if to in METRES else []
    known = F.try_element_at(F.create_map(*pairs), unit) if pairs else F.lit(None).cast("double")
    return F.when(unit == to, 1.0).otherwise(known)


def points_table(field: DataFrame, spacing: VoxelSpacing, only_valid: bool = True) -> DataFrame:
    """Points for viewers: x, y, z order, scaled by the spacing, with magnitude; only valid points if asked."""
    t = field.where("valid") if only_valid else field
    s = {"z": spacing.z, "y": spacing.y, "x": spacing.x}
    cols = [(F.col(f"p{a}").cast("double") * s[a]).alias(a) for a in "xyz"] + [(F.col(f"d{a}").cast("double") * s[a]).alias(f"u{a}") for a in "xyz"]
    t = t.select("poi", *cols, "confidence", "status")
    return t.withColumn("magnitude", F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")))


def structured_grid(points: DataFrame, spacing: VoxelSpacing, scalars: tuple[str, ...] = ()) -> DataFrame:
    """The whole lattice for viewers: its index i, j, k along x, y, z, its places x, y, z scaled by the spacing, and columns
    of points as floats under their names. Ordered by poi it is a structured grid, x running fastest."""
    s = {"z": spacing.z, "y": spacing.y, "x": spacing.x}
    index = [F.col(f"i{a}").cast("int").alias(n) for a, n in zip("xyz", "ijk", strict=True)]
    places = [(F.col(f"p{a}").cast("double") * s[a]).cast("float").alias(a) for a in "xyz"]
    return points.select("poi", *index, *places, *[F.col(c).cast("float").alias(c) for c in scalars])


def masked_volume(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels for renderers: zero where the mask is not true."""
    m = mask.select("z", "y", "x", F.col("value").alias("m"))
    return voxels.join(m, ["z", "y", "x"], "left").withColumn("value", F.when(F.col("m"), F.col("value")).otherwise(F.lit(0).cast("float"))).drop("m")


def iso_cells(voxels: DataFrame, level: float) -> DataFrame:
    """Cells whose corners lie on both sides of level: what an isosurface passes through. One aggregate per cell."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(-((i >> k) & 1)).alias(a) for k, a in enumerate("xyz")]) for i in range(8)]))
    c = voxels.select("z", "y", "x", F.col("value").alias("v"), corner.alias("o")).select(*[(F.col(a) + F.col(f"o.{a}")).alias(a) for a in "zyx"], "v")
    g = c.groupBy("z", "y", "x").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return g.where((F.col("n") == 8) & (F.col("lo") <= level) & (F.col("hi") >= level)).select("z", "y", "x", "lo", "hi")
