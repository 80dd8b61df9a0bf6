"""The lattice, admission by mask support, and which windows hold a voxel, all as equi-joins or arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strainlake.config import Lattice


def lattice_table(spark: SparkSession, lattice: Lattice) -> DataFrame:
    """One row per point: poi in C order, lattice index, window start and centre."""
    (_, ny, nx), (sz, sy, sx), (wz, wy, wx) = lattice.counts, lattice.stride, lattice.window
    p = F.col("poi")
    t = spark.range(lattice.points).select(F.col("id").alias("poi"))
    t = t.select("poi", F.expr(f"int(poi div {ny * nx})").alias("iz"), F.expr(f"int(poi div {nx} % {ny})").alias("iy"), (p % nx).cast("int").alias("ix"))
    t = t.select("*", (F.col("iz") * sz).alias("z0"), (F.col("iy") * sy).alias("y0"), (F.col("ix") * sx).alias("x0"))
    return t.select("*", *[(F.col(f"{a}0") + (w - 1) / 2).cast("float").alias(f"p{a}") for a, w in zip("zyx", (wz, wy, wx), strict=True)])


def stride(window: Column, overlap: Column) -> Column:
    """max(1, window (1 - overlap)), halves rounded to even."""
    return F.greatest(F.lit(1), F.bround(window * (1 - overlap))).cast("int")


def lattices(volumes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The lattices of many volumes at once: keys, poi, index, window start and centre for each row (nz, ny, nx, window,
    overlap). The windows are cubes; a volume smaller than its window has no points."""
    t = volumes.withColumn("_s", stride(F.col("window"), F.col("overlap")))
    for a in "zyx":
        n = F.col(f"n{a}")
        t = t.withColumn(f"_c{a}", F.when(n >= F.col("window"), F.floor((n - F.col("window")) / F.col("_s")) + 1).otherwise(0).cast("int"))
    for a in "zyx":
        t = t.where(F.col(f"_c{a}") > 0).withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), F.col(f"_c{a}") - 1)))
        t = t.withColumn(f"{a}0", F.col(f"i{a}") * F.col("_s")).withColumn(f"p{a}", (F.col(f"{a}0") + (F.col("window") - 1) / 2).cast("float"))
    poi = (F.col("iz").cast("long") * F.col("_cy") + F.col("iy")) * F.col("_cx") + F.col("ix")
    return t.select(*keys, poi.alias("poi"), "iz", "iy", "ix", "z0", "y0", "x0", "pz", "py", "px", F.col("_cz").alias("count_z"))


def center_crop(voxels: DataFrame, shape: tuple[int, int, int], want: tuple[int, int, int]) -> DataFrame:
    """The centred block of size want, its coordinates from 0: a filter on z, y, x that reaches the scan."""
    if any(w > s for w, s in zip(want, shape, strict=True)):
        raise ValueError(f"crop {want} exceeds {shape}")
    for a, s, w in zip("zyx", shape, want, strict=True):
        lo = (s - w) // 2
        voxels = voxels.where((F.col(a) >= lo) & (F.col(a) < lo + w)).withColumn(a, (F.col(a) - lo).cast("int"))
    return voxels


def integral_image(voxels: DataFrame, value: str = "value") -> DataFrame:
    """Prefix sums over the three axes: sat at (z, y, x) sums all voxels up to and including it."""
    t = voxels.select("z", "y", "x", F.col(value).cast("long").alias("sat"))
    for a, others in (("z", ("y", "x")), ("y", ("z", "x")), ("x", ("z", "y"))):
        t = t.withColumn("sat", F.sum("sat").over(Window.partitionBy(*others).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)))
    return t


def box_sums(points: DataFrame, sat: DataFrame, lattice: Lattice) -> DataFrame:
    """Sum of each window from the eight corners of an integral image: one equi-join on the corner."""
    corners = []
    for i in range(8):
        ends = [(i >> k) & 1 for k in (2, 1, 0)]
        at = [F.col(f"{a}0") - 1 + e * w for a, e, w in zip("zyx", ends, lattice.window, strict=True)]
        corners.append(F.struct(*[c.cast("int").alias(f"c{a}") for a, c in zip("zyx", at, strict=True)], F.lit((-1) ** (3 - sum(ends))).alias("sign")))
    c = points.select("poi", F.explode(F.array(*corners)).alias("c")).select("poi", "c.*")
    s = sat.select(F.col("z").alias("cz"), F.col("y").alias("cy"), F.col("x").alias("cx"), "sat")
    return c.join(s, ["cz", "cy", "cx"], "left").groupBy("poi").agg(F.sum(F.col("sign") * F.coalesce("sat", F.lit(0))).cast("long").alias("total"))


def covering(voxels: DataFrame, lattice: Lattice) -> DataFrame:
    """Voxels with each window that holds them: poi and the place (jz, jy, jx) within it. No join, no range condition."""
    t = voxels
    for a, s, w, n in zip("zyx", lattice.stride, lattice.window, lattice.counts, strict=True):
        first, last = F.greatest(F.lit(0), F.ceil((F.col(a) - (w - 1)) / F.lit(float(s)))).cast("int"), F.least(F.lit(n - 1), F.floor(F.col(a) / F.lit(float(s)))).cast("int")
        t = t.withColumn(f"i{a}", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
        t = t.withColumn(f"j{a}", (F.col(a) - F.col(f"i{a}") * s).cast("int"))
    _, ny, nx = lattice.counts
    return t.withColumn("poi", ((F.col("iz") * ny + F.col("iy")).cast("long") * nx + F.col("ix"))).drop("iz", "iy", "ix")


def support(mask: DataFrame, lattice: Lattice, value: str = "value") -> DataFrame:
    """poi and the share of its window's voxels where the mask is true; only true voxels are dealt out."""
    w = lattice.window
    on = covering(mask.where(F.col(value)).select("z", "y", "x"), lattice)
    return on.groupBy("poi").agg((F.count("*") / F.lit(float(w[0] * w[1] * w[2]))).alias("fraction"))


def admit(points: DataFrame, mask: DataFrame | None, lattice: Lattice, threshold: float) -> DataFrame:
    """points with fraction and admitted; without a mask all are admitted. Rejected points stay, for their status."""
    if mask is None:
        return points.select("*", F.lit(1.0).alias("fraction"), F.lit(True).alias("admitted"))
    t = points.join(support(mask, lattice), "poi", "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))
    return t.withColumn("admitted", F.col("fraction") >= threshold)


def slab_of(iz: Column, count: Column, n: Column) -> Column:
    """The slab of a z index among count: n contiguous slabs, the first ones larger, some empty if n > count."""
    base, extra = F.floor(count / n), count % n
    large = extra * (base + 1)
    return F.when(iz < large, F.floor(iz / (base + 1))).otherwise(extra + F.floor((iz - large) / F.greatest(F.lit(1), base))).cast("int")


def slabs(points: DataFrame, lattice: Lattice, n: int) -> DataFrame:
    """points with the slab of their z index."""
    return points.withColumn("slab", slab_of(F.col("iz"), F.lit(lattice.counts[0]), F.lit(n)))


def within(margin: Column, window: Column) -> Column:
    """Whether a window at z0, y0, x0 stays margin away from the faces of a volume nz, ny, nx."""
    ok = F.lit(True)
    for a in "zyx":
        ok = ok & (F.col(f"{a}0") >= margin) & (F.col(f"{a}0") + window <= F.col(f"n{a}") - margin)
    return ok


def interior(points: DataFrame, lattice: Lattice, margin: float) -> DataFrame:
    """Points whose window stays margin away from the volume's faces."""
    t = points
    for a, s, w in zip("zyx", lattice.shape, lattice.window, strict=True):
        t = t.where((F.col(f"{a}0") >= margin) & (F.col(f"{a}0") + w <= s - margin))
    return t
