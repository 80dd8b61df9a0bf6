"""The normalised median test over the 26 neighbours of each lattice point: two bounded equi-joins on the index."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

OFFSETS = [o for o in product((-1, 0, 1), repeat=3) if any(o)]


def neighbourhood(field: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per point and valid neighbour: (keys, iz, iy, ix) of the point, dz, dy, dx of the neighbour."""
    off = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("zyx", o, strict=True)]) for o in OFFSETS]))
    near = field.where("valid").select(*keys, "iz", "iy", "ix", F.col("dz").alias("nz"), F.col("dy").alias("ny"), F.col("dx").alias("nx"), off.alias("o"))
    near = near.select(*keys, *[(F.col(f"i{a}") + F.col(f"o.{a}")).alias(f"i{a}") for a in "zyx"], "nz", "ny", "nx")
    return field.select(*keys, "iz", "iy", "ix").join(near, [*keys, "iz", "iy", "ix"])


def outliers(field: DataFrame, epsilon: float = 2.0, noise_floor: float = 0.1, min_neighbors: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """field with n_neighbors, residual (largest normalised component, null if too few neighbours) and outlier.

    A point is compared with the median of its valid neighbours, in units of the median distance of those from their
    median plus noise_floor. Points that are not valid are never outliers.
    """
    at = [*keys, "iz", "iy", "ix"]
    near = neighbourhood(field, keys)
    med = near.groupBy(*at).agg(F.count("*").alias("n_neighbors"), *[F.median(f"n{a}").alias(f"m{a}") for a in "zyx"])
    spread = near.join(med, at).groupBy(*at).agg(*[F.median(F.abs(F.col(f"n{a}") - F.col(f"m{a}"))).alias(f"s{a}") for a in "zyx"])
    t = field.join(med, at, "left").join(spread, at, "left").withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)))
    ratio = F.greatest(*[F.abs(F.col(f"d{a}") - F.col(f"m{a}")) / (F.col(f"s{a}") + noise_floor) for a in "zyx"])
    t = t.withColumn("residual", F.when(F.col("valid") & (F.col("n_neighbors") >= min_neighbors), ratio))
    return t.withColumn("outlier", F.coalesce(F.col("residual") > epsilon, F.lit(False))).drop("mz", "my", "mx", "sz", "sy", "sx")
