"""Displacement fields at rest: Parquet by pair and variant, and .npz files of one field for exchange."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strainlake import schema
from strainlake.config import Lattice


def save(field: DataFrame, path: str, variant_id: str = "base") -> None:
    """Adds one variant of the field's pair; only its partition is replaced."""
    from pyspark.sql import functions as F

    t = field.withColumn("variant_id", F.lit(variant_id))
    t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair_id", "variant_id").parquet(path)


def load(spark: SparkSession, path: str, pair_id: str | None = None, variant_id: str | None = None) -> DataFrame:
    """Fields of a pair or variant: the filters prune partitions."""
    t = spark.read.schema(schema.FIELD + ", variant_id string").parquet(path)
    for c, v in (("pair_id", pair_id), ("variant_id", variant_id)):
        if v is not None:
            t = t.where(t[c] == v)
    return t


def save_npz(field: DataFrame, lattice: Lattice, path: str) -> None:
    """One field as arrays in C order; for lattices that fit into the driver."""
    p = field.orderBy("poi").toPandas()
    if len(p) != lattice.points:
        raise ValueError(f"the field has {len(p)} points, the lattice {lattice.points}")
    np.savez(
        path, positions=p[["pz", "py", "px"]].to_numpy(np.float32), displacements=p[["dz", "dy", "dx"]].to_numpy(np.float32), valid=p["valid"].to_numpy(bool),
        confidence=p["confidence"].to_numpy(np.float32), status=p["status"].to_numpy(np.uint8), grid_shape=np.array(lattice.counts), spacing=np.array(lattice.stride), window=np.array(lattice.window),
    )


def load_npz(spark: SparkSession, path: str, pair_id: str = "pair") -> DataFrame:
    with np.load(path) as z:
        need = ("positions", "displacements", "valid", "confidence", "status", "grid_shape", "spacing", "window")
        missing = [k for k in need if k not in z]
        if missing:
            raise KeyError(f"{path}: {missing} missing")
        d = {k: z[k] for k in need}
    n, (_, ny, nx) = len(d["valid"]), d["grid_shape"]
    i = np.arange(n)
    at = np.stack([i // (ny * nx), i // nx % ny, i % nx], 1)
    rows = zip(i.tolist(), at.tolist(), d["positions"].astype(float).tolist(), d["displacements"].astype(float).tolist(), d["valid"].astype(bool).tolist(), d["confidence"].astype(float).tolist(), d["status"].astype(int).tolist(), strict=True)
    return spark.createDataFrame([(pair_id, k, *a, *p, *u, v, c, s) for k, a, p, u, v, c, s in rows], schema.FIELD)
