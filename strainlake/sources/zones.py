"""A zone map of stored arrays: count, extremes and sums of every chunk, from one pass of the readers.

The map is a table of one short row a chunk, to be kept beside the store. Profiles are sums over it; a histogram counts
a chunk whose values all fall into one bin from its row, and opens the others alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strainlake.sources import zarr_source

ZONE = (
    "name string, z0 int, y0 int, x0 int, n long, n_true long, least double, greatest double, total double, "
    "total_z double, total_y double, total_x double, most_z double, most_y double, most_x double"
)
_NAMES = [x.split()[0] for x in ZONE.split(", ")]


@dataclass(frozen=True)
class Array:
    """A volume, mask or flow of a store, and the name of its rows. A flow's values are its magnitudes."""

    name: str
    path: str
    axis_order: str = "3_zyx"
    convention: str = "pull_back"


def _readers(store: str, arrays: list[Array]) -> dict[str, zarr_source._Reader]:
    return {a.name: zarr_source._Reader({"path": store, "array": a.path, "axis_order": a.axis_order, "convention": a.convention}) for a in arrays}


def _values(parts: list[np.ndarray]) -> np.ndarray:
    a = [p.astype(np.float32).astype(float) if p.dtype.kind == "f" else p.astype(float) for p in parts]
    return a[0] if len(a) == 1 else np.sqrt(sum(p * p for p in a))


def zones(spark: SparkSession, store: str, arrays: list[Array]) -> DataFrame:
    """One row for each chunk of all arrays, in one job; n_true counts values that are not zero."""
    readers = _readers(store, arrays)
    tasks = [len(r.partitions()) for r in readers.values()]
    first = np.cumsum([0, *tasks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, list] = {}
        for batch in batches:
            for i in batch.column(0).to_pylist():
                k = int(np.searchsorted(first, i, side="right")) - 1
                name = arrays[k].name
                reader = readers[name]
                rows = []
                for at in places.setdefault(name, reader.partitions())[i - first[k]].ats:
                    start, parts = reader.values(at)
                    v = _values(parts)
                    if not v.size:
                        continue
                    flow = [p.astype(np.float32).astype(float) for p in parts] if len(parts) == 3 else None
                    axes = [float(p.sum()) for p in flow] + [float(np.abs(p).max()) for p in flow] if flow else [None] * 6
                    rows.append((name, *start, v.size, int((v != 0).sum()), float(v.min()), float(v.max()), float(v.sum()), *axes))
                if rows:
                    kinds = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.float64()] * 9]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)

    total = int(first[-1])
    cores = spark.sparkContext.defaultParallelism
    return spark.range(0, total, 1, max(1, min(total, max(4 * cores, total // 64)))).mapInArrow(run, ZONE)


def build(spark: SparkSession, store: str, arrays: list[Array], path: str) -> DataFrame:
    """The zones of these arrays written to path, in place of what it held of them, and all that it holds read back."""
    t = zones(spark, store, arrays)
    t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(path)
    return spark.read.schema(ZONE).parquet(path)


def summary(of: DataFrame) -> DataFrame:
    """name, n, n_true, mean, min, max and, for flows, mean and largest absolute value per axis: no voxel is read."""
    n = F.sum("n")
    per_axis = [f(a) for a in "zyx" for f in (lambda a: (F.sum(f"total_{a}") / n).alias(f"mean_{a}"), lambda a: F.max(f"most_{a}").alias(f"max_{a}"))]
    return of.groupBy("name").agg(n.alias("n"), F.sum("n_true").alias("n_true"), (F.sum("total") / n).alias("mean"), F.min("least").alias("min"), F.max("greatest").alias("max"), *per_axis)


def histogram(spark: SparkSession, store: str, arrays: list[Array], of: DataFrame, bins: int) -> DataFrame:
    """name, lo, hi, total, b and c: values of each array by equally wide bins between its extremes.

    Chunks within one bin are counted from their zone; the rest is opened, each by the task that its row is dealt to.
    """
    readers = _readers(store, arrays)
    place = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    ends = of.groupBy("name").agg(F.min("least").alias("lo"), F.max("greatest").alias("hi"), F.sum("n").alias("total"))
    t = of.where(F.col("name").isin([a.name for a in arrays])).select("name", "z0", "y0", "x0", "n", "least", "greatest").join(ends.where("hi > lo"), "name").withColumn("b", place("least")).withColumn("b2", place("greatest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader = readers[r["name"]]
                at = [0] * len(reader.meta.shape)
                for a, k in zip(reader.spatial, ("z0", "y0", "x0"), strict=True):
                    at[a] = r[k] // reader.meta.chunks[a]
                v = _values(reader.values(tuple(at))[1]).ravel()
                b, c = np.unique(np.minimum(np.floor((v - r["lo"]) / (r["hi"] - r["lo"]) * bins), bins - 1).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]] * len(b), pa.string()), *[pa.array([r[k]] * len(b)) for k in ("lo", "hi", "total")], pa.array(b), pa.array(c)], names=["name", "lo", "hi", "total", "b", "c"])

    schema = "name string, lo double, hi double, total long, b long, c long"
    cores = spark.sparkContext.defaultParallelism
    opened = t.where("b <> b2").select("name", "z0", "y0", "x0", "lo", "hi", "total").repartition(4 * cores).mapInArrow(run, schema)
    whole = t.where("b = b2").select("name", "lo", "hi", "total", "b", F.col("n").alias("c"))
    return whole.unionByName(opened).groupBy("name", "lo", "hi", "total", "b").agg(F.sum("c").alias("c"))


def median(spark: SparkSession, store: str, arrays: list[Array], of: DataFrame, bins: int) -> DataFrame:
    """name and median, interpolated in the first bin at which the cumulative count reaches half; see histogram()."""
    if bins < 2:
        raise ValueError(f"bins must be at least 2, got {bins}")
    counts = histogram(spark, store, arrays, of, bins)
    w = Window.partitionBy("name").orderBy("b")
    run = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") >= F.col("total") / 2)
    first = run.withColumn("k", F.row_number().over(w)).where("k = 1")
    inside = first.select("name", (F.col("lo") + (F.col("b") + (F.col("total") / 2 - (F.col("upto") - F.col("c"))) / F.col("c")) * ((F.col("hi") - F.col("lo")) / bins)).alias("median"))
    same = of.where(F.col("name").isin([a.name for a in arrays])).groupBy("name").agg(F.min("least").alias("median"), F.max("greatest").alias("hi")).where("median = hi").drop("hi")
    return inside.unionByName(same)
