"""The displacement fields of a series of frames, from a table of scan samples.

    python -m jobs.frame_fields --input SAMPLES --output OUT [--config FILE]

Samples are summed into voxels of their frame, frames become rows of blocks, each frame is paired with the one before it
(or with the first), and all pairs are correlated in one plan. OUT/fields holds a row for each lattice point and pair,
OUT/reports one for each pair: points by status and the mean displacement of the valid ones; both are partitioned by
pair. A rerun replaces the partitions of its pairs, so it gives the same tables; pairs of other series stay.

Samples with a null frame, place or value, or outside of the shape, are left out and counted in the log. One frame alone
has no pair and writes nothing.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import default_config, load_config, session
from strainlake.config import CorrelateConfig
from strainlake.functions.shipping import ship
from strainlake.operators import blocks, score
from strainlake.plans.correlate import correlate_pairs
from strainlake.schema import FIELD
from strainlake.streaming import frames

EDGE = 16
REPORT = "n_total long, n_ok long, n_masked long, n_outlier long, n_low_conf long, n_out_of_range long, mean_dz double, mean_dy double, mean_dx double, pair_id string"
_log = logging.getLogger("jobs.frame_fields")


@dataclass(frozen=True)
class Config:
    frame: str
    z: str
    y: str
    x: str
    value: str
    shape: tuple[int, int, int]
    valid_from: float | None = None
    pairing: str = frames.SEQUENTIAL
    window: int | tuple[int, int, int] = 96
    overlap: float = 0.5
    mask_threshold: float = 0.9
    digits: int | None = None

    @property
    def correlation(self) -> CorrelateConfig:
        return CorrelateConfig(self.window, self.overlap, self.mask_threshold)


def voxels(table: DataFrame, config: Config) -> DataFrame:
    """frame, z, y, x, value: samples summed by voxel within each task before they are shuffled."""
    place = {a: F.expr(getattr(config, a)).cast("int") for a in "zyx"}
    t = table.select(F.expr(config.frame).cast("long").alias("frame"), *[c.alias(a) for a, c in place.items()], F.expr(config.value).cast("double").alias("value"))
    inside = [(F.col(a) >= 0) & (F.col(a) < n) for a, n in zip("zyx", config.shape, strict=True)]
    t = t.where(F.col("frame").isNotNull() & F.col("value").isNotNull() & inside[0] & inside[1] & inside[2])
    return t.groupBy("frame", "z", "y", "x").agg(F.sum("value").alias("value"), F.count("*").alias("samples"))


def run(spark: SparkSession, source: str, out: str, config: Config) -> DataFrame:
    """Reads the samples, writes fields and reports, and returns output()."""
    ship(spark)
    table = spark.read.parquet(source)
    v = voxels(table, config)
    name = F.col("frame").cast("string")
    seen = v.groupBy("frame").agg(F.sum("samples").alias("n"))
    pairs = frames.pairs(seen.select(F.lit("s").alias("series"), F.col("frame").alias("t"), name.alias("path")), config.pairing)
    pairs = pairs.select(F.concat_ws("-", "reference", "deformed").alias("pair_id"), "reference", "deformed", F.concat(F.lit("m"), "reference").alias("mask"))
    rows = blocks.of_voxels(v, name, EDGE, config.shape)
    masked = config.valid_from is not None
    if masked:
        valid = v.select("frame", "z", "y", "x", (F.col("value") >= config.valid_from).alias("value"))
        rows = rows.unionByName(blocks.of_voxels(valid, F.concat(F.lit("m"), name), EDGE, config.shape))
    kept, total = seen.agg(F.sum("n"), F.count("*")).first(), table.count()
    _log.info("%d samples read from %s, %d of them in %d frames of %s voxels", total, source, kept[0] or 0, kept[1], config.shape)
    fields = correlate_pairs(rows, pairs, config.shape, (EDGE,) * 3, masked, config.correlation, config.digits)
    replace = lambda t, name: t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pair_id").parquet(f"{out}/{name}")
    replace(fields, "fields")
    written = spark.read.schema(FIELD).parquet(f"{out}/fields").join(pairs.select("pair_id"), "pair_id", "left_semi")
    means = written.where("valid").groupBy("pair_id").agg(*[F.avg(F.col(f"d{a}").cast("double")).alias(f"mean_d{a}") for a in "zyx"])
    replace(score.status_counts(written, ("pair_id",)).join(means, "pair_id", "left").select(*[x.split()[0] for x in REPORT.split(", ")]), "reports")
    done = spark.read.schema(REPORT).parquet(f"{out}/reports").agg(F.count("*"), F.sum("n_total"), F.sum("n_ok")).first()
    _log.info("%s pairs in %s: %s points, %s of them valid", done[0], out, done[1], done[2])
    return output(spark, out)


def output(spark: SparkSession, out: str) -> DataFrame:
    """All fields as written, each point with its pair's valid points and their mean displacement."""
    f = spark.read.schema(FIELD).parquet(f"{out}/fields")
    return f.join(spark.read.schema(REPORT).parquet(f"{out}/reports").select("pair_id", "n_ok", "mean_dz", "mean_dy", "mean_dx"), "pair_id")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Displacement fields of a series of frames")
    for name in ("input", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="YAML; by default jobs/frame_fields.yaml")
    a = p.parse_args(argv)
    spark = session("frame-fields")
    try:
        run(spark, a.input, a.output, load_config(Config, a.config) if a.config else default_config(Config, "frame_fields.yaml"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
