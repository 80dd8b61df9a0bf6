"""How the driver's relational tables stand for volumes, masks, lattices and catalogs in the engine's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strainlake.config import Lattice

SHAPE = (16, 32, 32)
SHIFT = (1, -2, 1)
LATTICE = Lattice(SHAPE, 8, 0.5)
#: Day, hour and user bucket of events.
EVENTS_SHAPE = (30, 24, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, value (summed quantity) and m (a returned row exists); cells without rows are 0 and false."""
    li = table(spark, sf_dir, "lineitem")
    z = F.pmod(12 * F.year("l_shipdate") + F.month("l_shipdate"), F.lit(16)).cast("int")
    y, x = F.pmod("l_suppkey", F.lit(32)).cast("int"), F.pmod("l_partkey", F.lit(32)).cast("int")
    sums = li.groupBy(z.alias("z"), y.alias("y"), x.alias("x")).agg(F.sum("l_quantity").alias("value"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    cells = spark.range(SHAPE[0] * SHAPE[1] * SHAPE[2]).select(F.expr("int(id div 1024)").alias("z"), F.expr("int(id div 32 % 32)").alias("y"), F.expr("int(id % 32)").alias("x"))
    t = cells.join(sums, ["z", "y", "x"], "left")
    return t.select("z", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value"), (F.coalesce("c", F.lit(0)) > 0).alias("m"))


def volume(t: DataFrame) -> DataFrame:
    return t.select("z", "y", "x", "value")


def mask(t: DataFrame) -> DataFrame:
    return t.select("z", "y", "x", F.col("m").alias("value"))


def rolled(t: DataFrame, shift: tuple[int, int, int] = SHIFT, shape: tuple[int, int, int] = SHAPE) -> DataFrame:
    return t.select(*[F.pmod(F.col(a) + s, F.lit(n)).alias(a) for a, s, n in zip("zyx", shift, shape, strict=True)], "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4 x 4 x 4: each embedding as reference, the next as deformed."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    at = [F.expr("int(i div 16)").alias("jz"), F.expr("int(i div 4 % 4)").alias("jy"), F.expr("int(i % 4)").alias("jx")]
    r = e.select(F.col("vec_id").alias("poi"), "i", F.col("v").cast("double").alias("r"))
    d = e.select((F.col("vec_id") - 1).alias("poi"), "i", F.col("v").cast("double").alias("d"))
    return r.join(d, ["poi", "i"]).select("poi", *at, "r", "d")


def event_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice of estimates: mean, largest and smallest value of a day, hour and user bucket; valid from two events.

    Truth: the means over all days of the same hour and bucket. Confidence: events of the point.
    """
    e = table(spark, sf_dir, "events")
    at = [(F.dayofmonth("ts") - 1).alias("iz"), F.hour("ts").alias("iy"), F.pmod("user_id", F.lit(5)).cast("int").alias("ix")]
    f = e.select(*at, "value").groupBy("iz", "iy", "ix").agg(F.avg("value").alias("dz"), F.max("value").alias("dy"), F.min("value").alias("dx"), F.count("*").alias("n"))
    truth = f.groupBy("iy", "ix").agg(F.avg("dz").alias("tz"), F.avg("dy").alias("ty"), F.avg("dx").alias("tx"))
    f = f.join(truth, ["iy", "ix"])
    return f.select(((F.col("iz") * 24 + F.col("iy")) * 5 + F.col("ix")).cast("long").alias("poi"), "iz", "iy", "ix", "dz", "dy", "dx", "tz", "ty", "tx", (F.col("n") >= 2).alias("valid"), F.col("n").cast("double").alias("confidence"))
