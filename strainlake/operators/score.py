"""Scores of displacement fields against the truth. Input: field columns and the truth as tz, ty, tx; keys name a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strainlake.config import STATUS

DISTANCE_BINS = (0.0, 5.0, 10.0, 20.0, 50.0)


def errors(field: DataFrame) -> DataFrame:
    """field with ez, ey, ex (estimate less truth) and norm."""
    t = field
    for a in "zyx":
        t = t.withColumn(f"e{a}", F.col(f"d{a}").cast("double") - F.col(f"t{a}").cast("double"))
    return t.withColumn("norm", F.sqrt(sum((F.col(f"e{a}") * F.col(f"e{a}") for a in "zyx"), F.lit(0.0))))


def report(field: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n_total, n_valid, mae and rmse over components, p95 over norms, mae per axis; null metrics without valid points."""
    e = errors(field)
    on = lambda c: F.when(F.col("valid"), c)
    mean = lambda f: sum((F.avg(on(f(F.col(f"e{a}")))) for a in "zyx"), F.lit(0.0)) / 3
    aggs = [
        F.count("*").alias("n_total"),
        F.count_if("valid").alias("n_valid"),
        mean(F.abs).alias("mae"),
        F.sqrt(mean(lambda c: c * c)).alias("rmse"),
        F.percentile(on(F.col("norm")), F.lit(0.95)).alias("p95"),
        *[F.avg(on(F.abs(f"e{a}"))).alias(f"mae_{a}") for a in "zyx"],
    ]
    return e.groupBy(*keys).agg(*aggs) if keys else e.agg(*aggs)


#: Ranges of values that ranks without keys are counted in, each by a task of its own.
RANK_RANGES = 256


def average_rank(t: DataFrame, column: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1; ties share the mean of their ranks, nulls come first.

    Without keys no task sees all rows: distinct values are counted, dealt to ranges between quantiles, and ranked
    within their range on top of what lies in lower ranges, one sum for each range.
    """
    if keys:
        same = Window.partitionBy(*keys, column)
        return t.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (F.count("*").over(same) - 1) / 2)
    counts = t.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    bounds = counts.agg(F.percentile_approx(F.col("_v").cast("double"), [i / RANK_RANGES for i in range(1, RANK_RANGES)], 100 * RANK_RANGES)).first()[0]
    array = F.array(*[F.lit(float(x)) for x in sorted(set(bounds or [0.0]))])
    # NaN lies above all bounds, null below them.
    at = F.size(F.filter(array, lambda x: F.coalesce(x < F.col("_v").cast("double"), F.lit(False))))
    dealt = counts.withColumn("_range", at)
    below = dealt.groupBy("_range").agg(F.sum("_c").alias("_n"))
    up_to = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("_range", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_below"))  # RANK_RANGES rows
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = dealt.withColumn("_before", before).join(F.broadcast(below), "_range")
    ranks = ranks.select("_v", (F.col("_below") + F.col("_before") + 1 + (F.col("_c") - 1) / 2).alias(out))
    return t.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(t: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation of two columns; null for fewer than two rows or a constant column."""
    r = average_rank(average_rank(t, a, "_ra", keys), b, "_rb", keys)
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    c = F.when((F.count("*") > 1) & (spread > 0), F.covar_pop("_ra", "_rb") / F.when(spread > 0, spread))
    return r.groupBy(*keys).agg(c.alias("rho")) if keys else r.agg(c.alias("rho"))


def bucket(distance: Column, edges: tuple[float, ...]) -> Column:
    """Index of the distance bin: closed on the right, the last open; the first holds its edge only if that is 0."""
    out = F.when((distance >= edges[0]) if edges[0] == 0 else (distance > edges[0]), 0)
    # The second edge closes the first bin and opens the second, and so on; the last edge opens the terminal bin.
    for i, e in enumerate(edges[1:], 1):
        out = F.when(distance > e, i).otherwise(out)
    return out


def strata(field: DataFrame, edges: tuple[float, ...] = DISTANCE_BINS, distance: str = "distance", keys: tuple[str, ...] = ()) -> DataFrame:
    """bin, edge, n, mae and rmse by distance bin over valid points; bins without points stay, with null metrics.

    keys name a field; all of a field's bins stay, as long as it has points.
    """
    e = errors(field.where("valid")).withColumn("bin", bucket(F.col(distance), edges))
    third = lambda f: F.avg(sum((f(F.col(f"e{a}")) for a in "zyx"), F.lit(0.0)) / 3)
    got = e.groupBy(*keys, "bin").agg(F.count("*").alias("n"), third(F.abs).alias("mae"), F.sqrt(third(lambda c: c * c)).alias("rmse"))
    bins = field.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(edges)], "bin int, edge double")
    if keys:
        bins = field.select(*keys).distinct().crossJoin(F.broadcast(bins))
    return bins.join(got, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def centre_voxel(points: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """points with the voxel (cz, cy, cx) at their centre, halves rounded to even, within the volume."""
    for a, s in zip("zyx", shape, strict=True):
        points = points.withColumn(f"c{a}", F.greatest(F.lit(0), F.least(F.lit(s - 1), F.bround(F.col(f"p{a}").cast("double")))).cast("int"))
    return points


def distance_to(points: DataFrame, mask: DataFrame, shape: tuple[int, int, int], to: bool = True, distances: DataFrame | None = None) -> DataFrame:
    """points with the exact distance from their centre voxel to the nearest mask voxel whose value is `to`.

    By the distance transform of the whole volume, three passes over lines whatever the distances; null without such a
    voxel. distances: that transform, if it was made before.
    """
    from strainlake.functions.signal import distance_volume

    d = distance_volume(mask, shape, to) if distances is None else distances
    d = d.select(*[F.col(a).alias(f"c{a}") for a in "zyx"], F.col("value").alias("distance"))
    return centre_voxel(points, shape).join(d, ["cz", "cy", "cx"], "left")


def status_counts(field: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points of each status, also of those that do not occur."""
    aggs = [F.count("*").alias("n_total"), *[F.count_if(F.col("status") == v).alias(f"n_{k.lower()}") for k, v in STATUS.items()]]
    return field.groupBy(*keys).agg(*aggs) if keys else field.agg(*aggs)


def magnitudes(field: DataFrame) -> DataFrame:
    """Percentiles of the magnitude and confidence of valid points."""
    on = field.where("valid").withColumn("u", F.sqrt(sum((F.col(f"d{a}").cast("double") * F.col(f"d{a}").cast("double") for a in "zyx"), F.lit(0.0))))
    at = lambda c, q: F.percentile(c, F.lit(q))
    return on.agg(*[at("u", q).alias(f"u_p{int(100 * q)}") for q in (0.5, 0.9, 0.99)], F.max("u").alias("u_max"), *[at(F.col("confidence").cast("double"), q).alias(f"conf_p{int(100 * q)}") for q in (0.5, 0.1)], F.min(F.col("confidence").cast("double")).alias("conf_min"))


def sweep_reports(fields: DataFrame, entry: str = "entry") -> DataFrame:
    """One report per entry, in one aggregation."""
    return report(fields, (entry,))


def best_variants(spark: SparkSession, reports: DataFrame, n: int = 1, metric: str = "mae", keys: tuple[str, ...] = ("deformation",)) -> DataFrame:
    """The n best variants of each deformation by a metric; variants without the metric are left out."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric), "variant_id")
    return reports.where(F.col(metric).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
