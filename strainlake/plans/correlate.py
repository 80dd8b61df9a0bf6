"""The displacement fields of pairs of volumes: lattice, admission, correlation, gate, outlier test, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from strainlake.config import STATUS, CorrelateConfig, Lattice
from strainlake.functions.shipping import stored
from strainlake.operators import blocks as B, lattice as L, ncc, peaks, robust, taper
from strainlake.plans.budget import tile_points, worker_memory


def pair_voxels(reference: DataFrame, deformed: DataFrame, mask: DataFrame | None = None, deformed_mask: DataFrame | None = None) -> DataFrame:
    """z, y, x, r, d, mr, md: one row per voxel. The deformed mask defaults to the mask, the mask to all true.

    Four narrow inputs are stacked and grouped, so each is shuffled once on the voxel.
    """
    part = lambda t, c, k: t.select("z", "y", "x", *[(F.col("value").cast(k) if o == c else F.lit(None).cast(kind)).alias(o) for o, kind in (("r", "double"), ("d", "double"), ("mr", "boolean"), ("md", "boolean"))])
    rows = part(reference, "r", "double").unionByName(part(deformed, "d", "double"))
    if mask is not None:
        rows = rows.unionByName(part(mask, "mr", "boolean"))
    if deformed_mask is not None:
        rows = rows.unionByName(part(deformed_mask, "md", "boolean"))
    t = rows.groupBy("z", "y", "x").agg(*[F.max(c).alias(c) for c in ("r", "d", "mr", "md")])
    t = t.withColumn("mr", F.coalesce("mr", F.lit(mask is None)))
    return t.withColumn("md", F.col("mr") if deformed_mask is None else F.coalesce("md", F.lit(False))).fillna(0.0, ["r", "d"])


#: Edge of the blocks that voxel rows are put into.
EDGE = 32


def field(points: DataFrame, found: DataFrame, config: CorrelateConfig, pair_id: str | None = "pair") -> DataFrame:
    """The full lattice with status: MASKED before OUT_OF_RANGE before OUTLIER; points that are not OK are zero.

    Without a pair_id, points and found have a column of that name, and each pair is a field of its own. The peaks are
    written to the shared folder first, a row for each point.
    """
    keys = () if pair_id is not None else ("pair_id",)
    # The neighbourhood test reads the field several times: the correlation behind it must run once.
    t = stored(points.join(found, [*keys, "poi"], "left"), "peaks")
    out = F.greatest(*[F.abs(f"d{a}") for a in "zyx"]) > config.radius
    t = t.withColumn("status", F.when(~F.col("admitted") | F.col("dz").isNull(), STATUS["MASKED"]).when(out, STATUS["OUT_OF_RANGE"]).otherwise(STATUS["OK"]))
    t = t.withColumn("valid", F.col("status") == STATUS["OK"])
    t = robust.outliers(t, config.outlier_epsilon, config.noise_floor, config.min_neighbors, keys)
    t = t.withColumn("status", F.when(F.col("outlier"), STATUS["OUTLIER"]).otherwise(F.col("status")).cast("tinyint"))
    t = t.withColumn("valid", F.col("status") == STATUS["OK"])
    zero = lambda c: F.when(F.col("valid"), F.col(c)).otherwise(0.0).cast("float").alias(c)
    return t.select(F.col("pair_id") if keys else F.lit(pair_id).alias("pair_id"), "poi", "iz", "iy", "ix", "pz", "py", "px", zero("dz"), zero("dy"), zero("dx"), "valid", zero("confidence"), "status")


def tile_size(spark: SparkSession, lattice: Lattice, config: CorrelateConfig, tile_memory: int | None = None, pairs: int = 1) -> int:
    return tile_points(tile_memory or worker_memory(spark), lattice, config, spark.sparkContext.defaultParallelism, pairs)


def voxel_peaks(
    reference: DataFrame, deformed: DataFrame, mask: DataFrame | None, deformed_mask: DataFrame | None, admitted: DataFrame, lattice: Lattice, config: CorrelateConfig,
    points: int, digits: int | None = None, batch: int | None = None,
) -> DataFrame:
    """Peaks of the admitted points (poi) of one pair whose volumes are rows of voxels: each volume is shuffled once."""
    spark = reference.sparkSession
    given = {k: t for k, t in (("r", reference), ("d", deformed), ("mr", mask), ("md", deformed_mask)) if t is not None}
    blocks = reduce(DataFrame.unionByName, [B.of_voxels(t, k, EDGE, lattice.shape) for k, t in given.items()])
    uses = spark.createDataFrame([("pair", k, k, EDGE, EDGE, EDGE) for k in given], B.USE)
    wanted = admitted.select(F.lit("pair").alias("pair_id"), "poi")
    return B.peaks(blocks, uses, wanted, lattice, config, points, ("mr" in given, "md" in given), batch, digits).drop("pair_id")


def correlate(
    reference: DataFrame, deformed: DataFrame, shape: tuple[int, int, int], mask: DataFrame | None = None, deformed_mask: DataFrame | None = None,
    config: CorrelateConfig | None = None, pair_id: str = "pair", kernel: str = "fft", digits: int | None = None, tile_memory: int | None = None,
) -> DataFrame:
    """One row per lattice point. kernel "sql" correlates by joins, for small windows and checks; "fft" by tiles,
    each within tile_memory bytes (by default what the session's settings leave a Python worker).

    Tiles without admitted points take no part in the exchange of blocks. A deformed mask alone shapes the windows, not
    admission. Voxels outside of the shape raise in the transform kernel.
    """
    config = config or CorrelateConfig()
    lattice = Lattice(shape, config.window, config.overlap)
    spark = reference.sparkSession
    if kernel == "fft":
        points = L.lattice_table(spark, lattice)
        if mask is None:
            points = points.withColumn("admitted", F.lit(True))
        else:
            support = B.window_support(B.of_voxels(mask, "mr", EDGE, lattice.shape), lattice).drop("frame")
            points = points.join(support, "poi", "left").withColumn("admitted", F.coalesce("fraction", F.lit(0.0)) >= config.mask_threshold)
        n = tile_size(spark, lattice, config, tile_memory)
        found = voxel_peaks(reference, deformed, mask, deformed_mask, points.where("admitted").select("poi"), lattice, config, n, digits)
    else:
        points = L.admit(L.lattice_table(spark, lattice), mask, lattice, config.mask_threshold)
        w = L.covering(pair_voxels(reference, deformed, mask, deformed_mask), lattice).join(points.where("admitted").select("poi"), "poi", "left_semi")
        w = taper.preprocess(taper.preprocess(w, lattice.window, config.alpha, "r", "mr"), lattice.window, config.alpha, "d", "md")
        corr = ncc.correlate(w, lattice.window, config.mode, config.normalization, config.eps)
        if digits is not None:
            corr = corr.withColumn("ncc", F.round("ncc", digits))
        found = peaks.subvoxel(corr, lattice.window)
    return field(points, found.select("poi", "dz", "dy", "dx", "confidence"), config, pair_id)


def correlate_pairs(
    blocks: DataFrame, pairs: DataFrame, shape: tuple[int, int, int], chunks: tuple[int, int, int], mask: bool = False,
    config: CorrelateConfig | None = None, digits: int | None = None, tile_memory: int | None = None,
) -> DataFrame:
    """The fields of many pairs of frames in one plan; a frame is joined once for all pairs that it is part of.

    blocks: operators.blocks.BLOCK rows of all frames, on a grid of `chunks`. pairs: pair_id, reference, deformed and,
    with mask, the frame that is their mask (column mask); points are admitted by that mask's support.
    """
    config = config or CorrelateConfig()
    lattice = Lattice(shape, config.window, config.overlap)
    spark = blocks.sparkSession
    roles = {"r": "reference", "d": "deformed"} | ({"mr": "mask"} if mask else {})
    edges = [F.lit(c).alias(f"c{a}") for a, c in zip("zyx", chunks, strict=True)]
    uses = reduce(DataFrame.unionByName, [pairs.select("pair_id", F.lit(k).alias("role"), F.col(c).alias("frame"), *edges) for k, c in roles.items()])
    points = L.lattice_table(spark, lattice)
    if mask:
        own = B.window_support(blocks.join(pairs.select(F.col("mask").alias("frame")).distinct(), "frame", "left_semi"), lattice)
        points = pairs.select("pair_id", F.col("mask").alias("frame")).crossJoin(points)
        points = points.join(own, ["frame", "poi"], "left").drop("frame").withColumn("admitted", F.coalesce("fraction", F.lit(0.0)) >= config.mask_threshold)
    else:
        points = pairs.select("pair_id").crossJoin(points).withColumn("admitted", F.lit(True))
    n = tile_size(spark, lattice, config, tile_memory)
    found = B.peaks(blocks, uses, points.where("admitted").select("pair_id", "poi"), lattice, config, n, (mask, False), digits=digits)
    return field(points, found.select("pair_id", "poi", "dz", "dy", "dx", "confidence"), config, None)


def stored_points(spark: SparkSession, lattice: Lattice, mask: tuple[str, str] | None, threshold: float) -> DataFrame:
    """The lattice with fraction and admitted, from a stored mask read chunk by chunk."""
    points = L.lattice_table(spark, lattice)
    if mask is None:
        return points.withColumn("fraction", F.lit(1.0)).withColumn("admitted", F.lit(True))
    support = B.window_support(B.of_array(spark, *mask, "mr")[0], lattice).drop("frame")
    return points.join(support, "poi", "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0))).withColumn("admitted", F.col("fraction") >= threshold)


def stored_peaks(spark: SparkSession, given: dict[str, tuple[str, str]], admitted: DataFrame, lattice: Lattice, config: CorrelateConfig, points: int, digits: int | None = None) -> DataFrame:
    """Peaks of the admitted points (poi) of stored volumes (r, d, and masks mr and md): only chunks they need are opened."""
    from strainlake.sources.zarr_source import open_array

    metas = {k: open_array(*a) for k, a in given.items()}
    for k, m in metas.items():
        if tuple(m.shape) != tuple(lattice.shape):
            raise ValueError(f"{given[k][1]} has shape {tuple(m.shape)}, not {tuple(lattice.shape)}")
    uses = spark.createDataFrame([("pair", k, k, *m.chunks) for k, m in metas.items()], B.USE)
    wanted = admitted.select(F.lit("pair").alias("pair_id"), "poi")
    return B.peaks(given, uses, wanted, lattice, config, points, ("mr" in given, "md" in given), digits=digits).drop("pair_id")


def correlate_arrays(spark: SparkSession, reference: tuple[str, str], deformed: tuple[str, str], mask: tuple[str, str] | None = None, deformed_mask: tuple[str, str] | None = None, config: CorrelateConfig | None = None, pair_id: str = "pair", digits: int | None = None, tile_memory: int | None = None) -> DataFrame:
    """The field of two stored volumes (store, array), chunk by chunk: no row for a voxel. Unequal shapes are refused.

    The mask is read once, for admission; of all volumes only the chunks that admitted points need are opened then.
    """
    from strainlake.sources.zarr_source import open_array

    config = config or CorrelateConfig()
    given = {k: a for k, a in (("r", reference), ("d", deformed), ("mr", mask), ("md", deformed_mask)) if a is not None}
    lattice = Lattice(open_array(*reference).shape, config.window, config.overlap)
    points = stored_points(spark, lattice, mask, config.mask_threshold)
    found = stored_peaks(spark, given, points.where("admitted").select("poi"), lattice, config, tile_size(spark, lattice, config, tile_memory), digits)
    return field(points, found.select("poi", "dz", "dy", "dx", "confidence"), config, pair_id)


def correlate_pair(pair, config: CorrelateConfig | None = None) -> DataFrame:
    """The field of a dataset's pair (sources.store.LoadedPair): from its stored chunks, or from voxels where it is cropped."""
    if pair.stored:
        return correlate_arrays(pair.reference.sparkSession, pair.stored["r"], pair.stored["d"], pair.stored.get("mr"), config=config, pair_id=pair.name)
    return correlate(pair.reference, pair.deformed, pair.shape, pair.mask, config=config, pair_id=pair.name)


def run_and_evaluate(pair, config: CorrelateConfig | None = None, correlate_fn=None) -> tuple[DataFrame, DataFrame]:
    """The field of one pair and its error report against the pair's flow; correlate_fn(pair, config) may make the field."""
    from strainlake.functions.synth import sample_flow
    from strainlake.operators import score

    if pair.flow is None:
        raise ValueError(f"{pair.name} has no flow to be held against")
    f = (correlate_fn or correlate_pair)(pair, config)
    f = stored(f, "field")
    return f, score.report(f.join(sample_flow(f.select("poi", "pz", "py", "px"), pair.flow, pair.shape), "poi"))


def at_thresholds(points: DataFrame, found: DataFrame, thresholds: list[float], config: CorrelateConfig) -> DataFrame:
    """Fields for several mask thresholds from one correlation at the loosest: admission and outliers alone differ.

    points need fraction; found holds the peaks of all points admitted at the loosest threshold.
    """
    out = None
    for t in sorted(thresholds):
        own = points.drop("admitted").withColumn("admitted", F.col("fraction") >= t)
        f = field(own, found, config).withColumn("mask_threshold", F.lit(float(t)))
        out = f if out is None else out.unionByName(f)
    return out
