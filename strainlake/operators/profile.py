"""Profiles of volumes, masks and flows: one aggregation over all arrays, and medians from histograms."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window, functions as F

if TYPE_CHECKING:
    from strainlake.sources.zones import Array

BINS = 16_384


def intensity(voxels: DataFrame, key: str = "volume_id") -> DataFrame:
    v = F.col("value").cast("double")
    return voxels.groupBy(key).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def mask(voxels: DataFrame, key: str = "mask_id") -> DataFrame:
    on = F.count_if(F.col("value"))
    return voxels.groupBy(key).agg(on.alias("foreground"), (F.count("*") - on).alias("background"), (on / F.count("*")).alias("fraction"))


def displacement(flow: DataFrame, key: str = "entry") -> DataFrame:
    """Mean and largest magnitude, mean and largest absolute value per axis, with the sign as stored."""
    d = {a: F.col(f"d{a}").cast("double") for a in "zyx"}
    u = F.sqrt(d["z"] * d["z"] + d["y"] * d["y"] + d["x"] * d["x"])
    return flow.groupBy(key).agg(F.count("*").alias("n"), F.avg(u).alias("mean_u"), F.max(u).alias("max_u"), *[F.avg(c).alias(f"mean_{a}") for a, c in d.items()], *[F.max(F.abs(c)).alias(f"max_{a}") for a, c in d.items()])


def exact_quantile(voxels: DataFrame, q: float = 0.5, key: str = "volume_id", value: str = "value", bins: int = 4096) -> dict:
    """key -> the exact q-quantile of its values, interpolated between its two order statistics, among finite values.

    Histograms are refined: each pass counts equally wide bins between the least and the largest value of the bin that
    holds the wanted place, until that bin holds one distinct value. State is bounded by bins for each array.
    """
    t = voxels.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    ends = {r["k"]: r for r in t.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}
    # Each wanted place: the values still in question lie in [lo, hi], and so many lie below.
    wanted, found = {}, {}
    for k, r in ends.items():
        at = q * (r["n"] - 1)
        for place in {int(at), min(int(at) + 1, r["n"] - 1)}:
            wanted[k, place] = (r["lo"], r["hi"], 0)
    while wanted:
        for (k, place), (lo, hi, _) in list(wanted.items()):
            if lo == hi:
                found[k, place] = lo
                del wanted[k, place]
        if not wanted:
            break
        spans = sorted({(k, lo, hi) for (k, _), (lo, hi, _) in wanted.items()}, key=str)
        asked = F.broadcast(t.sparkSession.createDataFrame(spans, f"k {dict(t.dtypes)['k']}, lo double, hi double"))
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") / F.lit(2.0) - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
        seen = t.join(asked, "k").where("v >= lo and v <= hi").groupBy("k", "lo", "hi", bin_.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts: dict = {}
        for r in seen.collect():
            counts.setdefault((r["k"], r["lo"], r["hi"]), []).append((r["b"], r["c"], r["least"], r["most"]))
        for (k, place), (lo, hi, below) in list(wanted.items()):
            for _, c, least, most in sorted(counts[k, lo, hi]):
                if place < below + c:
                    wanted[k, place] = (least, most, below)
                    break
                below += c
    out = {}
    for k, r in ends.items():
        at = q * (r["n"] - 1)
        a, b = found[k, int(at)], found[k, min(int(at) + 1, r["n"] - 1)]
        out[k] = a + (b - a) * (at - int(at))
    return out


def exact_median(voxels: DataFrame, key: str = "volume_id", value: str = "value") -> DataFrame:
    """key and median, one row for each array: exact, in passes with bounded state."""
    kind = dict(voxels.dtypes)[key]
    return voxels.sparkSession.createDataFrame(sorted(exact_quantile(voxels, 0.5, key, value).items(), key=str), f"{key} {kind}, median double")


def histogram_median(voxels: DataFrame, bins: int = BINS, key: str = "volume_id", value: str = "value") -> DataFrame:
    """The median interpolated in the first of equally wide bins at which the cumulative count reaches half.

    Two passes with bounded state: extremes per array, then counts per bin. The largest value falls in the last bin;
    a constant array has that value.
    """
    if bins < 2:
        raise ValueError(f"bins must be at least 2, got {bins}")
    v = F.col(value).cast("double")
    ends = voxels.groupBy(key).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("total"))
    place = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = voxels.join(ends.where("hi > lo"), key).groupBy(key, "lo", "hi", "total", place.alias("b")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("b")
    run = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") >= F.col("total") / 2)
    first = run.withColumn("k", F.row_number().over(w)).where("k = 1")
    width = (F.col("hi") - F.col("lo")) / bins
    inside = first.select(key, (F.col("lo") + (F.col("b") + (F.col("total") / 2 - (F.col("upto") - F.col("c"))) / F.col("c")) * width).alias("median"))
    return inside.unionByName(ends.where("hi = lo").select(key, F.col("lo").alias("median")))


def convention(reference: DataFrame, deformed: DataFrame, flow: DataFrame, shape: tuple[int, int, int], order: int = 3) -> DataFrame:
    """Which sign of a flow explains the deformed volume: mse of each, ratio, and the name; ties: pull_back.

    Flows of whole voxels are moved voxel by voxel; others are sampled from the spline of that order, as a warp does.
    """
    from strainlake.functions.fields import warp_integer
    from strainlake.functions.signal import spline_table
    from strainlake.functions.synth import warp_flow

    whole = flow.select(F.max(F.greatest(*[F.abs(F.col(f"d{a}") - F.bround(F.col(f"d{a}").cast("double"))) for a in "zyx"]))).first()[0]
    table = None if not whole else spline_table(reference, shape, order).persist()
    moved = (lambda sign: warp_flow(reference, flow, shape, sign, order, table)) if whole else (lambda sign: warp_integer(reference, flow, shape, sign))
    one = lambda sign, name: moved(sign).withColumnRenamed("value", name)
    t = deformed.select("z", "y", "x", F.col("value").cast("double").alias("v")).join(one(1, "a"), ["z", "y", "x"]).join(one(-1, "b"), ["z", "y", "x"])
    sq = lambda c: F.avg(F.pow(F.col(c).cast("double") - F.col("v"), F.lit(2.0)))
    m = t.agg(sq("a").alias("mse_pull_back"), sq("b").alias("mse_push_forward"))
    low, high = F.least("mse_pull_back", "mse_push_forward"), F.greatest("mse_pull_back", "mse_push_forward")
    ratio = F.when(high == 0, 1.0).when(low == 0, F.lit(float("inf"))).otherwise(high / F.when(low == 0, 1.0).otherwise(low))
    return m.select("*", ratio.alias("ratio"), F.when(F.col("mse_pull_back") <= F.col("mse_push_forward"), "pull_back").otherwise("push_forward").alias("convention"))


@dataclass(frozen=True)
class Step:
    """One array of a dataset is done: its role ("done" at the end), name, place, how many there are, seconds so far."""

    stage: str
    name: str
    index: int
    total: int
    seconds: float


@dataclass(frozen=True)
class DatasetProfile:
    """volumes (role, name, n, mean, min, max, median), masks (name, foreground, background, fraction), flows (name, n,
    mean_u, max_u, mean and max per axis, median_u): one row per array."""

    volumes: DataFrame
    masks: DataFrame
    flows: DataFrame


def arrays_of(ds, entries: list[str], masks: list[str]) -> list[tuple[str, str, Array]]:
    """(role, name, array) of what a profile covers: the reference, masks, then each deformation's image and flow."""
    from strainlake.sources.zones import Array

    m, p = ds.manifest, ds.profile
    out = [("reference", "reference", Array("reference/reference", f"{p.base}/{p.reference}")), *[("mask", x, Array(f"mask/{x}", f"{p.base}/{x}")) for x in masks]]
    for e in entries:
        out.append(("deformed", e, Array(f"deformed/{e}", ds._path(e, p.deformed))))
        if ds.entries[e] == "synthetic":
            out.append(("flow", e, Array(f"flow/{e}", ds._path(e, p.flow), m.axis_order or p.axis_order, m.convention or p.convention)))
    return out


def dataset(ds, include: list[str] | None = None, masks: list[str] | None = None, median: str = "histogram", bins: int = BINS, progress: Callable[[Step], None] | None = None, zones: DataFrame | None = None) -> DatasetProfile:
    """Statistics of every array of a dataset (sources.store.Dataset), or of the deformations and masks named.

    One job makes the zone map of all arrays (sources.zones), unless one is given, and the statistics are sums over it.
    median: "histogram" (one more job, which opens the chunks that span several bins), "exact" (refined histograms, array
    by array) or "skip" (null). All flows' layouts are checked before a voxel is read. Arrays are told to progress in the
    order reference, masks, then each deformation's image and flow, when their row is there.
    """
    from strainlake.functions.shipping import ship, stored
    from strainlake.sources import zones as Z

    if bins < 2:
        raise ValueError(f"bins must be at least 2, got {bins}")
    if median not in ("histogram", "exact", "skip"):
        raise ValueError(f"median must be histogram, exact or skip, got {median!r}")
    for section, names, known in (("masks", masks, ds.list_masks()), ("deformations", include, ds.list_all())):
        if absent := [n for n in names or [] if n not in known]:
            raise KeyError(f"no {section} {absent} in the dataset")
    entries, mask_names = ds.list_all() if include is None else list(include), ds.list_masks() if masks is None else list(masks)
    for e in entries:
        if ds.entries[e] == "synthetic":
            ds.check_flow(e)
    began, spark = time.monotonic(), ds.spark
    ship(spark)
    plan = arrays_of(ds, entries, mask_names)
    map_ = stored(Z.zones(spark, ds.store, [a for _, _, a in plan]), "zones") if zones is None else zones
    found = {r["name"]: r for r in Z.summary(map_.where(F.col("name").isin([a.name for _, _, a in plan]))).collect()}  # a row for each array
    wanted = [a for role, _, a in plan if role != "mask"]
    medians = {r["name"]: r["median"] for r in Z.median(spark, ds.store, wanted, map_, bins).collect()} if median == "histogram" else {}
    rows: dict[str, list[tuple]] = {"volumes": [], "masks": [], "flows": []}
    for i, (role, name, a) in enumerate(plan):
        r, middle = found[a.name], medians.get(a.name)
        if median == "exact" and role != "mask":
            t = ds.load_flow(name) if role == "flow" else ds.load_reference() if role == "reference" else ds.load_image(name)
            u = F.sqrt(sum((F.pow(F.col(f"d{x}").cast("double"), F.lit(2.0)) for x in "zyx"), F.lit(0.0))) if role == "flow" else F.col("value")
            middle = exact_quantile(t.select(F.lit(name).alias("name"), u.alias("value")), 0.5, "name")[name]
        if role == "mask":
            rows["masks"].append((name, r["n_true"], r["n"] - r["n_true"], r["n_true"] / r["n"]))
        elif role == "flow":
            rows["flows"].append((name, r["n"], r["mean"], r["max"], *[r[f"{k}_{x}"] for x in "zyx" for k in ("mean", "max")], middle))
        else:
            rows["volumes"].append((name, r["n"], r["mean"], r["min"], r["max"], middle, role))
        if progress:
            progress(Step(role, name, i, len(plan), time.monotonic() - began))
    if progress:
        progress(Step("done", "", len(plan), len(plan), time.monotonic() - began))
    u = [x for a in "zyx" for x in (f"mean_{a} double", f"max_{a} double")]
    schemas = {"volumes": "name string, n long, mean double, min double, max double, median double, role string", "masks": "name string, foreground long, background long, fraction double", "flows": ", ".join(["name string, n long, mean_u double, max_u double", *u, "median_u double"])}
    return DatasetProfile(**{k: spark.createDataFrame(rows[k], s) for k, s in schemas.items()})
