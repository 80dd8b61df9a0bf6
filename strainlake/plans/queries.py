"""The engine's queries over the driver's tables. Integers come as long, fractions as double rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strainlake.config import CorrelateConfig
from strainlake.functions import fields, phantom, units
from strainlake.operators import lattice as L, ncc, peaks, profile, robust, score, taper
from strainlake.plans import budget, campaign_tables as C, correlate as P
from strainlake.plans.carriers import EVENTS_SHAPE, LATTICE, SHAPE, SHIFT, cube, event_field, mask, rolled, table, vectors, volume

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
W4 = (4, 4, 4)
FIELD_CONFIG = CorrelateConfig(window=8, overlap=0.5, mask_threshold=0.5)


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = f(spark, sf_dir)
        as_long, as_double = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
        return t.select(*[F.col(c).cast("long") if k in as_long else (F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) if k in as_double else F.col(c) for c, k in t.dtypes])

    QUERIES[f.__name__] = run
    return f


def _scans(spark, d):
    """Parts as scans of different shapes, windows and overlaps."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("scan"), (size + 6).alias("nz"), (size % 7 + 8).alias("ny"), (size % 5 + 5).alias("nx"), F.lit(6).alias("window"), (key % 4 / 4).alias("overlap"), (key % 5 + 1).cast("int").alias("shards"), (size % 3).alias("margin"))


@query
def lattice_grid(spark, d):
    return L.lattices(_scans(spark, d), ("scan",)).drop("count_z")


@query
def stride_overlap(spark, d):
    w = table(spark, d, "part").select(F.col("p_size").alias("w")).distinct()
    return w.select("w", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 0.9)])).alias("o")).select("w", "o", L.stride(F.col("w"), F.col("o")).alias("stride"))


@query
def integral_image(spark, d):
    return L.integral_image(mask(cube(spark, d)).withColumn("value", F.col("value").cast("int")))


@query
def box_sums(spark, d):
    sat = L.integral_image(mask(cube(spark, d)).withColumn("value", F.col("value").cast("int")))
    return L.box_sums(L.lattice_table(spark, LATTICE), sat, LATTICE)


@query
def box_sum_admission(spark, d):
    return L.admit(L.lattice_table(spark, LATTICE), mask(cube(spark, d)), LATTICE, 0.6).select("poi", "fraction", "admitted")


@query
def zslab_shards(spark, d):
    t = L.lattices(_scans(spark, d), ("scan", "shards"))
    return t.select("scan", "poi", "shards", L.slab_of(F.col("iz"), F.col("count_z"), F.col("shards")).alias("slab"))


@query
def interior_points(spark, d):
    t = L.lattices(_scans(spark, d), ("scan", "nz", "ny", "nx", "window", "margin"))
    return t.where(L.within(F.col("margin"), F.col("window"))).select("scan", "poi")


@query
def extract_windows(spark, d):
    return L.covering(volume(cube(spark, d)), LATTICE).select("poi", "jz", "jy", "jx", "value")


@query
def center_crop(spark, d):
    return L.center_crop(volume(cube(spark, d)), SHAPE, (7, 16, 15))


@query
def tukey_1d(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("scan"), F.col("p_size").alias("n"), (F.col("p_partkey") % 5 / 4).alias("alpha"))
    t = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return t.withColumn("w", taper.tukey_of(F.col("i"), F.col("n"), F.col("alpha")))


@query
def tukey_3d(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("scan"), (F.col("p_partkey") % 3 / 2).alias("alpha"), *[(F.col("p_size") % m + 1).alias(f"n{a}") for a, m in zip("zyx", (3, 5, 7), strict=True)])
    w = F.lit(1.0)
    for a in "zyx":
        p = p.withColumn(f"j{a}", F.explode(F.sequence(F.lit(0), F.col(f"n{a}") - 1)))
        w = w * taper.tukey_of(F.col(f"j{a}"), F.col(f"n{a}"), F.col("alpha"))
    return p.select("scan", "jz", "jy", "jx", w.alias("w"))


@query
def preprocess_masked(spark, d):
    w = L.covering(cube(spark, d), LATTICE)
    return taper.preprocess(w, LATTICE.window, 0.25, "value", "m").select("poi", "jz", "jy", "jx", "value")


@query
def preprocess_unmasked(spark, d):
    return taper.preprocess(L.covering(volume(cube(spark, d)), LATTICE), LATTICE.window, 0.0, "value").select("poi", "jz", "jy", "jx", "value")


def _corr(spark, d, mode="linear", normalization="overlap"):
    w = vectors(spark, d)
    for c in ("r", "d"):
        w = taper.preprocess(w, W4, 0.0, c)
    return ncc.correlate(w, W4, mode, normalization)


def _rounded(t):
    """Values to nine digits before peaks are taken, so that equal ones tie in any engine."""
    return t.withColumn("ncc", F.round("ncc", 9))


@query
def ncc_cyclic(spark, d):
    return _corr(spark, d, "cyclic", "global")


@query
def ncc_linear_global(spark, d):
    return _corr(spark, d, "linear", "global")


@query
def ncc_linear_overlap(spark, d):
    return _corr(spark, d)


@query
def integer_peak(spark, d):
    return peaks.integer_peak(_rounded(_corr(spark, d, "cyclic", "global")), W4)


@query
def peak_neighbors(spark, d):
    c = _rounded(_corr(spark, d, "cyclic", "global"))
    return peaks.neighbours(c, peaks.integer_peak(c, W4), W4)


@query
def subvoxel_fit(spark, d):
    return peaks.subvoxel(_rounded(_corr(spark, d, "linear", "global")), W4)


@query
def search_radius_gate(spark, d):
    return peaks.gate(peaks.subvoxel(_rounded(_corr(spark, d, "cyclic", "global")), W4), 1.0).select("poi", "dz", "dy", "dx", "in_range")


@query
def normalized_median_outlier(spark, d):
    return robust.outliers(event_field(spark, d), 2.0, 0.1, 4).select("poi", "residual", "outlier")


@query
def neighbor_count(spark, d):
    return robust.outliers(event_field(spark, d)).select("poi", "n_neighbors")


def _field(spark, d, config=FIELD_CONFIG, kernel="fft"):
    from strainlake.functions.shipping import ship

    ship(spark)
    t = cube(spark, d)
    return P.correlate(volume(t), rolled(t), SHAPE, mask(t), config=config, digits=9, kernel=kernel)


@query
def displacement_field(spark, d):
    return _field(spark, d).select("poi", "iz", "iy", "ix", "pz", "py", "px", "dz", "dy", "dx", "valid", "confidence", "status")


@query
def status_summary(spark, d):
    return score.status_counts(_field(spark, d))


@query
def field_error_report(spark, d):
    f = _field(spark, d)
    for a, s in zip("zyx", SHIFT, strict=True):
        f = f.withColumn(f"t{a}", F.lit(float(s)))
    return score.report(f)


@query
def error_report(spark, d):
    return score.report(event_field(spark, d))


@query
def sweep_reports(spark, d):
    return score.sweep_reports(event_field(spark, d).withColumn("entry", F.concat(F.lit("u"), F.col("ix").cast("string"))))


@query
def average_ranks(spark, d):
    return score.average_rank(event_field(spark, d), "confidence", "rank").select("poi", "rank")


@query
def spearman(spark, d):
    return score.spearman(score.errors(event_field(spark, d).where("valid")), "confidence", "norm")


def _distances(spark, d):
    f = event_field(spark, d)
    solid = f.select(F.col("iz").alias("z"), F.col("iy").alias("y"), F.col("ix").alias("x"), (F.col("confidence") >= 4).alias("value"))
    points = f.select("*", *[F.col(f"i{a}").cast("float").alias(f"p{a}") for a in "zyx"])
    return score.distance_to(points, solid, EVENTS_SHAPE)


@query
def distance_to_valid(spark, d):
    return _distances(spark, d).select("poi", "distance")


@query
def boundary_strata(spark, d):
    return score.strata(_distances(spark, d), (0.0, 1.0, 1.5, 3.0, 40.0))


def _volumes(spark, d):
    t = cube(spark, d)
    return volume(t).withColumn("volume_id", F.lit("reference")).unionByName(rolled(t).withColumn("volume_id", F.lit("deformed")))


@query
def intensity_stats(spark, d):
    return profile.intensity(_volumes(spark, d))


@query
def mask_stats(spark, d):
    return profile.mask(mask(cube(spark, d)).withColumn("mask_id", F.concat(F.lit("z"), F.expr("string(z div 8)"))))


@query
def displacement_stats(spark, d):
    return profile.displacement(event_field(spark, d).withColumn("entry", F.concat(F.lit("u"), F.col("ix").cast("string"))))


@query
def histogram_median(spark, d):
    return profile.histogram_median(_volumes(spark, d).unionByName(volume(cube(spark, d)).where("z = 0").withColumn("value", F.lit(3.0)).withColumn("volume_id", F.lit("constant"))), 64)


@query
def exact_median(spark, d):
    return profile.exact_median(_volumes(spark, d))


def _flow(t):
    return t.select("z", "y", "x", (F.col("y") % 3 - 1).alias("dz"), (F.col("x") % 5 - 2).alias("dy"), (F.col("z") % 2).alias("dx"))


@query
def warp_integer(spark, d):
    t = cube(spark, d)
    return fields.warp_integer(volume(t), _flow(t), SHAPE)


@query
def flow_convention_check(spark, d):
    t = cube(spark, d)
    deformed = fields.warp_integer(volume(t), _flow(t), SHAPE, -1)
    return profile.convention(volume(t), deformed, _flow(t), SHAPE).select("mse_pull_back", "mse_push_forward", "convention")


def _points(spark, d):
    """Orders as measured points within the cube."""
    tenth = lambda c, m: (c % m * 0.1).alias
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(o.alias("poi"), tenth(o, 157)("pz"), tenth(c, 317)("py"), tenth(o * 7 + c, 313)("px"))


AT = ("pz", "py", "px")


@query
def field_rigid(spark, d):
    return fields.with_field(_points(spark, d), fields.rigid((1.5, -2.25, 0.5)))


@query
def field_dilation(spark, d):
    return fields.with_field(_points(spark, d), fields.dilation(0.01, (8.0, 16.0, 16.0), AT))


@query
def field_shear(spark, d):
    return fields.with_field(_points(spark, d), fields.shear(0.02, "z", "x", 16.0, AT))


@query
def field_sinusoid(spark, d):
    return fields.with_field(_points(spark, d), fields.sinusoid((1.0, 0.5, 2.0), (16.0, 32.0, 24.0), (0.0, 0.5, 1.0), AT))


@query
def field_compose(spark, d):
    return fields.with_field(_points(spark, d), fields.compose(fields.rigid((1.0, 0.0, -1.0)), fields.dilation(0.01, (8.0, 16.0, 16.0), AT), fields.shear(0.02, "y", "z", 0.0, AT)))


@query
def phantom_scaffold(spark, d):
    t = cube(spark, d).withColumn("strut", F.col("m"))
    return phantom.scaffold(t, phantom.bone(SHAPE, radius=12.0, wall=3.0, rod=3.0, hole=3.0)).select("z", "y", "x", "intensity")


@query
def trabecular_quantile(spark, d):
    return phantom.above_quantile(volume(cube(spark, d)), 0.7).select("z", "y", "x", "strut")


def _variants(spark, d):
    w = table(spark, d, "region").select((8 * (F.col("r_regionkey") + 1)).alias("window"))
    t = table(spark, d, "nation").select((F.col("n_nationkey") * 4).alias("threshold"))
    points = C.sweep([w, t]).withColumn("name", F.concat(F.lit("w"), F.col("window").cast("string"), F.lit("-mt"), F.col("threshold").cast("string"))).withColumn("place", F.col("window") * 1000 + F.col("threshold"))
    own = table(spark, d, "region").select((F.lit(8) * (1 + F.col("r_regionkey") * 2)).alias("window"), F.lit(50).alias("threshold"), F.concat(F.lit("own"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_regionkey").alias("place"))
    return C.expand(points, own, ["window", "threshold"])


@query
def sweep_expand(spark, d):
    return _variants(spark, d)


@query
def params_hash(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return p.select("p_partkey", C.params_hash(C.canonical_json(["p_size", "p_partkey"])).alias("params_hash"))


@query
def resume_pending(spark, d):
    v = _variants(spark, d).select("variant_id", "params_hash", "window")
    jobs = table(spark, d, "nation").select(F.lit("s").alias("store"), F.col("n_name").alias("deformation"), "n_nationkey").crossJoin(v)
    done = jobs.where((F.col("n_nationkey") + F.col("window")) % 3 == 0).withColumn("status", F.when(F.col("n_nationkey") % 2 == 0, "ok").otherwise("failed"))
    return C.pending(jobs, done).select("store", "deformation", "variant_id", "params_hash")


@query
def select_entries(spark, d):
    e = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "real").otherwise("synthetic").alias("kind"))
    return C.select(e, table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_name").alias("name")))


def _results(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("store"), F.lit("d").alias("deformation"), F.col("o_custkey").cast("string").alias("variant_id"), F.col("o_orderdate").alias("written_at"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("mae"))


@query
def latest_manifest(spark, d):
    return C.latest(_results(spark, d)).select("store", "variant_id", "row_id", "mae")


@query
def best_variants(spark, d):
    return score.best_variants(spark, C.latest(_results(spark, d)), 3, "mae", ("store",)).select("store", "variant_id", "mae", "place")


@query
def broken_entries(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_returnflag").alias("role")).distinct()
    t = C.missing_roles(c, ["A", "N", "R"])
    return t.select("entry", F.concat_ws(",", "missing").alias("missing"), "status")


@query
def catalog_verify(spark, d):
    """The structural checks over a catalog of arrays that line items stand for, as many stores as there are orders."""
    from strainlake.sources.store import check_catalog

    role = F.element_at(F.create_map(*[F.lit(x) for x in ("A", "deformed", "N", "mask", "R", "flow")]), F.col("l_returnflag"))
    tax = F.round(F.col("l_tax") * 100).cast("int")
    dims = lambda *n: F.array(*[F.lit(x) for x in n])
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("line"), role.alias("role"), tax.alias("tax"), "l_quantity", "l_discount", "l_linestatus")
    is_flow = F.col("role") == "flow"
    shape = F.when(F.col("tax") == 8, dims(16, 32)).when(is_flow & (F.col("tax") == 7), dims(3, 16, 32, 30)).when(is_flow & (F.col("tax") == 6), dims(2, 16, 32, 32)).when(is_flow, dims(3, *SHAPE)).when(F.col("tax") == 7, dims(16, 32, 30)).otherwise(dims(*SHAPE))
    dtype = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0), "float64").when(F.col("role") == "mask", "bool").otherwise("float32")
    absent = F.col("l_quantity") > 49
    catalog = li.select(F.concat_ws("/", "entry", "line").alias("entry"), "role", F.when(~absent, F.concat_ws("/", "role", "entry")).alias("path"), F.when(~absent, shape).alias("shape"), F.when(~absent, dtype).alias("dtype"))
    return check_catalog(catalog, dims(*SHAPE), {"deformed": "float32", "mask": "bool", "flow": "float32"}, "3_zyx")


@query
def budget_batch(spark, d):
    p = table(spark, d, "part")
    kind = F.col("p_partkey") % 3
    mode, norm = F.when(kind == 0, "cyclic").otherwise("linear"), F.when(kind == 2, "overlap").otherwise("global")
    window, voxels = 16 + 8 * (F.col("p_size") % 11), (500 + 10 * F.col("p_size")).cast("long") * 1280 * 1280
    free = (16 + F.col("p_partkey") % 64).cast("long") * (1 << 30)
    return p.select("p_partkey", window.alias("window"), mode.alias("mode"), norm.alias("normalization"), *[c.alias(k) for k, c in budget.batch_of(free, voxels, window, mode, norm).items()])


@query
def unit_convert(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.element_at(F.array(F.lit("nm"), F.lit("um"), F.lit("mm")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("unit"))
    return p.select("p_partkey", "unit", (F.col("p_size") * units.factor(F.col("unit"), "um")).alias("um"))


@query
def field_points_export(spark, d):
    f = event_field(spark, d).select("*", *[F.col(f"i{a}").alias(f"p{a}") for a in "zyx"], F.lit(0).alias("status"))
    return units.points_table(f, units.VoxelSpacing(2.0, 0.5, 1.5, "um"))


@query
def masked_volume(spark, d):
    t = cube(spark, d)
    return units.masked_volume(volume(t), mask(t))


@query
def iso_cells(spark, d):
    return units.iso_cells(volume(cube(spark, d)), 120.0)


@query
def magnitude_percentiles(spark, d):
    return score.magnitudes(event_field(spark, d))


def shipped(f: Query) -> Query:
    """A query whose executors run functions of this package."""

    def run(spark, d):
        from strainlake.functions.shipping import ship

        ship(spark)
        return f(spark, d)

    run.__name__ = f.__name__
    return query(run)


# Not expressible in SQL: held against the other kernel, exact round trips or known answers in tests.


def plain(f: Query) -> Query:
    def run(spark, d):
        from strainlake.functions.shipping import ship

        ship(spark)
        return f(spark, d)

    QUERIES[f.__name__] = run
    return f


@shipped
def ncc_fft(spark, d):
    """The transform kernel's field under cyclic correlation."""
    return _field(spark, d, CorrelateConfig(window=8, mask_threshold=0.5, mode="cyclic", normalization="global"))


@shipped
def make_texture(spark, d):
    from strainlake.functions.synth import grain

    return grain(volume(cube(spark, d)), SHAPE, 1.5)


@plain
def warp_cubic(spark, d):
    from strainlake.functions.synth import warp

    return warp(volume(cube(spark, d)), fields.rigid((0.5, -1.25, 0.75)), SHAPE)


@shipped
def warp_linear(spark, d):
    from strainlake.functions.synth import warp

    return warp(volume(cube(spark, d)), fields.rigid((0.5, -1.25, 0.75)), SHAPE, 1)


@shipped
def field_linear(spark, d):
    """The cube sampled where orders point, beyond its faces too."""
    from strainlake.functions.signal import sample

    o = table(spark, d, "orders")
    tenth = lambda c, m, less: ((c % m) * 0.1 - less).cast("double")
    p = o.select(F.col("o_orderkey").alias("poi"), tenth(F.col("o_orderkey"), 173, 0.6).alias("pz"), tenth(F.col("o_custkey"), 337, 0.8).alias("py"), tenth(F.col("o_orderkey") * 7 + F.col("o_custkey"), 333, 0.7).alias("px"))
    return sample(p, volume(cube(spark, d)), SHAPE, 1)


@plain
def field_spline(spark, d):
    from strainlake.functions.signal import sample, spline_table

    return sample(L.lattice_table(spark, LATTICE), spline_table(volume(cube(spark, d)), SHAPE), SHAPE)


@shipped
def distance_volume(spark, d):
    from strainlake.functions.signal import distance_volume as f

    return f(mask(cube(spark, d)), SHAPE)


@shipped
def phantom_render(spark, d):
    from strainlake.functions.synth import grain, rendered

    t = cube(spark, d)
    spec = phantom.bone(SHAPE, radius=12.0, wall=3.0, rod=3.0, hole=3.0)
    return rendered(t.select("z", "y", "x", F.col("m").alias("strut")), grain(volume(t), SHAPE, spec.grain[1]), spec)


@query
def zarr_roundtrip(spark, d):
    """The cube written by the executors as a chunked array and read back through the data source."""
    from strainlake.functions.shipping import shared_folder, ship
    from strainlake.sources import zarr_source

    ship(spark)
    store = shared_folder(spark, "store") + "/cube.zarr"
    zarr_source.write_volume(volume(cube(spark, d)), store, "base/volume0", SHAPE, (8, 16, 16))
    return zarr_source.load_volume(spark, store, "base/volume0")


def _stored(spark, d) -> str:
    """A store of the cube, its rolled copy and its mask, written by the executors."""
    from strainlake.functions.shipping import shared_folder
    from strainlake.sources import zarr_source

    store, t = shared_folder(spark, "store") + "/cube.zarr", cube(spark, d)
    for name, v, dtype in (("reference", volume(t), "float32"), ("deformed", rolled(t), "float32"), ("mask", mask(t), "bool")):
        zarr_source.write_volume(v, store, name, SHAPE, (4, 16, 8), dtype)
    return store


@shipped
def zone_profile(spark, d):
    """Statistics and medians of a store's arrays from its zone map."""
    from strainlake.sources import zones

    store = _stored(spark, d)
    arrays = [zones.Array(n, n) for n in ("reference", "deformed", "mask")]
    of = zones.build(spark, store, arrays, f"{store}.zones")
    return zones.summary(of).join(zones.median(spark, store, arrays, of, 64), "name").select("name", "n", "n_true", "mean", "min", "max", "median")


@shipped
def zarr_region(spark, d):
    """Voxels of a range of places, from the chunks it touches."""
    from strainlake.sources import zarr_source

    return zarr_source.load_volume(spark, _stored(spark, d), "deformed", region=((3, 9), (None, 20), (17, None)))


@shipped
def displacement_field_stored(spark, d):
    """The field of stored volumes: chunks are opened where tiles with admitted points need them."""
    store = _stored(spark, d)
    f = P.correlate_arrays(spark, (store, "reference"), (store, "deformed"), (store, "mask"), config=FIELD_CONFIG, digits=9)
    return f.select("poi", "dz", "dy", "dx", "valid", "confidence", "status")


@shipped
def campaign_fields(spark, d):
    """A campaign over a store of the cube: three mask thresholds in one plan, their fields as written."""
    from strainlake.functions.shipping import shared_folder
    from strainlake.plans import campaign, together
    from strainlake.sources import fieldstore, zarr_source

    base, t = shared_folder(spark, "campaign"), cube(spark, d)
    store = f"{base}/cube.zarr"
    for name, v, dtype in (("base/volume0", volume(t), "float32"), ("iterations/016/volume1", rolled(t), "float32"), ("base/mask", mask(t), "bool"), ("synthetic/004/volume1", rolled(t), "float32")):
        zarr_source.write_volume(v, store, name, SHAPE, (4, 16, 8), dtype)  # the synthetic entry has no flow: it is left out
    spec = campaign.Spec.parse({"campaign": "cube", "stores": [store], "out_dir": base, "strict": False, "defaults": {"window": 8, "mask_threshold": 0.5}, "sweep": {"mask_threshold": [0.4, 0.5, 0.6]}})
    together.run(spark, spec, digits=9)
    known = F.broadcast(campaign.index(spark, spec).select("variant_id", F.get_json_object("params", "$.mask_threshold").cast("double").alias("mask_threshold")))  # a row for each variant
    f = fieldstore.load(spark, campaign.fields_path(spec, store)).join(known, "variant_id")
    return f.select("mask_threshold", "poi", "dz", "dy", "dx", "valid", "confidence", "status")


@shipped
def frame_pairs(spark, d):
    from strainlake.streaming.frames import pairs

    f = table(spark, d, "events").select(F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("t"), F.col("event_type").alias("path"))
    return pairs(f, "sequential")


@shipped
def iso_surface(spark, d):
    """Each triangle of the cube's surface at 120.5: its cell, its corners in rising order, its area."""
    from strainlake.functions import surface

    t = surface.surface(volume(cube(spark, d)), SHAPE, 120.5, edge=8)
    name = F.sort_array(F.array("a", "b", "c"))
    return t.select("z", "y", "x", *[name[i].alias(c) for i, c in enumerate("abc")], surface.area().alias("area"))


@shipped
def surface_measures(spark, d):
    """Counts of triangles, corners, edges and open edges of the surface of a stored, masked cube, and its area."""
    from strainlake.functions import surface
    from strainlake.functions.shipping import shared_folder
    from strainlake.sources import zarr_source

    store, t = shared_folder(spark, "store") + "/cube.zarr", cube(spark, d)
    zarr_source.write_volume(units.masked_volume(volume(t), mask(t)), store, "masked", SHAPE, (4, 16, 8), "float32")
    mesh = surface.surface_of_array(spark, store, "masked", 120.5, units.VoxelSpacing(2.0, 1.0, 0.5, "um"))
    return surface.measures(mesh, spark.range(1).select(F.lit("masked").alias("frame")))  # a row where nothing is above the level, too


@query
def structured_grid(spark, d):
    """The whole lattice of events as a grid for viewers, with the magnitude of its errors."""
    f = score.errors(event_field(spark, d))
    f = f.select("*", *[(F.col(f"i{a}") * 4 + 3.5).alias(f"p{a}") for a in "zyx"])
    return units.structured_grid(f, units.VoxelSpacing(2.0, 0.5, 1.5, "um"), ("confidence",))


@shipped
def frame_pairs_state(spark, d):
    """Events as a file stream of frames: the series' state pairs each with the one before it."""
    from strainlake.functions.shipping import shared_folder
    from strainlake.streaming import frames

    base, source = shared_folder(spark, "series"), f"{d}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{d}/events*.parquet")  # a file stream takes folders and patterns
    f = e.select(F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("t"), F.col("event_type").alias("path"))
    w = frames.paired(f, frames.SEQUENTIAL).writeStream.format("parquet").option("path", f"{base}/pairs").option("checkpointLocation", f"{base}/checkpoint")
    w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frames.PAIR).parquet(f"{base}/pairs")
