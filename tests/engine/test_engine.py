"""Engine operators against plain NumPy, known answers and each other."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strainlake.config import CorrelateConfig, Lattice
from strainlake.functions import fields, phantom, signal, synth, units
from strainlake.functions.shipping import ship
from strainlake.operators import lattice as L, ncc_fft, profile, robust, score, taper
from strainlake.plans import budget
from strainlake.plans.correlate import at_thresholds, correlate, correlate_arrays, correlate_pairs, voxel_peaks
from strainlake.operators import blocks
from strainlake.sources import zarr_source


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def voxels(spark, a):
    z, y, x = (i.ravel().astype("int32") for i in np.indices(a.shape))
    return spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "value": a.ravel()}))


def array(t, shape):
    p = t.toPandas()
    out = np.full(shape, np.nan)
    out[p.z, p.y, p.x] = p["value"].astype(float)
    return out


def texture(shape, seed, sigma=1.2):
    v = np.random.default_rng(seed).standard_normal(shape)
    for axis in range(3):
        v = np.moveaxis(signal.smooth(np.moveaxis(v, axis, 0), sigma), 0, axis)
    return (v - v.mean()) / v.std()


def test_lattice_counts_and_errors(spark):
    assert Lattice((960, 1280, 1280)).counts == (19, 25, 25)
    assert Lattice((20, 20, 20), 5, 0.5).stride == (2, 2, 2)  # 2.5 rounds to even
    for bad in ({"shape": (4, 4, 4), "window": 8}, {"shape": (9, 9, 9), "window": 4, "overlap": 1.0}, {"shape": (9, 9), "window": 4}, {"shape": (9, 9, 9), "window": 0}):
        with pytest.raises(ValueError):
            Lattice(**bad)
    t = L.lattice_table(spark, Lattice((10, 9, 8), (4, 3, 2), 0.5)).toPandas()
    assert (t.poi.diff().dropna() == 1).all() and t.iloc[-1][["iz", "iy", "ix"]].tolist() == [3, 3, 6]


def test_admission_equals_sums(spark):
    m = np.random.default_rng(0).random((10, 9, 11)) > 0.3
    lat = Lattice(m.shape, (4, 3, 5), 0.4)
    p = L.lattice_table(spark, lat)
    got = L.admit(p, voxels(spark, m), lat, 0.7).orderBy("poi").toPandas()
    want = [m[r.z0 : r.z0 + 4, r.y0 : r.y0 + 3, r.x0 : r.x0 + 5].mean() for r in got.itertuples()]
    assert np.allclose(got.fraction, want) and (got.admitted == (np.array(want) >= 0.7)).all()
    sat = L.integral_image(voxels(spark, m.astype("int32")))
    sums = L.box_sums(p, sat, lat).orderBy("poi").toPandas()
    assert (sums.total == np.round(np.array(want) * 60)).all()


def test_slabs_cover(spark):
    lat = Lattice((20, 8, 8), 4, 0.5)
    for n in (1, 3, 4, 20):
        s = L.slabs(L.lattice_table(spark, lat), lat, n).groupBy("slab").agg(F.countDistinct("iz").alias("c")).toPandas().set_index("slab").c
        want = [len(x) for x in np.array_split(np.arange(lat.counts[0]), n)]
        assert [int(s.get(i, 0)) for i in range(n)] == want


def test_taper_definition():
    for n, a in itertools.product((1, 2, 9, 32), (0.0, 0.25, 1.0)):
        w = ncc_fft.taper(n, a)
        assert np.allclose(w, w[::-1]) and w.max() <= 1
        if n > 1 and a > 0:
            assert abs(w[0]) < 1e-12
    assert np.allclose(ncc_fft.taper(9, 1.0), 0.5 * (1 - np.cos(2 * np.pi * np.arange(9) / 8)))


@pytest.mark.parametrize("mode,norm", [("cyclic", "global"), ("linear", "global"), ("linear", "overlap")])
def test_correlation_invariants(mode, norm):
    rng = np.random.default_rng(3)
    r = rng.standard_normal((3, 6, 8, 10))
    c = ncc_fft.correlation(r, r, mode, norm)
    assert np.allclose(c[:, 0, 0, 0], 1) and np.isfinite(ncc_fft.correlation(r * 0, r * 0, mode, norm)).all()
    lag, fine, _ = ncc_fft.peak_of(c)
    assert (lag == 0).all() and np.abs(fine).max() <= 0.5
    if mode == "cyclic":
        for shift in ((2, -3, 4), (-2, 1, -3), (0, 0, 3)):
            lag, _, _ = ncc_fft.peak_of(ncc_fft.correlation(r, np.roll(r, shift, (1, 2, 3)), mode, norm))
            assert (lag == shift).all()


def test_subvoxel_on_an_ideal_peak():
    g = np.indices((12, 12, 12)).astype(float)
    for off in ((0.3, 0, 0), (0, 0.45, 0), (0.25, -0.15, 0.35)):
        c = np.exp(-sum((g[a] - p - o) ** 2 for a, (p, o) in enumerate(zip((5, 4, 3), off))) / (2 * 1.5**2))[None]
        lag, fine, _ = ncc_fft.peak_of(c)
        assert lag[0].tolist() == [5, 4, 3] and np.abs(fine[0] - lag[0] - off).max() < 5e-3


def test_kernels_agree_and_recover_a_shift(spark):
    v = texture((16, 20, 20), 1)
    d, m = np.roll(v, (1, -2, 1), (0, 1, 2)), np.random.default_rng(2).random((16, 20, 20)) > 0.2
    for cfg in (CorrelateConfig(window=8, mask_threshold=0.75), CorrelateConfig(window=(6, 5, 8), mask_threshold=0.75, mode="cyclic", normalization="global")):
        out = [correlate(voxels(spark, v), voxels(spark, d), v.shape, voxels(spark, m), config=cfg, kernel=k, digits=9, tile_memory=600_000).orderBy("poi").toPandas() for k in ("fft", "sql")]
        assert (out[0].status == out[1].status).all()
        assert np.abs(out[0][["dz", "dy", "dx", "confidence"]] - out[1][["dz", "dy", "dx", "confidence"]]).max().max() < 1e-5
    f = correlate(voxels(spark, v), voxels(spark, d), v.shape, config=CorrelateConfig(window=8)).where("valid").toPandas()
    assert np.abs(f[["dz", "dy", "dx"]].median() - [1, -2, 1]).max() < 0.2
    assert set(correlate(voxels(spark, v), voxels(spark, d), v.shape, config=CorrelateConfig(window=8)).toPandas().pair_id) == {"pair"}


def test_tile_size_does_not_matter(spark):
    v = texture((14, 18, 18), 5)
    d = np.roll(v, (0, 1, -1), (0, 1, 2))
    lat, cfg = Lattice(v.shape, 6, 0.5), CorrelateConfig(window=6)
    p = L.lattice_table(spark, lat).where("poi % 3 <> 1")
    outs = [voxel_peaks(voxels(spark, v), voxels(spark, d), None, None, p, lat, cfg, t, batch=b).orderBy("poi").toPandas() for t, b in ((1, 64), (2, 3), (9, 7))]
    assert len(outs[0]) == p.count()
    for o in outs[1:]:
        assert np.allclose(o, outs[0])


def padded_twice(r, d, eps=1e-12):
    """The overlap-normalised map by transforms padded to two windows, energies included."""
    w, axes = r.shape[1:], (1, 2, 3)
    size = tuple(2 * n for n in w)
    f = lambda a: np.fft.rfftn(a, s=size, axes=axes)
    at = np.ix_(range(len(r)), *[np.r_[0 : n - n // 2, 2 * n - n // 2 : 2 * n] for n in w])
    back = lambda a: np.fft.irfftn(a, s=size, axes=axes)[at]
    box = f(np.ones((1, *w)))
    energy = np.maximum(0, back(np.conj(f(r * r)) * box)) * np.maximum(0, back(np.conj(box) * f(d * d)))
    return back(np.conj(f(r)) * f(d)) / np.sqrt(energy + eps)


@pytest.mark.parametrize("window", [(8, 8, 8), (5, 7, 6), (1, 2, 3), (16, 9, 12)])
def test_short_padding_and_prefix_energies(window):
    r, d = np.random.default_rng(3).standard_normal((2, 3, *window))
    want = padded_twice(r, d)
    assert np.allclose(ncc_fft.correlation(r, d), want, atol=1e-9)
    single = ncc_fft.correlation(r.astype(np.float32), d.astype(np.float32))
    assert np.allclose(single, want, atol=1e-4)
    assert all(ncc_fft.padded(w) >= w + w // 2 for w in range(1, 200))


def test_tiles_fit_memory_and_leave_work_for_all_cores():
    lat = Lattice((160, 160, 160), 32, 0.5)
    for cores in (1, 8, 64):
        t = budget.tile_points(1 << 30, lat, CorrelateConfig(window=32), cores)
        assert np.prod([-(-n // t) for n in lat.counts]) >= 2 * cores
    large = Lattice((960, 1280, 1280), 96, 0.5)
    for memory in (200 << 20, 1 << 30):
        for precision in ("double", "single"):
            cfg = CorrelateConfig(precision=precision)
            t = budget.tile_points(memory, large, cfg, 8)
            assert t == 1 or budget.PER_VOXEL[precision] * (48 * (t - 1) + 96) ** 3 + ncc_fft.window_bytes((96,) * 3, single=precision == "single") <= memory
    assert budget.tile_points(1, lat, CorrelateConfig(window=32)) == 1


def test_pairs_of_frames_in_one_plan(spark):
    shape, cfg = (14, 18, 18), CorrelateConfig(window=6, mask_threshold=0.7)
    frames = {"a": texture(shape, 5)}
    frames["b"], frames["c"] = np.roll(frames["a"], (0, 1, -1), (0, 1, 2)), np.roll(frames["a"], (1, 1, 0), (0, 1, 2))
    m = np.random.default_rng(2).random(shape) > 0.28
    m[:, :9, :9] = False
    rows = [blocks.of_voxels(voxels(spark, v), k, 7, shape) for k, v in (frames | {"m": m}).items()]
    table = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    pairs = spark.createDataFrame([("ab", "a", "b", "m"), ("bc", "b", "c", "m"), ("ac", "a", "c", "m")], "pair_id string, reference string, deformed string, mask string")
    for masked in (True, False):
        got = correlate_pairs(table, pairs, shape, (7, 7, 7), masked, cfg).toPandas()
        for name in ("ab", "bc", "ac"):
            own = correlate(voxels(spark, frames[name[0]]), voxels(spark, frames[name[1]]), shape, voxels(spark, m) if masked else None, config=cfg, pair_id=name).orderBy("poi").toPandas()
            mine = got[got.pair_id == name].sort_values("poi").reset_index(drop=True)
            pd.testing.assert_frame_equal(mine, own, check_exact=False, atol=1e-6)
        assert not masked or {0, 1} <= set(got.status)


def test_stored_volumes_block_by_block(spark, tmp_path):
    store, shape = f"{tmp_path}/v.zarr", (13, 17, 20)
    v = texture(shape, 8).astype("float32")
    d, m = np.roll(v, (1, 0, -1), (0, 1, 2)), np.random.default_rng(4).random(shape) > 0.2
    for name, a, chunks in (("r", v, (5, 6, 20)), ("d", d, (13, 8, 8)), ("m", m, (4, 17, 7)), ("small", v[:12], (5, 6, 20))):
        zarr_source.write_array(store, name, a, chunks)
    cfg = CorrelateConfig(window=6, mask_threshold=0.7)
    got = correlate_arrays(spark, (store, "r"), (store, "d"), (store, "m"), config=cfg).orderBy("poi").toPandas()
    want = correlate(voxels(spark, v), voxels(spark, d), shape, voxels(spark, m), config=cfg).orderBy("poi").toPandas()
    pd.testing.assert_frame_equal(got, want, check_exact=False, atol=1e-6)
    # Nothing is admitted in the lower half: chunks there that no window needs are never opened, whatever they hold.
    m[6:] = False
    zarr_source.write_array(store, "half", m, (4, 17, 7))
    half = correlate_arrays(spark, (store, "r"), (store, "d"), (store, "half"), config=cfg).orderBy("poi").toPandas()
    assert (half.status != 1).any()
    for path in (tmp_path / "v.zarr" / "r" / "c" / "2").rglob("*"):
        if path.is_file():
            path.write_bytes(b"broken")
    pd.testing.assert_frame_equal(correlate_arrays(spark, (store, "r"), (store, "d"), (store, "half"), config=cfg).orderBy("poi").toPandas(), half)
    with pytest.raises(ValueError, match="shape"):
        correlate_arrays(spark, (store, "r"), (store, "small"), config=cfg)
    with pytest.raises(Exception, match="outside"):
        correlate(voxels(spark, v[:12]), voxels(spark, d), (12, 17, 20), config=cfg).collect()


def test_fractional_shift_interior(spark):
    """A texture resampled at a fractional shift is measured to a tenth of a voxel away from the faces."""
    shape, shift = (40, 40, 40), (0.3, -0.7, 1.4)
    v = texture(shape, 17, 1.5)
    pad = v
    for axis, s in enumerate(shift):
        c = signal.coefficients(np.moveaxis(pad, axis, 0), 3)
        at = np.arange(40) - s
        first = np.floor(at).astype(int) - 1
        pad = np.moveaxis(sum(signal.spline_weight(at - (first + k), 3)[:, None, None] * c[signal.mirror(first + k, 40)] for k in range(4)), 0, axis)
    lat = Lattice(shape, 16, 0.5)
    f = correlate(voxels(spark, v), voxels(spark, pad), shape, config=CorrelateConfig(window=16))
    inside = L.interior(L.lattice_table(spark, lat), lat, 6).select("poi")
    got = f.join(inside, "poi").where("valid").toPandas()
    assert len(got) >= 8 and np.abs(got[["dz", "dy", "dx"]].mean() - shift).max() < 0.1


def scalar_outliers(d, valid, eps=2.0, floor=0.1, least=4):
    out = np.zeros(valid.shape, bool)
    for p in np.ndindex(valid.shape):
        near = [d[q] for o in robust.OFFSETS if all(0 <= a + b < n for a, b, n in zip(p, o, valid.shape)) and valid[q := tuple(a + b for a, b in zip(p, o))]]
        if valid[p] and len(near) >= least:
            n = np.array(near)
            med = np.median(n, 0)
            out[p] = (np.abs(d[p] - med) / (np.median(np.abs(n - med), 0) + floor)).max() > eps
    return out


def test_outliers_equal_a_scalar_loop(spark):
    rng = np.random.default_rng(0)
    d, valid = 0.1 * rng.standard_normal((5, 5, 5, 3)), np.ones((5, 5, 5), bool)
    for p in rng.integers(0, 5, (3, 3)):
        d[tuple(p)] += 5
    for p in rng.integers(0, 5, (5, 3)):
        valid[tuple(p)] = False
    rows = [(*p, *map(float, d[p]), bool(valid[p])) for p in np.ndindex(5, 5, 5)]
    t = spark.createDataFrame(rows, "iz int, iy int, ix int, dz double, dy double, dx double, valid boolean")
    got = robust.outliers(t).toPandas()
    flags = np.zeros((5, 5, 5), bool)
    flags[got.iz, got.iy, got.ix] = got.outlier
    assert (flags == scalar_outliers(d, valid)).all() and flags.any()


def test_scores(spark):
    rng = np.random.default_rng(1)
    e, conf, valid = rng.standard_normal((40, 3)), rng.integers(0, 5, 40).astype(float), rng.random(40) > 0.2
    rows = [(i, *map(float, e[i] + 1), 1.0, 1.0, 1.0, bool(valid[i]), float(conf[i]), 0 if valid[i] else 1) for i in range(40)]
    f = spark.createDataFrame(rows, "poi long, dz double, dy double, dx double, tz double, ty double, tx double, valid boolean, confidence double, status int")
    r, v = score.report(f).first(), e[valid]
    assert np.isclose(r.mae, np.abs(v).mean()) and np.isclose(r.rmse, np.sqrt((v**2).mean())) and np.isclose(r.p95, np.percentile(np.linalg.norm(v, axis=1), 95))
    rho = score.spearman(score.errors(f.where("valid")), "confidence", "norm").first().rho
    ranks = [pd.Series(x).rank().to_numpy() for x in (conf[valid], np.linalg.norm(v, axis=1))]
    assert np.isclose(rho, np.corrcoef(*ranks)[0, 1])
    none = score.report(f.withColumn("valid", F.lit(False))).first()
    assert none.n_valid == 0 and none.mae is None
    assert score.spearman(f.withColumn("confidence", F.lit(1.0)), "confidence", "dz").first().rho is None
    assert score.status_counts(f).first().asDict()["n_low_conf"] == 0
    for edges in ((0.0, 1.0, 2.0), (0.5, 1.0), (0.0,), (0.5,)):
        d = np.array([0, 0.5, 0.7, 1.0, 1.5, 2.0, 9.0])
        got = spark.createDataFrame([(float(x),) for x in d], "d double").select(score.bucket(F.col("d"), edges).alias("b")).toPandas().b
        want = []
        for x in d:
            k = [i for i in range(len(edges)) if ((x >= edges[0] if edges[0] == 0 else x > edges[0]) if i == 0 else x > edges[i]) and (i == len(edges) - 1 or x <= edges[i + 1])]
            want.append(k[0] if k else np.nan)
        assert np.array_equal(got.astype(float), want, equal_nan=True)


def test_distances(spark):
    m = np.random.default_rng(4).random((9, 12, 10)) > 0.97
    true = np.argwhere(m)
    want = np.sqrt(((np.indices(m.shape).reshape(3, -1).T[:, None] - true) ** 2).sum(2)).min(1).reshape(m.shape)
    assert np.allclose(array(signal.distance_volume(voxels(spark, m), m.shape), m.shape), want)
    lat = Lattice(m.shape, 3, 0.0)
    got = score.distance_to(L.lattice_table(spark, lat), voxels(spark, m), m.shape).toPandas()
    assert np.allclose(got.distance, want[got.cz, got.cy, got.cx])


def test_histogram_median(spark):
    v = np.random.default_rng(6).random((6, 7, 8))
    t = voxels(spark, v).withColumn("volume_id", F.lit("a"))
    got = profile.histogram_median(t, 256).first().median
    assert abs(got - np.median(v)) <= (v.max() - v.min()) / 256
    counts, edges = np.histogram(v, 256)
    i = int(np.argmax(np.cumsum(counts) >= v.size / 2))
    before = counts[:i].sum()
    assert np.isclose(got, edges[i] + (v.size / 2 - before) / counts[i] * (edges[1] - edges[0]))
    with pytest.raises(ValueError):
        profile.histogram_median(t, 1)


def test_splines_interpolate(spark):
    v = np.random.default_rng(8).random((7, 6, 9))
    at = [(0.0, 0.0, 0.0), (3.0, 2.0, 5.0), (2.4, 1.7, 6.1), (6.9, 5.9, 8.9)]
    p = spark.createDataFrame([(i, *a) for i, a in enumerate(at)], "poi long, pz double, py double, px double")
    for order in (0, 1, 2, 3, 5):
        got = signal.sample(p, signal.spline_table(voxels(spark, v), v.shape, order), v.shape, order).orderBy("poi").toPandas()["value"]
        c = v
        for axis in range(3):
            c = np.moveaxis(signal.coefficients(np.moveaxis(c, axis, 0), order), 0, axis)
        for g, a in zip(got, at):
            want = 0.0
            for q in itertools.product(*[range(-4, n + 4) for n in v.shape]):
                w = np.prod([signal.spline_weight(np.array(x - i), order) for x, i in zip(a, q)])
                if w:
                    want += w * c[tuple(signal.mirror(np.array(i), n) for i, n in zip(q, v.shape))]
            assert np.isclose(g, want)
        assert np.isclose(got[0], v[0, 0, 0]) and np.isclose(got[1], v[3, 2, 5])


def plain_sample(v, at, order):
    """The spline at points by loops over its taps."""
    c = v
    for axis in range(3):
        c = np.moveaxis(signal.coefficients(np.moveaxis(c, axis, 0), order), 0, axis)
    out = []
    for a in at:
        taps = [range(int(np.floor(x)) - 3, int(np.floor(x)) + 5) for x in a]
        out.append(sum(np.prod([float(signal.spline_weight(np.array(x - i), order)) for x, i in zip(a, q)]) * c[tuple(int(signal.mirror(np.array(i), n)) for i, n in zip(q, v.shape))] for q in itertools.product(*taps)))
    return out


@pytest.mark.parametrize("order", [1, 3, 4])
def test_sampling_across_cells(spark, monkeypatch, order):
    """Points in all cells and far beyond the faces, many in one place; small cells and groups in the test."""
    rng = np.random.default_rng(11)
    shape = (13, 9, 11)
    v = rng.random(shape)
    monkeypatch.setattr(signal, "CELL", 5)
    monkeypatch.setattr(signal, "GROUP", 7)
    at = [tuple(map(float, rng.uniform(-3, 16, 3))) for _ in range(40)] + [(2.25, 2.5, 2.75)] * 30 + [(-20.3, 40.1, 5.0)]
    rows = [(i, *a) for i, a in enumerate(at)] + [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0)]
    p = spark.createDataFrame(rows, "poi long, pz double, py double, px double")
    t = signal.spline_table(voxels(spark, v), shape, order)
    got = {r.poi: r for r in signal.sample_all(p, {"a": t, "b": t.withColumn("value", -F.col("value"))}, shape, order).collect()}
    assert len(got) == len(at) + 1 and np.isnan(got[901].a)
    want = plain_sample(v, at, order)
    assert np.allclose([got[i].a for i in range(len(at))], want, atol=1e-9) and np.allclose([got[i].b for i in range(len(at))], -np.array(want), atol=1e-9)


def test_warp_and_convention(spark):
    v = np.random.default_rng(9).random((8, 9, 10))
    t = voxels(spark, v)
    got = array(synth.warp(t, fields.rigid((1, -2, 0)), v.shape), v.shape)
    want = v[np.ix_(signal.mirror(np.arange(8) - 1, 8), signal.mirror(np.arange(9) + 2, 9), np.arange(10))]
    assert np.abs(got - want).max() < 1e-6
    flow = synth.voxel_grid(spark, v.shape).select("z", "y", "x", F.lit(1.0).alias("dz"), F.lit(-2.0).alias("dy"), F.lit(0.0).alias("dx"))
    assert profile.convention(t, fields.warp_integer(t, flow, v.shape), flow, v.shape).first().convention == "pull_back"
    assert profile.convention(t, fields.warp_integer(t, flow, v.shape, -1), flow, v.shape).first().convention == "push_forward"


def test_texture_and_phantom(spark):
    a = array(synth.texture(spark, (8, 12, 12), 1.5, 3), (8, 12, 12))
    b = array(synth.texture(spark, (8, 12, 12), 1.5, 3).repartition(7), (8, 12, 12))
    assert np.array_equal(a, b) and abs(a.mean()) < 1e-5 and abs(a.std() - 1) < 1e-5
    spec = phantom.bone((16, 32, 32), rod=3.0, hole=3.0)
    s = phantom.scaffold(synth.voxel_grid(spark, spec.shape).withColumn("strut", F.lit(True)), spec)
    assert {r.region for r in s.select("region").distinct().collect()} == {"implant", "cortical", "trabecular", "background"}
    r = array(synth.default_phantom(spark, (12, 40, 40), 1), (12, 40, 40))
    assert np.isfinite(r).all() and r.max() > 0.5
    with pytest.raises(ValueError):
        phantom.bone((8, 12, 12), wall=9.0)


def test_analytic_fields(spark):
    p = spark.createDataFrame([(2.0, 3.0, 5.0)], "z double, y double, x double")
    one = lambda f: list(fields.with_field(p, f).first()[3:])
    assert one(fields.dilation(0.5, (1, 1, 1))) == [0.5, 1.0, 2.0]
    assert one(fields.shear(2.0, "y", "z")) == [0.0, 4.0, 0.0]
    assert one(fields.compose(fields.rigid((1, 2, 3)), fields.shear(2.0, "y", "z"))) == [1.0, 6.0, 3.0]
    assert np.allclose(one(fields.sinusoid((1, 1, 1), (8, 12, 20))), [1, 1, 1])
    with pytest.raises(ValueError):
        fields.shear(1.0, "z", "z")


def test_units_and_budget(spark):
    a = units.VoxelSpacing(1000, 1000, 1000, "nm")
    assert units.unify([units.VoxelSpacing(1, 1, 1, "um"), a]).unit == "um"
    for bad in (lambda: units.unify([a, units.VoxelSpacing(1, 1, 1)]), lambda: units.VoxelSpacing(0, 1, 1), lambda: units.unify([a, units.VoxelSpacing(2, 1, 1, "um")])):
        with pytest.raises(ValueError):
            bad()
    assert budget.resident((960, 1280, 1280)) == 14_155_776_000
    assert 8 <= budget.largest_batch(48 << 30, (960, 1280, 1280), 96) <= 256
    assert budget.largest_batch(48 << 30, (960, 1280, 1280), 8, most=5) == 5
    with pytest.raises(RuntimeError):
        budget.largest_batch(1 << 30, (960, 1280, 1280), 96)
    with pytest.raises(ValueError):
        budget.footprint(8, "cyclic", "overlap")
    assert units.iso_cells(voxels(spark, np.arange(27.0).reshape(3, 3, 3)), 13.5).count() == 7


def test_thresholds_share_one_correlation(spark):
    v = texture((12, 16, 16), 3)
    m = np.random.default_rng(1).random(v.shape) > 0.3
    lat = Lattice(v.shape, 6, 0.5)
    loose = CorrelateConfig(window=6, mask_threshold=0.6)
    p = L.admit(L.lattice_table(spark, lat), voxels(spark, m), lat, 0.6)
    found = voxel_peaks(voxels(spark, v), voxels(spark, v), voxels(spark, m), None, p.where("admitted").select("poi"), lat, loose, 4).select("poi", "dz", "dy", "dx", "confidence")
    shared = at_thresholds(p, found, [0.6, 0.7], loose).toPandas()
    for t in (0.6, 0.7):
        own = correlate(voxels(spark, v), voxels(spark, v), v.shape, voxels(spark, m), config=CorrelateConfig(window=6, mask_threshold=t)).orderBy("poi").toPandas()
        got = shared[shared.mask_threshold == t].sort_values("poi").reset_index(drop=True)
        assert (got.status == own.status).all()


def test_taper_column_equals_numpy(spark):
    for n, a in ((1, 0.5), (8, 0.25), (9, 1.0)):
        assert np.allclose(taper.tukey_1d(spark, n, a).orderBy("i").toPandas().w, ncc_fft.taper(n, a))


def test_spline_recursion_against_dense_solution():
    """Coefficients put back through the spline give the samples; time grows with the length of a line."""
    rng = np.random.default_rng(3)
    for order in (2, 3, 4, 5):
        for n in (1, 2, 5, 256):
            lines = rng.standard_normal((n, 3))
            c = signal.coefficients(lines, order)
            r = order // 2
            back = sum(signal.spline_weight(np.array(float(o)), order) * c[signal.mirror(np.arange(n) + o, n)] for o in range(-r, r + 1))
            assert np.allclose(back, lines, atol=1e-9), (order, n)


def test_nearest_squares_against_all_pairs():
    rng = np.random.default_rng(4)
    for n, share in ((256, 0.02), (256, 0.2), (40, 0.0), (7, 1.0), (256, 0.001)):
        far = 4.0 * n * n
        lines = np.where(rng.random((n, 6)) < share, rng.integers(0, 50, (n, 6)).astype(float), far)
        i = np.arange(n)
        want = np.minimum(far, (lines[None] + ((i[:, None] - i) ** 2)[..., None]).min(1))
        got = signal.nearest_squares(lines)
        assert np.array_equal(np.minimum(far, got), want)


def test_distributed_ranks_and_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(0, 40, 500).astype(float), rng.standard_normal(300) * 1e6, [1e300, -1e300, 5e-324, 0.0]])
    t = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(v)), "v": v, "volume_id": np.where(np.arange(len(v)) % 3, "a", "b")}))
    ranks = score.average_rank(t, "v", "r").toPandas().sort_values("i").r.to_numpy()
    assert np.array_equal(ranks, pd.Series(v).rank().to_numpy())
    nulls = t.withColumn("v", F.when(F.col("i") % 10 == 0, None).otherwise(F.col("v")))
    got = score.average_rank(nulls, "v", "r").toPandas()
    want = pd.Series(np.where(got.i % 10 == 0, -np.inf, got.v)).rank()
    assert np.array_equal(got.r, want)
    for q in (0.0, 0.3, 0.5, 0.955, 1.0):
        for bins in (2, 7, 4096):
            found = profile.exact_quantile(t, q, value="v", bins=bins)
            for k in "ab":
                own = np.sort(t.where(F.col("volume_id") == k).toPandas().v.to_numpy())
                at = q * (len(own) - 1)
                a, b = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
                assert found[k] == a + (b - a) * (at - int(at))
    assert profile.exact_median(t.limit(0), value="v").count() == 0


def test_convention_of_a_fractional_flow(spark):
    shape = (10, 14, 14)
    ref = synth.texture(spark, shape, 1.5, 5)
    flow = fields.with_field(synth.voxel_grid(spark, shape), fields.rigid((0.3, -0.4, 0.2)))
    for name in ("pull_back", "push_forward"):
        moved = synth.warp(ref, fields.rigid((0.3, -0.4, 0.2)), shape, convention=name)
        got = profile.convention(ref, moved, flow, shape).first()
        assert got.convention == name and got.ratio > 5


@pytest.mark.parametrize(
    "settings,want",
    [
        ({}, 1 << 30),
        ({"spark.executor.memory": "20g", "spark.executor.cores": "4"}, 512 << 20),
        ({"spark.executor.memory": "1g"}, 384 << 20),
        ({"spark.executor.memory": "20g", "spark.executor.memoryOverhead": "800"}, 800 << 20),
        ({"spark.executor.memoryOverhead": "800m", "spark.executor.pyspark.memory": "64GB", "spark.executor.cores": "2"}, 1 << 30),
        ({"spark.executor.pyspark.memory": "2048kb", "spark.executor.cores": "2"}, 1 << 20),
    ],
)
def test_worker_memory_follows_the_session(settings, want):
    class Session:
        class sparkContext:
            @staticmethod
            def getConf():
                return settings

    assert budget.worker_memory(Session) == want
