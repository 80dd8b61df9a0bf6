"""Stores, fields at rest, campaigns, the command line and frame series, on small stores written here."""

import json
import uuid

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from strainlake import cli
from strainlake.config import Lattice
from strainlake.operators import lattice as L, profile
from strainlake.plans import campaign
from strainlake.sources import fieldstore, zarr_source as zarr
from strainlake.sources.store import DISCOVER, Dataset, MalformedStore, Manifest, verify, default_profile
from strainlake.streaming import frames

SHAPE = (8, 16, 16)


def make_store(path, broken=False, flow_shape=None):
    rng = np.random.default_rng(0)
    v = rng.standard_normal(SHAPE).astype(np.float32)
    flow = np.zeros((3, *SHAPE), np.float32)
    flow[1] = 1
    zarr.write_array(path, "base/volume0", v, (4, 8, 16))
    zarr.write_array(path, "base/mask", rng.random(SHAPE) > 0.1, (8, 8, 8), "gzip")
    zarr.write_array(path, "iterations/016/volume1", np.roll(v, 1, 2), (8, 16, 8), None)
    zarr.write_array(path, "synthetic/fs004/volume1", np.roll(v, 1, 1), (4, 16, 16))
    zarr.write_array(path, "synthetic/fs004/flow", flow if flow_shape is None else np.zeros(flow_shape, np.float32), (3, 4, 8, 8) if flow_shape is None else None)
    if broken:
        zarr.write_array(path, "synthetic/fs104/volume1", v)
    return v, flow


@pytest.fixture()
def store(tmp_path):
    path = str(tmp_path / "a.zarr")
    return path, *make_store(path)


def array(t, shape, column="value"):
    p = t.toPandas()
    out = np.full(shape, np.nan)
    out[p.z, p.y, p.x] = p[column].astype(float)
    return out


def test_zarr_reads(spark, store):
    path, v, flow = store
    assert np.allclose(array(zarr.load_volume(spark, path, "base/volume0"), SHAPE), v)
    crop = (3, 8, 6)
    assert np.allclose(array(zarr.load_volume(spark, path, "base/volume0", crop), crop), v[2:5, 4:12, 5:11])
    f = zarr.load_flow(spark, path, "synthetic/fs004/flow", convention="push_forward")
    assert np.allclose(array(f, SHAPE, "dy"), -flow[1]) and f.columns == ["z", "y", "x", "dz", "dy", "dx"]
    b = zarr.load(spark, path, "base/volume0", form="blocks").collect()
    assert sum(len(r.data) for r in b) == v.nbytes and len(b) == 4
    with pytest.raises(FileNotFoundError):
        zarr.open_array(path, "base/none")
    with pytest.raises(TypeError):
        zarr.open_array(path, "base")


def test_zarr_version_2(spark, tmp_path):
    import zlib

    v = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    top = tmp_path / "old.zarr" / "a"
    top.mkdir(parents=True)
    (top / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 3, 4], "chunks": [2, 3, 4], "dtype": "<u2", "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "order": "C", "filters": None}))
    (top / "0.0.0").write_bytes(zlib.compress(v.tobytes()))
    assert np.allclose(array(zarr.load_volume(spark, str(tmp_path / "old.zarr"), "a"), v.shape), v)


def test_dataset(spark, tmp_path, store):
    path, v, _ = store
    ds = Dataset.open(spark, path)
    assert (ds.list_real(), ds.list_synthetic(), ds.list_masks(), ds.list_broken()) == (["016"], ["fs004"], ["mask"], [])
    pair = ds.load_pair("fs004")
    assert pair.kind == "synthetic" and pair.flow is not None and pair.mask.count() == v.size
    assert ds.load_pair("016", mask="none").mask is None and ds.load_pair("016").flow is None
    with pytest.raises(KeyError):
        ds.load_pair("nothing")
    with pytest.raises(ValueError):
        ds.load_flow("016")
    assert ds.catalog().count() == 5
    other = str(tmp_path / "b.zarr")
    make_store(other, broken=True)
    with pytest.raises(MalformedStore):
        Dataset.open(spark, other)
    half = Dataset.open(spark, other, strict=False)
    assert half.broken == {"fs104": ["flow"]}
    with pytest.raises(ValueError):
        half.load_pair("fs104")
    with pytest.raises(FileNotFoundError):
        Dataset.open(spark, str(tmp_path / "none.zarr"))


def test_verify_errors(tmp_path, store):
    p = default_profile()
    assert verify(store[0], p).ok
    wrong = str(tmp_path / "w.zarr")
    make_store(wrong, flow_shape=(*SHAPE, 3))
    assert any("leading" in e for e in verify(wrong, p).errors)
    assert verify(wrong, p, Manifest(axis_order="zyx_3")).ok
    assert any("listed" in e for e in verify(store[0], p, Manifest(synthetic=("absent",))).errors)
    zarr.write_array(wrong, "base/other", np.zeros(SHAPE, np.float32))
    assert any("expected bool" in e for e in verify(wrong, p, Manifest(axis_order="zyx_3")).errors)
    assert not verify(str(tmp_path / "empty"), p).ok


def test_manifest(tmp_path, store):
    m = Manifest(default_mask="mask", iterations=("016",), convention="push_forward")
    m.to_yaml(f"{store[0]}.yaml")
    assert Manifest.discover(store[0]) == m and Manifest.parse({}).masks == DISCOVER
    for bad in ({"dvc_store_version": 2}, {"base": {"masks": 3}}, {"synthetic": {"flow": {"axis_order": "xyz"}}}, {"spacing": {"values": [1, 2]}}):
        with pytest.raises(ValueError):
            Manifest.parse(bad)


def test_variants():
    v = campaign.variants({"window": 32}, {"mask_threshold": [0.7, 0.9], "overlap": [0.5]}, [{"name": "again", "mask_threshold": 0.7}, {"name": "own", "window": [16, 16, 8]}])
    assert [x.name for x in v] == ["mt0.7", "base", "own"]
    assert len({x.params_hash for x in v}) == 3 and v[2].params["window"] == (16, 16, 8)
    assert campaign.params_hash(v[0].params) == v[0].params_hash
    assert [campaign.slug(x) for x in (None, True, 5.0, 0.5, (1, 2, 3), "a")] == ["none", "true", "5", "0.5", "1x2x3", "a"]
    for bad in ({"x": 1}, {"campaign": "c"}, {"campaign": "c", "stores": ["a"], "defaults": {"windw": 3}}, {"campaign": "c", "stores": ["a"], "sweep": {"window": []}}, {"campaign": "c", "stores": ["a"], "select": {"real": 3}}):
        with pytest.raises(ValueError):
            campaign.Spec.parse(bad)
    assert [x.name for x in campaign.Spec.parse({"campaign": "c", "stores": ["a"]}).variants] == ["base"]


def test_campaign_runs_resumes_and_isolates(spark, tmp_path, store):
    raw = {"campaign": "c", "stores": [store[0], str(tmp_path / "absent.zarr")], "out_dir": str(tmp_path / "out"), "defaults": {"window": 4, "flow_convention": "pull_back"}, "sweep": {"mask_threshold": [0.9, 0.5]}, "variants": [{"name": "nomask", "mask": "absent"}], "distance_bins": [0, 2]}
    spec = campaign.Spec.parse(raw)
    rows = campaign.run(spark, spec).toPandas()
    ok = rows[rows.status == "ok"]
    assert len(ok) == 4, rows.error.tolist()
    assert set(ok.deformation) == {"016", "fs004"}
    assert (ok[ok.deformation == "fs004"].mae < 1.5).all() and ok[ok.deformation == "016"].mae.isna().all()
    assert set(rows[rows.status == "failed"].phase) == {"open_store", "load_pair"}
    only = campaign.Spec(**{**spec.__dict__, "stores": (store[0],)})
    assert [j.variant.name for j in campaign.plan(spark, only)] == ["nomask", "nomask"]
    assert len(campaign.plan(spark, only, force=True)) == 6
    assert len(campaign.plan(spark, only, force=True, only={"mask_threshold": "0.5"})) == 2
    f = fieldstore.load(spark, campaign.fields_path(spec, store[0]), "fs004")
    assert {r.variant_id.split("-")[0] for r in f.select("variant_id").distinct().collect()} == {"base", "mt0.5"}
    lat = Lattice(SHAPE, 4, 0.5)
    one = fieldstore.load(spark, campaign.fields_path(spec, store[0]), "fs004", ok[ok.deformation == "fs004"].variant_id.iloc[0]).drop("variant_id")
    fieldstore.save_npz(one, lat, str(tmp_path / "f.npz"))
    back = fieldstore.load_npz(spark, str(tmp_path / "f.npz"), "fs004")
    assert back.orderBy("poi").toPandas()[["iz", "dz", "status"]].equals(one.orderBy("poi").toPandas()[["iz", "dz", "status"]])


def test_cli(spark, tmp_path, store, capsys):
    assert cli.main(["inspect", store[0], "--json", "--verbose"]) == 0
    assert json.loads(capsys.readouterr().out)["synthetic"] == ["fs004"]
    assert cli.main(["inspect", str(tmp_path / "no.zarr")]) == 2
    make_store(str(tmp_path / "b.zarr"), broken=True)
    assert cli.main(["inspect", str(tmp_path / "b.zarr")]) == 1
    capsys.readouterr()
    assert cli.main(["budget", "--shape", "960", "1280", "1280", "--window", "96", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["batch"] == 64
    assert cli.main(["budget", "--shape", "960", "1280", "1280", "--free-gib", "1"]) == 1
    spec = tmp_path / "s.yaml"
    spec.write_text(yaml.safe_dump({"campaign": "d", "stores": [store[0]], "out_dir": str(tmp_path), "defaults": {"window": 4}}))
    capsys.readouterr()
    assert cli.main(["run", str(spec), "--dry-run"]) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["run", str(tmp_path / "none.yaml")]) == 2


def test_one_pair_from_end_to_end(spark, tmp_path, store, capsys):
    out = str(tmp_path / "field")
    capsys.readouterr()
    assert cli.main(["pair", store[0], "fs004", "--window", "4", "--threshold", "0.5", "--out", out, "--json"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert list(told["phases"]) == ["open", "correlate", "report", "evaluate"] and told["errors"]["mae"] < 0.5
    assert fieldstore.load(spark, out, "fs004").count() == told["counts"]["n_total"] > 0
    assert cli.main(["pair", store[0], "016", "--window", "4", "--threshold", "0.5"]) == 0
    assert "errors" not in capsys.readouterr().out
    assert cli.main(["pair", store[0], "none"]) == 2
    assert cli.main(["pair", store[0], "fs004", "--window", "64"]) == 2


def test_frame_stream(spark, tmp_path):
    got = []
    for n, times in enumerate(([2, 0], [1, 3])):
        spark.createDataFrame([("s", t, f"f{t}") for t in times], frames.FRAME).write.mode("append").parquet(str(tmp_path / "in"))
        q = frames.stream(spark, str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "seen"), lambda df, e: got.extend((r.reference, r.deformed) for r in df.collect()), "sequential")
        q.awaitTermination(120)
    assert set(got) == {("f0", "f2"), ("f0", "f1"), ("f2", "f3")}
    t = spark.createDataFrame([("s", i, f"f{i}") for i in range(3)], frames.FRAME)
    assert {(r.reference, r.deformed) for r in frames.pairs(t).collect()} == {("f0", "f1"), ("f0", "f2")}
    with pytest.raises(ValueError):
        frames.pairs(t.where(F.lit(True)), "other")


def test_truth_and_distances_are_made_once(spark, tmp_path, store, monkeypatch):
    """Five variants on two grids: one set of splines, a truth for each grid, one distance transform; nothing is left over."""
    work = tmp_path / "work"
    monkeypatch.setattr(campaign, "shared_folder", lambda s, name: f"{work}/strainlake/{name}-{uuid.uuid4().hex}")
    calls = {"splines": 0, "samples": 0, "distances": 0}

    def counted(name, f):
        def g(*a, **k):
            calls[name] += 1
            return f(*a, **k)

        return g

    monkeypatch.setattr(campaign, "flow_tables", counted("splines", campaign.flow_tables))
    monkeypatch.setattr(campaign, "sample_flow", counted("samples", campaign.sample_flow))
    monkeypatch.setattr(campaign, "distance_volume", counted("distances", campaign.distance_volume))
    raw = {"campaign": "s", "stores": [store[0]], "out_dir": str(tmp_path / "out"), "select": {"real": "none"}, "defaults": {"window": 4, "flow_convention": "pull_back"}, "sweep": {"mask_threshold": [0.9, 0.5]}, "variants": [{"window": 8}, {"window": 8, "mask_threshold": 0.6}, {"search_radius": 1}], "distance_bins": [0, 2]}
    spec = campaign.Spec.parse(raw)
    rows = campaign.run(spark, spec).toPandas()
    assert (rows.status == "ok").all() and len(rows) == 5, rows.error.tolist()
    assert calls == {"splines": 1, "samples": 2, "distances": 1}
    assert not list(work.glob("strainlake/campaign-*"))
    side = campaign.sidecar(spark, spec, store[0], "fs004", rows.variant_id[0])
    assert side["scored"] and side["summary"]["mae"] == rows.mae[0] and side["provenance"]["spark"] == spark.version
    assert side["params"]["window"] in (4, 8) and side["params_hash"] == rows.params_hash[0]
    assert spark.read.parquet(f"{spec.out}/variants").count() == 5
    assert json.loads(spark.read.text(f"{spec.out}/config").first()[0])["campaign"] == "s"
    assert campaign.jsonable({"a": (1, float("nan")), 2: float("inf")}) == {"a": [1, None], "2": None}


def test_own_kernel_and_reader_and_warnings(spark, tmp_path, store):
    seen = []

    def opened(s, path, manifest, strict):
        seen.append(path)
        return Dataset.open(s, store[0], manifest, strict)

    def constant(s, pair, variants):
        lat = Lattice(pair.shape, 4, 0.5)
        t = L.lattice_table(s, lat).select(F.lit(pair.name).alias("pair_id"), "poi", "iz", "iy", "ix", "pz", "py", "px", *[F.lit(0.0).cast("float").alias(f"d{a}") for a in "zyx"], F.lit(True).alias("valid"), F.lit(1.0).cast("float").alias("confidence"), F.lit(0).cast("tinyint").alias("status"))
        return {v.variant_id: t for v in variants}

    spec = campaign.Spec.parse({"campaign": "k", "stores": ["elsewhere"], "out_dir": str(tmp_path / "out"), "select": {"real": "none"}, "defaults": {"window": 4}})
    with pytest.warns(UserWarning, match="no flow convention"):
        rows = campaign.run(spark, spec, open_dataset=opened, fields_of=constant).toPandas()
    assert seen == ["elsewhere"] and rows.status.tolist() == ["ok"] and rows.n_ok[0] == rows.n_total[0]
    with pytest.warns(UserWarning, match="no store of the campaign"):
        campaign.run(spark, spec, stores=["other"], open_dataset=opened)


def test_profile_of_a_dataset(spark, tmp_path, store):
    ds = Dataset.open(spark, store[0])
    steps = []
    p = profile.dataset(ds, median="exact", progress=steps.append)
    assert [(x.stage, x.name) for x in steps] == [("reference", "reference"), *[("mask", m) for m in ds.list_masks()], *[x for e in ds.list_all() for x in (("deformed", e), ("flow", e))[: 1 + (ds.entries[e] == "synthetic")]], ("done", "")]
    assert [x.index for x in steps] == list(range(len(steps))) and {x.total for x in steps} == {len(steps) - 1}
    v = {(r.role, r.name): r for r in p.volumes.collect()}
    ref = ds.load_reference().toPandas()["value"].to_numpy(np.float64)
    own = v["reference", "reference"]
    assert (own.n, own.min, own.max) == (ref.size, ref.min(), ref.max()) and abs(own.mean - ref.mean()) < 1e-9 and own.median == np.median(ref)
    flow = ds.load_flow("fs004").toPandas()[["dz", "dy", "dx"]].to_numpy(np.float64)
    u = np.sqrt((flow**2).sum(1))
    f = p.flows.first()
    assert f.name == "fs004" and abs(f.median_u - np.median(u)) < 1e-12 and abs(f.mean_u - u.mean()) < 1e-12
    assert {r.name for r in p.masks.collect()} == set(ds.list_masks())
    some = profile.dataset(ds, include=["016"], masks=[], median="skip")
    assert some.masks.count() == some.flows.count() == 0 and {r.median for r in some.volumes.collect()} == {None}
    rough = {r.name: r.median for r in profile.dataset(ds, include=[], masks=[]).volumes.collect()}
    assert abs(rough["reference"] - np.median(ref)) < (ref.max() - ref.min()) / 1000
    for bad, error in (({"include": ["nope"]}, KeyError), ({"masks": ["nope"]}, KeyError), ({"bins": 1}, ValueError), ({"median": "mode"}, ValueError)):
        with pytest.raises(error):
            profile.dataset(ds, **bad)
    wrong = str(tmp_path / "wrong.zarr")
    make_store(wrong, flow_shape=(*SHAPE, 3))
    told = []
    with pytest.raises(ValueError, match="does not fit"):
        profile.dataset(Dataset.open(spark, wrong, strict=False), progress=told.append)
    assert not told


def test_zone_map_equals_its_voxels(spark, tmp_path, store):
    from strainlake.sources import zones

    path, v, flow = store
    arrays = [zones.Array("v", "base/volume0"), zones.Array("m", "base/mask"), zones.Array("f", "synthetic/fs004/flow", convention="push_forward")]
    of = zones.build(spark, path, arrays, str(tmp_path / "zones"))
    assert of.where("name = 'v'").count() == 4 and of.where("name = 'f'").count() == 8
    of = zones.build(spark, path, arrays[:1], str(tmp_path / "zones"))  # again: its own rows alone are replaced
    s = {r["name"]: r for r in zones.summary(of).collect()}
    assert s["v"].n == v.size and abs(s["v"].mean - v.astype(float).mean()) < 1e-9 and (s["v"].min, s["v"].max) == (v.min(), v.max())
    assert s["f"].mean == s["f"].max == 1 and s["f"].mean_y == -1 and s["f"].max_y == 1 and s["f"].mean_x == 0
    want = profile.histogram_median(zarr.load_volume(spark, path, "base/volume0").withColumn("volume_id", F.lit("v")), 64).first()["median"]
    got = {r["name"]: r["median"] for r in zones.median(spark, path, arrays, of, 64).collect()}
    assert np.isclose(got["v"], want) and got["f"] == 1
    # Chunks of one value are counted from the map: broken ones do no harm.
    flat = np.repeat(np.array([0, 5, 5, 9], np.float32), 16).reshape(4, 4, 4)
    zarr.write_array(path, "flat", flat, (1, 4, 4))
    a = [zones.Array("flat", "flat")]
    of = zones.build(spark, path, a, str(tmp_path / "flat"))
    for f in (tmp_path / "a.zarr" / "flat" / "c").rglob("*"):
        if f.is_file():
            f.write_bytes(b"broken")
    assert abs(zones.median(spark, path, a, of, 100).first()["median"] - 5) < 0.1


def test_one_pair_with_a_kernel_of_its_own(spark, store):
    from strainlake.config import CorrelateConfig
    from strainlake.plans.correlate import correlate_pair, run_and_evaluate

    ds, config = Dataset.open(spark, store[0]), CorrelateConfig(window=4, mask_threshold=0.5)
    pair = ds.load_pair("fs004")
    f, report = run_and_evaluate(pair, config)
    assert report.first().n_total == f.count()
    exact = lambda p, c: correlate_pair(p, c).withColumns({"dz": F.lit(0.0), "dy": F.lit(1.0), "dx": F.lit(0.0), "valid": F.lit(True)})
    r = run_and_evaluate(pair, config, exact)[1].first()
    assert r.n_valid == f.count() and r.mae < 1e-6
    with pytest.raises(ValueError, match="no flow"):
        run_and_evaluate(ds.load_pair("016"), config)


def test_catalog_checks_say_what_verify_says(spark, tmp_path, store):
    from strainlake.sources.store import check_catalog

    wrong = str(tmp_path / "w.zarr")
    make_store(wrong, flow_shape=(*SHAPE, 3))
    dtypes = dict(default_profile().dtypes)
    size = F.array(*[F.lit(int(n)) for n in SHAPE])
    of = lambda s: {(r.role, r.error) for r in check_catalog(Dataset.open(spark, s, strict=False).catalog(), size, dtypes, "3_zyx").collect()}
    assert of(store[0]) == set()
    assert [x[0] for x in of(wrong)] == ["flow"] and "vector axis 0 must be 3" in next(iter(of(wrong)))[1]


def test_volumes_written_by_executors(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((5, 9, 7)).astype(np.float32)
    z, y, x = (i.ravel() for i in np.indices(a.shape))
    t = spark.createDataFrame([(int(i), int(j), int(k), float(v)) for i, j, k, v in zip(z, y, x, a.ravel()) if k < 4], "z int, y int, x int, value float")
    for path in (str(tmp_path / "plain.zarr"), f"file://{tmp_path}/uri.zarr"):
        assert zarr.write_volume(t, path, "base/v", a.shape, (2, 4, 4)) == 9
        back = zarr.load_volume(spark, path, "base/v").toPandas().sort_values(["z", "y", "x"])["value"].to_numpy().reshape(a.shape)
        assert np.array_equal(back[..., :4], a[..., :4]) and not back[..., 4:].any()
