"""Campaigns as few plans: the same results as one job after the other, faults by pair, as many Spark jobs for many variants as for few."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainlake.plans import campaign, together
from strainlake.sources import fieldstore, zarr_source as zarr

SHAPE = (8, 16, 16)


@pytest.fixture()
def store(tmp_path):
    rng = np.random.default_rng(3)
    path, v = str(tmp_path / "a.zarr"), rng.standard_normal(SHAPE).astype(np.float32)
    flow = np.zeros((3, *SHAPE), np.float32)
    flow[1] = 1
    zarr.write_array(path, "base/volume0", v, (4, 8, 16))
    zarr.write_array(path, "base/mask", rng.random(SHAPE) > 0.2, (8, 8, 8), "gzip")
    zarr.write_array(path, "iterations/016/volume1", np.roll(v, 1, 2), (8, 16, 8), None)
    zarr.write_array(path, "iterations/032/volume1", np.roll(v, -1, 0), (4, 8, 8), None)
    zarr.write_array(path, "synthetic/fs004/volume1", np.roll(v, 1, 1), (4, 16, 16))
    zarr.write_array(path, "synthetic/fs004/flow", flow, (3, 4, 8, 8))
    return path


def _spec(tmp_path, store, out, **more):
    raw = {"campaign": "c", "stores": [store], "out_dir": str(tmp_path / out), "defaults": {"window": 4, "flow_convention": "pull_back"}, "distance_bins": [0, 2]}
    return campaign.Spec.parse(raw | more)


def _jobs(spark, f):
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        f()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_same_results_as_one_by_one(spark, tmp_path, store):
    more = {"sweep": {"mask_threshold": [0.9, 0.5]}, "variants": [{"name": "nomask", "mask": "absent"}, {"name": "dry", "dry_shape": [4, 8, 8]}], "select": {"real": ["016"]}}
    a, b = (_spec(tmp_path, store, out, **more) for out in ("one", "all"))
    seen = []

    class Watch(campaign.Observer):
        def ended(self, job, row):
            seen.append((job.deformation, job.variant.name, row["status"]))

    keys = ["deformation", "variant_id"]
    want = campaign.run(spark, a).toPandas().sort_values(keys).reset_index(drop=True)
    got = together.run(spark, b, observer=Watch()).toPandas().sort_values(keys).reset_index(drop=True)
    assert got.status.tolist() == want.status.tolist() and (got.status == "ok").sum() == 6 and len(seen) == 8
    for c in got.columns.drop(["written_at", "error"]):
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c], equal_nan=True), c
        else:
            assert got[c].fillna("-").astype(str).tolist() == want[c].fillna("-").astype(str).tolist(), c
    fields = [fieldstore.load(spark, campaign.fields_path(s, store)).orderBy("pair_id", "variant_id", "poi").toPandas() for s in (a, b)]
    assert len(fields[0]) and fields[0][["pair_id", "variant_id", "poi", "dz", "dy", "dx", "valid", "status"]].equals(fields[1][["pair_id", "variant_id", "poi", "dz", "dy", "dx", "valid", "status"]])
    strata = [spark.read.parquet(f"{s.out}/strata").orderBy("deformation", "variant_id", "bin").toPandas() for s in (a, b)]
    assert np.allclose(strata[0][["bin", "edge", "n", "mae", "rmse"]].to_numpy(float), strata[1][["bin", "edge", "n", "mae", "rmse"]].to_numpy(float), equal_nan=True)
    row = got[(got.deformation == "fs004") & (got.status == "ok")].iloc[0]
    assert campaign.sidecar(spark, b, store, "fs004", row.variant_id)["summary"]["mae"] == pytest.approx(row.mae)
    assert [j.variant.name for j in campaign.plan(spark, b)] == ["nomask", "nomask"]
    # What is done is not run again; what failed is.
    again = together.run(spark, b)
    assert again.count() == 8 and campaign.results(spark, b).count() == 10


def test_a_broken_pair_leaves_the_others(spark, tmp_path, store):
    chunk = next(p for p in (tmp_path / "a.zarr" / "iterations" / "032" / "volume1").rglob("*") if p.is_file() and p.name != "zarr.json")
    chunk.write_bytes(b"broken")
    spec = _spec(tmp_path, store, "out", select={"synthetic": "none"}, sweep={"mask_threshold": [0.9, 0.5]})
    rows = together.run(spark, spec).toPandas()
    assert set(rows[rows.status == "ok"].deformation) == {"016"} and len(rows) == 4
    bad = rows[rows.deformation == "032"]
    assert set(bad.status) == {"failed"} and set(bad.phase) == {"correlate"} and bad.error.str.contains("032/volume1").all()
    assert fieldstore.load(spark, campaign.fields_path(spec, store)).select("pair_id").distinct().count() == 1


def test_variants_add_no_spark_jobs(spark, tmp_path, store):
    counts = {}
    for n, thresholds in ((1, [0.5]), (4, [0.5, 0.6, 0.7, 0.8])):
        spec = _spec(tmp_path, store, f"n{n}", sweep={"mask_threshold": thresholds}, distance_bins=[])
        counts[n] = _jobs(spark, lambda spec=spec: together.run(spark, spec))
        assert campaign.latest(spark, spec).where("status = 'ok'").count() == 3 * n
    assert 0 < counts[4] <= counts[1] + 3, counts
