"""Points of very full cells are split before they meet, and get the same values."""

import numpy as np
import pytest

from strainlake.functions import signal
from strainlake.functions.shipping import ship


def test_full_cells_are_split_without_a_task_for_a_cell(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(3)
    shape = (9, 10, 70)
    values = rng.normal(size=shape)
    voxels = spark.createDataFrame([(*map(int, i), float(x)) for i, x in np.ndenumerate(values)], "z int, y int, x int, value double")
    p = np.concatenate([rng.uniform(0, 8, (400, 3)), rng.uniform(0, 8, (30, 3)) + (0, 0, 61)])  # a full cell, and one that is not
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "poi long, pz double, py double, px double")
    want = {r["poi"]: r["value"] for r in signal.sample(points, voxels, shape, 1).collect()}
    monkeypatch.setattr(signal, "GROUP", 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = signal.sample(points, voxels, shape, 1)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert {r["poi"]: r["value"] for r in got.collect()} == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(want) == 430
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1  # slices by cell; points by broadcast
