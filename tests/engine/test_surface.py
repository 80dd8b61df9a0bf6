"""Surfaces: closed and turned outwards, of the right area, alike for all block edges; grids for viewers."""

import numpy as np
import pytest

from strainlake.functions import surface as S
from strainlake.functions.units import VoxelSpacing, structured_grid

SHAPE = (14, 13, 15)


def _frame(spark, values):
    rows = [(*map(int, i), float(x)) for i, x in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "z int, y int, x int, value double")


def _ball(radius, shape=SHAPE, centre=(6.6, 6.2, 7.1)):
    g = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1)
    return radius - np.sqrt(((g - centre) ** 2).sum(-1))


def test_tetrahedra_fill_a_cell():
    volumes = [np.linalg.det(np.diff(t, axis=0)) / 6 for t in S.tetrahedra()]
    assert np.abs(volumes).sum() == pytest.approx(1) and len(volumes) == 6
    for t in range(6):
        assert sorted(len(c) for c in S.cases(t).values()) == [1] * 8 + [2] * 6


@pytest.mark.parametrize("edge", [4, 16])
def test_a_ball_is_closed(spark, edge):
    from strainlake.functions.shipping import ship

    ship(spark)
    mesh = S.surface(_frame(spark, _ball(5.0)), SHAPE, 0.0, edge=edge).cache()
    e = S.edges(mesh).collect()
    assert e and all(r["along"] == r["against"] == 1 for r in e)
    m = S.measures(mesh).first()
    assert m["n_open"] == 0 and m["euler"] == 2
    assert m["area"] == pytest.approx(4 * np.pi * 25, rel=0.02)
    p = mesh.select(*[f"{v}{a}" for v in "abc" for a in "xyz"]).toPandas().to_numpy().reshape(-1, 3, 3)
    assert (p[:, 0] * np.cross(p[:, 1], p[:, 2])).sum() / 6 == pytest.approx(4 / 3 * np.pi * 125, rel=0.03)
    mesh.unpersist()


def test_block_edges_and_random_values_do_not_matter(spark):
    from strainlake.functions.shipping import ship

    ship(spark)
    v = np.random.default_rng(5).integers(0, 4, (6, 5, 7)).astype(float)
    v[2, 2, 2] = np.nan
    want_cells, want, _ = S.march(v, np.zeros(3, int), v.shape, 1.0)
    assert len(want) and not any((c <= 2).all() and (c >= 1).all() for c in want_cells)
    for edge in (2, 3, 8):
        got = S.surface(_frame(spark, v), v.shape, 1.0, edge=edge).select("a", "b", "c").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.tolist()))


def test_march_against_a_loop():
    """Each tetrahedron by itself: the corners of its triangles are the edges that the level cuts."""
    v = np.random.default_rng(6).normal(size=(4, 4, 4))
    cells, names, places = S.march(v, np.zeros(3, int), v.shape, 0.1)
    want = set()
    for low in np.ndindex(3, 3, 3):
        for t in S.tetrahedra():
            for i in range(4):
                for j in range(i + 1, 4):
                    a, b = np.array(low) + t[i], np.array(low) + t[j]
                    if (v[tuple(a)] > 0.1) != (v[tuple(b)] > 0.1):
                        want.add(int(((a[0] * 4 + a[1]) * 4 + a[2]) * 8 + (b - a) @ (4, 2, 1)))
    assert set(names.ravel().tolist()) == want
    for name, place in zip(names.reshape(-1), places.reshape(-1, 3), strict=True):
        low = np.array(np.unravel_index(name // 8, v.shape))
        step = np.array([name >> 2 & 1, name >> 1 & 1, name & 1])
        a, b = v[tuple(low)], v[tuple(low + step)]
        assert np.allclose(place, low + step * (0.1 - a) / (b - a))


def test_masks_spacing_and_nothing_to_show(spark):
    from strainlake.functions.shipping import ship

    ship(spark)
    v = _frame(spark, _ball(4.0) + 10)
    mask = v.select("z", "y", "x", (v.value > 9.0).alias("value"))
    one = S.measures(S.surface(v, SHAPE, 10.0, mask)).first()
    assert one["n_open"] == 0
    two = S.measures(S.surface(v, SHAPE, 10.0, mask, VoxelSpacing(2, 2, 2, "um"))).first()
    assert two["area"] == pytest.approx(4 * one["area"]) and two["n_triangles"] == one["n_triangles"]
    assert S.surface(v, SHAPE, 99.0).count() == 0 and S.measures(S.surface(v, SHAPE, 99.0)).count() == 0
    assert S.surface(v.where("z < 0"), SHAPE, 10.0).count() == 0


def test_frames_without_triangles_have_a_row_where_asked(spark):
    from strainlake.functions.shipping import ship

    ship(spark)
    v = _frame(spark, _ball(4.0) + 10)
    frames = spark.createDataFrame([("volume",), ("empty",), ("empty",)], "frame string")
    got = {r["frame"]: tuple(r)[1:] for r in S.measures(S.surface(v, SHAPE, 10.0), frames).collect()}
    assert len(got) == 2 and got["empty"] == (0, 0, 0, 0, 0, None)
    assert got["volume"] == tuple(S.measures(S.surface(v, SHAPE, 10.0)).first())[1:]


def test_structured_grid(spark):
    p = spark.createDataFrame([(0, 0, 0, 1, 2.0, 3.0, 5.0, 0.5)], "poi long, iz int, iy int, ix int, pz double, py double, px double, confidence double")
    assert tuple(structured_grid(p, VoxelSpacing(2, 3, 4, "um"), ("confidence",)).first()) == (0, 1, 0, 0, 20.0, 9.0, 4.0, 0.5)
