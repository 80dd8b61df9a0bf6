"""Surfaces at a level of volumes, as triangles: marching tetrahedra over blocks, closed across their faces.

Each cell of eight voxels is cut into the six tetrahedra along its diagonal from low to high, which meet those of the
next cell face to face. A corner of a triangle lies on an edge between two voxels and is named by it, so triangles of
different blocks share corners without a search. Each block needs one plane of the blocks above it; blocks that lie
wholly on one side of the level, those planes included, are sent nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strainlake.functions.shipping import stored
from strainlake.functions.units import VoxelSpacing
from strainlake.operators.blocks import ORIGIN, box_of

PLACES = [f"{v}{a}" for v in "abc" for a in "zyx"]
TRIANGLES = "frame string, z int, y int, x int, a long, b long, c long, " + ", ".join(f"{p} double" for p in PLACES)
CELL = ("bz", "by", "bx")


def tetrahedra() -> list[np.ndarray]:
    """The corners (z, y, x offsets) of a cell's tetrahedra: from low to high, one axis after the other."""
    return [np.cumsum([np.zeros(3, int), *np.eye(3, dtype=int)[list(p)]], axis=0) for p in permutations(range(3))]


@cache
def cases(t: int) -> dict[int, list[list[tuple[int, int]]]]:
    """For tetrahedron t: corners above the level (as bits) -> triangles of (corner above, corner not above), turned
    so that normals in x, y, z point to where values fall."""
    corner = tetrahedra()[t]
    out = {}
    for above in range(1, 15):
        up, down = [i for i in range(4) if above >> i & 1], [i for i in range(4) if not above >> i & 1]
        ring = list(product(up, down))
        if len(ring) == 4:
            ring[2], ring[3] = ring[3], ring[2]
        out[above] = []
        for tri in [ring] if len(ring) == 3 else [ring[:3], [ring[0], *ring[2:]]]:
            p = [(corner[i] + corner[j])[::-1] / 2 for i, j in tri]
            falls = (corner[down].mean(0) - corner[up].mean(0))[::-1]
            right = np.dot(np.cross(p[1] - p[0], p[2] - p[0]), falls) > 0
            out[above].append(tri if right else [tri[0], tri[2], tri[1]])
    return out


def march(v: np.ndarray, origin: tuple[int, int, int], shape: tuple[int, int, int], level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, corner names and corner places of the triangles among all cells of v, which lies at origin within shape."""
    cells, names, places = [np.empty((0, 3), int)], [np.empty((0, 3), np.int64)], [np.empty((0, 3, 3))]
    if min(v.shape) > 1:
        n = [s - 1 for s in v.shape]
        at = lambda o: v[tuple(slice(k, k + m) for k, m in zip(o, n, strict=True))]
        eight = [at(o) for o in product((0, 1), repeat=3)]
        mixed = np.any([e > level for e in eight], 0) & ~np.all([e > level for e in eight], 0) & np.all([np.isfinite(e) for e in eight], 0)
        first = np.argwhere(mixed)
        for t, corner in enumerate(tetrahedra()):
            value = np.stack([v[tuple((first + o).T)] for o in corner], 1).astype(float)
            code = ((value > level) << np.arange(4)).sum(1)
            for above, triangles in cases(t).items():
                here = code == above
                if not here.any():
                    continue
                base, val = first[here], value[here]
                for tri in triangles:
                    name, place = [], []
                    for i, j in (sorted(e) for e in tri):
                        share = (level - val[:, i]) / (val[:, j] - val[:, i])
                        low = base + corner[i] + origin
                        step = corner[j] - corner[i]
                        name.append(((low[:, 0] * shape[1] + low[:, 1]) * shape[2] + low[:, 2]) * 8 + step @ (4, 2, 1))
                        place.append(low + share[:, None] * step)
                    cells.append(base + origin)
                    names.append(np.stack(name, 1))
                    places.append(np.stack(place, 1))
    return np.concatenate(cells), np.concatenate(names), np.concatenate(places)


def triangles(blocks: DataFrame, shape: tuple[int, int, int], chunks: tuple[int, int, int], level: float, spacing: VoxelSpacing | None = None) -> DataFrame:
    """The triangles of each frame's surface at level: its cell, the names of its corners, and their places.

    blocks: operators.blocks.BLOCK rows on a grid of `chunks`; what they hold beyond shape is left out. Values above the
    level lie within; cells with a value that is not finite have no triangles. Corners on a voxel that equals the level
    coincide there under several names, so that the surface stays closed; it is open where it meets the volume's faces.
    """
    size = dict(zip("zyx", chunks, strict=True))
    ends = [F.least(F.col(f"n{a}"), F.lit(s) - F.col(f"{a}0")).alias(f"n{a}") for a, s in zip("zyx", shape, strict=True)]

    def parts(batches: Iterator[pa.RecordBatch], data: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                box = box_of(row)[tuple(slice(0, row[f"k{a}"]) for a in "zyx")]
                first = [row[o] // c for o, c in zip(ORIGIN, chunks, strict=True)]
                for g in product((0, 1), repeat=3):
                    to = [f - k for f, k in zip(first, g, strict=True)]
                    if min(to) < 0:
                        continue
                    cut = box[tuple(slice(0, 1) if k else slice(None) for k in g)]
                    if data:
                        out.append((row["frame"], *to, *g, *cut.shape, np.ascontiguousarray(cut, "<f8").tobytes()))
                    else:
                        up = cut > level
                        out.append((row["frame"], *to, bool(up.any()), bool((~up).any())))
            ints = 9 if data else 3
            kinds = [pa.string(), *[pa.int32()] * ints, *([pa.binary()] if data else [pa.bool_()] * 2)]
            names = ["frame", *CELL, *(["gz", "gy", "gx", "nz", "ny", "nx", "data"] if data else ["up", "down"])]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(key, t):
        frame, *b = (k.as_py() for k in key)
        full = np.full([c + 1 for c in chunks], np.nan)
        for i in range(len(t)):
            row = t.slice(i, 1).to_pylist()[0]
            o = [row[f"g{a}"] * size[a] for a in "zyx"]
            n = [row[f"n{a}"] for a in "zyx"]
            full[tuple(slice(p, p + k) for p, k in zip(o, n, strict=True))] = np.frombuffer(row["data"]).reshape(n)
        origin = np.array(b) * chunks
        cells, names, places = march(full, origin, shape, level)
        scale = np.array([spacing.z, spacing.y, spacing.x]) if spacing else np.ones(3)
        places = (places * scale).reshape(-1, 9)
        cols = [pa.array([frame] * len(cells), pa.string()), *[pa.array(cells[:, i].astype(np.int32)) for i in range(3)], *[pa.array(names[:, i]) for i in range(3)], *[pa.array(places[:, i]) for i in range(9)]]
        return pa.table(cols, names=[x.split()[0] for x in TRIANGLES.split(", ")])

    at = ", ".join(f"{c} int" for c in CELL)
    ready = blocks.select("frame", *ORIGIN, "nz", "ny", "nx", "dtype", "data", *[e.alias(f"k{a}") for e, a in zip(ends, "zyx", strict=True)])
    sides = ready.mapInArrow(lambda b: parts(b, False), f"frame string, {at}, up boolean, down boolean")
    both = sides.groupBy("frame", *CELL).agg(F.bool_or("up").alias("up"), F.bool_or("down").alias("down")).where("up and down").drop("up", "down")
    cut = ready.mapInArrow(lambda b: parts(b, True), f"frame string, {at}, gz int, gy int, gx int, nz int, ny int, nx int, data binary")
    return cut.join(both, ["frame", *CELL], "left_semi").groupBy("frame", *CELL).applyInArrow(run, TRIANGLES)


def area() -> Column:
    """The area of a triangle, from its corners' places."""
    u, w = ([F.col(f"{v}{a}") - F.col(f"a{a}") for a in "zyx"] for v in "bc")
    n = [u[i] * w[j] - u[j] * w[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2


def corners(mesh: DataFrame) -> DataFrame:
    """frame, corner and its place z, y, x: each corner of the triangles once."""
    each = F.explode(F.array(*[F.struct(F.col(v).alias("corner"), *[F.col(f"{v}{a}").alias(a) for a in "zyx"]) for v in "abc"]))
    t = mesh.select("frame", each.alias("v")).select("frame", "v.*")
    return t.groupBy("frame", "corner").agg(*[F.first(a).alias(a) for a in "zyx"])


def edges(mesh: DataFrame) -> DataFrame:
    """frame, low, high (corners), and how many triangles run along the edge from low to high (along) and back (against)."""
    each = F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca")]))
    t = mesh.select("frame", each.alias("e")).select("frame", F.least("e.p", "e.q").alias("low"), F.greatest("e.p", "e.q").alias("high"), (F.col("e.p") < F.col("e.q")).alias("up"))
    return t.groupBy("frame", "low", "high").agg(F.count_if("up").alias("along"), F.count_if(~F.col("up")).alias("against"))


def measures(mesh: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """frame, n_triangles, n_corners, n_edges, n_open (edges of one triangle), euler, area.

    frames (column frame): each of them has a row; without triangles its counts are zero and its area is null. By default
    such frames have no row. The triangles are written to the shared folder first, as they are counted three times.
    """
    mesh = stored(mesh, "mesh")
    of = mesh.groupBy("frame").agg(F.count("*").alias("n_triangles"), F.sum(area()).alias("area"))
    rims = edges(mesh).groupBy("frame").agg(F.count("*").alias("n_edges"), F.count_if(F.col("along") + F.col("against") == 1).alias("n_open"))
    own = corners(mesh).groupBy("frame").agg(F.count("*").alias("n_corners"))
    t = of.join(rims, "frame").join(own, "frame")
    if frames is not None:
        t = frames.select("frame").distinct().join(t, "frame", "left").fillna(0, ["n_triangles", "n_edges", "n_open", "n_corners"])
    return t.select("frame", "n_triangles", "n_corners", "n_edges", "n_open", (F.col("n_corners") - F.col("n_edges") + F.col("n_triangles")).alias("euler"), "area")


def surface(voxels: DataFrame, shape: tuple[int, int, int], level: float, mask: DataFrame | None = None, spacing: VoxelSpacing | None = None, edge: int = 32) -> DataFrame:
    """The surface of one volume of voxels (z, y, x, value) at level, zero where the mask is not true; frame is "volume"."""
    from strainlake.functions.units import masked_volume
    from strainlake.operators.blocks import of_voxels

    v = voxels if mask is None else masked_volume(voxels, mask)
    return triangles(of_voxels(v, "volume", edge, shape), shape, (edge,) * 3, level, spacing)


def surface_of_array(spark, store: str, array: str, level: float, spacing: VoxelSpacing | None = None) -> DataFrame:
    """The surface of a stored volume, chunk by chunk: no row for a voxel; frame is the array's name."""
    from strainlake.operators.blocks import of_array

    blocks, shape, chunks = of_array(spark, store, array, array)
    return triangles(blocks, shape, chunks, level, spacing)
