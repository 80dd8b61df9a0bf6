"""Filters along lines of a volume: Gaussian smoothing, B-spline coefficients, exact distances. NumPy within, blocks of
lines as groups: a task holds n x BLOCK x BLOCK voxels, so no group grows beyond a volume's edge times a constant."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 32
AXES = ("z", "y", "x")


def mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond the edge mirrored back, the edge sample repeated."""
    j = np.mod(i, 2 * n)
    return np.where(j >= n, 2 * n - 1 - j, j)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def smooth(lines: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along axis 0, mirrored edges."""
    k = gaussian_kernel(sigma)
    r, n = len(k) // 2, len(lines)
    out = np.zeros_like(lines, float)
    for w, o in zip(k, range(-r, r + 1), strict=True):
        out += w * lines[mirror(np.arange(n) + o, n)]
    return out


def spline_weight(x: np.ndarray, order: int) -> np.ndarray:
    """The centred B-spline of an order at x."""
    x = np.asarray(x, float)
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    h = (order + 1) / 2
    return sum((-1) ** k * comb(order + 1, k) * np.maximum(0, x + h - k) ** order for k in range(order + 2)) / factorial(order)


@lru_cache(maxsize=8)
def poles(order: int) -> tuple[float, ...]:
    """Poles within the unit circle of the filter that turns samples into B-spline coefficients."""
    r = order // 2
    taps = spline_weight(np.arange(-r, r + 1, dtype=float), order)
    roots = np.roots(taps).real
    return tuple(sorted((float(x) for x in roots if abs(x) < 1), key=abs, reverse=True))


def coefficients(lines: np.ndarray, order: int) -> np.ndarray:
    """B-spline coefficients along axis 0 that interpolate the samples; the samples themselves for orders 0 and 1.

    A recursion forth and back for each pole, in time linear in the lines' length. Edges are mirrored, the edge sample
    repeated, so the recursion's start is a sum over the mirrored line, as far as the pole's powers are felt.
    """
    if not 0 <= order <= 5:
        raise ValueError(f"order must lie in 0..5, got {order}")
    if order < 2:
        return lines
    c, n = np.array(lines, float), len(lines)
    for p in poles(order):
        c *= (1 - p) * (1 - 1 / p)
        felt = min(2 * n, int(np.ceil(np.log(1e-18) / np.log(abs(p)))))
        powers = p ** np.arange(1, felt + 1)
        before = np.tensordot(powers, c[mirror(np.arange(felt), n)], 1) / (1 - p ** (2 * n))  # what a mirrored past leaves
        c[0] += before
        for i in range(1, n):
            c[i] += p * c[i - 1]
        c[n - 1] *= p / (p - 1)
        for i in range(n - 2, -1, -1):
            c[i] = p * (c[i + 1] - c[i])
    return c


def nearest_squares(lines: np.ndarray) -> np.ndarray:
    """min over j of lines[j] + (i - j)^2 along axis 0: one pass of the separable exact distance transform.

    A sample lies no farther than its own value allows, so only gaps up to the largest distance that is left are tried:
    time linear in the line's length, times that distance. Lines without any finite sample are left out.
    """
    n, far = len(lines), float(np.max(lines, initial=0.0))
    flat = np.array(lines, float).reshape(n, -1)
    some = np.flatnonzero(flat.min(0) < far)
    if not len(some):
        return flat.reshape(lines.shape)
    own = flat[:, some]
    out = own.copy()
    for gap in range(1, n):
        if gap * gap >= out.max():
            break
        np.minimum(out[gap:], own[:-gap] + gap * gap, out=out[gap:])
        np.minimum(out[:-gap], own[gap:] + gap * gap, out=out[:-gap])
    flat[:, some] = out
    return flat.reshape(lines.shape)


def along(voxels: DataFrame, axis: str, shape: tuple[int, int, int], f: Callable[[np.ndarray], np.ndarray], fill: float = 0.0) -> DataFrame:
    """voxels (z, y, x, value) with f applied along an axis. Voxels that are missing count as fill; all come out."""
    n = dict(zip(AXES, shape, strict=True))
    b, c = (a for a in AXES if a != axis)
    blocks = voxels.select("z", "y", "x", F.col("value").cast("double").alias("value"), F.floor(F.col(b) / BLOCK).cast("int").alias("gb"), F.floor(F.col(c) / BLOCK).cast("int").alias("gc"))

    def run(key, t):
        kb, kc = (k.as_py() * BLOCK for k in key)
        size = (n[axis], min(BLOCK, n[b] - kb), min(BLOCK, n[c] - kc))
        lines = np.full(size, fill)
        at = {a: t.column(a).to_numpy().astype(int) for a in AXES}
        lines[at[axis], at[b] - kb, at[c] - kc] = t.column("value").to_numpy()
        out = f(lines)
        i, j, k = (v.ravel().astype(np.int32) for v in np.indices(size))
        cols = {axis: i, b: (j + kb).astype(np.int32), c: (k + kc).astype(np.int32)}
        return pa.table([pa.array(cols[a]) for a in AXES] + [pa.array(out.ravel())], names=[*AXES, "value"])

    return blocks.groupBy("gb", "gc").applyInArrow(run, "z int, y int, x int, value double")


def every_axis(voxels: DataFrame, shape: tuple[int, int, int], f: Callable[[np.ndarray], np.ndarray], fill: float = 0.0) -> DataFrame:
    for axis in AXES:
        voxels = along(voxels, axis, shape, f, fill)
    return voxels


def gaussian(voxels: DataFrame, shape: tuple[int, int, int], sigma: float) -> DataFrame:
    if sigma <= 0:
        raise ValueError(f"sigma must be positive, got {sigma}")
    return every_axis(voxels, shape, lambda v: smooth(v, sigma))


def spline_table(voxels: DataFrame, shape: tuple[int, int, int], order: int = 3) -> DataFrame:
    """Coefficients of the interpolating spline; make it once, sample it often."""
    return voxels if order < 2 else every_axis(voxels, shape, lambda v: coefficients(v, order))


def distance_volume(mask: DataFrame, shape: tuple[int, int, int], to: bool = True) -> DataFrame:
    """The exact distance of every voxel to the nearest one whose mask value is `to`: three passes over lines."""
    far = 4.0 * sum(s * s for s in shape)
    seeds = mask.select("z", "y", "x", F.when(F.col("value") == F.lit(to), 0.0).otherwise(far).alias("value"))
    d = every_axis(seeds, shape, nearest_squares, far)
    return d.select("z", "y", "x", F.when(F.col("value") < far, F.sqrt("value")).alias("value"))


#: Edge of the cells that points and coefficients meet in, voxels that a spline reaches beyond one, and the points of a
#: cell that go into one group.
CELL, HALO, GROUP = 32, 4, 1 << 18


def _folded(p: Column, n: int) -> Column:
    """A coordinate mirrored into the volume: the spline of mirrored coefficients has the same value there."""
    m = (p + 0.5) - F.floor((p + 0.5) / F.lit(2.0 * n)) * F.lit(2.0 * n)
    return F.when(m > n, F.lit(2.0 * n) - m).otherwise(m) - 0.5


def _cell_slices(blocks: DataFrame) -> DataFrame:
    """Coefficient blocks cut into what each of the cells around them needs: gz, gy, gx, frame, place and bytes."""
    schema = "gz int, gy int, gx int, frame string, oz int, oy int, ox int, nz int, ny int, nx int, data binary"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                here = np.frombuffer(row["data"], row["dtype"]).reshape(row["nz"], row["ny"], row["nx"])
                first = np.array([row[k] for k in ("z0", "y0", "x0")])
                out = []
                for g in np.ndindex(3, 3, 3):
                    cell = first // CELL + np.array(g) - 1
                    lo = np.maximum(cell * CELL - HALO, first)
                    hi = np.minimum((cell + 1) * CELL + HALO, first + CELL)
                    if (cell >= 0).all():
                        cut = here[tuple(slice(a, b) for a, b in zip(lo - first, hi - first, strict=True))]
                        out.append((*cell.tolist(), row["frame"], *(lo - cell * CELL + HALO).tolist(), *cut.shape, cut.astype("<f8").tobytes()))
                cols = list(zip(*out, strict=True))
                ints = lambda c: pa.array(c, pa.int32())
                yield pa.RecordBatch.from_arrays([*map(ints, cols[:3]), pa.array(cols[3], pa.string()), *map(ints, cols[4:10]), pa.array(cols[10], pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    return blocks.mapInArrow(run, schema)


def evaluate(c: np.ndarray, p: np.ndarray, order: int) -> np.ndarray:
    """The spline with coefficients c at points p (rows of three), whose taps all lie within c."""
    first = (np.floor(p + 0.5) if order % 2 == 0 else np.floor(p)).astype(np.int64) - order // 2
    weight = np.stack([spline_weight(p - (first + k), order) for k in range(order + 1)])  # tap, point, axis
    out = np.zeros(len(p))
    for i in range(order + 1):
        for j in range(order + 1):
            plane = weight[i, :, 0] * weight[j, :, 1]
            for k in range(order + 1):
                out += plane * weight[k, :, 2] * c[first[:, 0] + i, first[:, 1] + j, first[:, 2] + k]
    return out


def sample_all(points: DataFrame, tables: dict[str, DataFrame], shape: tuple[int, int, int], order: int = 3, at: tuple[str, str, str] = ("pz", "py", "px"), key: str = "poi") -> DataFrame:
    """key and the value of each table's spline (out -> coefficients z, y, x, value) at each point, evaluated by cells.

    Points are dealt to the cell that they fall into, wherever they come from, and each cell gets the coefficients of its
    box and a halo of a few voxels: what is shipped follows the points, and cells without points get nothing. Cells with
    very many points are split. Points beyond the volume are mirrored back; those with a null coordinate have no row,
    those with a NaN the value NaN.
    """
    from strainlake.operators.blocks import of_voxels

    names, cell = list(tables), ["gz", "gy", "gx"]
    kind = dict(points.dtypes)[key]
    t = points.select(key, *[_folded(F.col(c).cast("double"), n).alias(f"p{a}") for a, c, n in zip(AXES, at, shape, strict=True)])
    t = t.where(F.col("pz").isNotNull() & F.col("py").isNotNull() & F.col("px").isNotNull())
    t = t.select("*", *[F.greatest(F.lit(0), F.least(F.lit((n - 1) // CELL), F.floor((F.nanvl(f"p{a}", F.lit(0.0)) + 0.5) / CELL))).cast("int").alias(f"g{a}") for a, n in zip(AXES, shape, strict=True)])
    counts = t.groupBy(*cell).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    # Points never meet by cell alone, which would put a full cell's into one task: the full cells, of more than GROUP
    # points each, are few and broadcast, and all others are one part.
    full = F.broadcast(counts.where("parts > 1"))
    dealt = t.join(full, cell, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(key, "pz", "py", "px"), F.col("parts")).cast("int"))).drop("parts")
    coded = [of_voxels(c, n, CELL) for n, c in tables.items()]
    blocks = coded[0]
    for b in coded[1:]:
        blocks = blocks.unionByName(b)
    cut = _cell_slices(blocks).join(counts, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(g, left, right):
        origin = np.array([g[i].as_py() for i in range(3)]) * CELL - HALO
        size = (CELL + 2 * HALO,) * 3
        boxes = {n: np.zeros(size) for n in names}
        for i in range(len(right)):
            row = right.slice(i, 1).to_pylist()[0]
            n = (row["nz"], row["ny"], row["nx"])
            boxes[row["frame"]][tuple(slice(o, o + k) for o, k in zip((row["oz"], row["oy"], row["ox"]), n, strict=True))] = np.frombuffer(row["data"]).reshape(n)
        back = np.ix_(*[np.clip(mirror(np.arange(o, o + s), n) - o, 0, s - 1) for o, s, n in zip(origin, size, shape, strict=True)])
        p = np.stack([left.column(f"p{a}").to_numpy() for a in AXES], 1)
        lost = np.isnan(p).any(1)
        local = np.where(lost[:, None], HALO, p - origin)
        values = [np.where(lost, np.nan, evaluate(boxes[n][back], local, order)) for n in names]
        return pa.table([left.column(key), *map(pa.array, values)], names=[key, *names])

    group = [*cell, "part"]
    out = f"`{key}` {kind}, " + ", ".join(f"`{n}` double" for n in names)
    return dealt.groupBy(*group).cogroup(cut.groupBy(*group)).applyInArrow(run, out)


def sample(points: DataFrame, table: DataFrame, shape: tuple[int, int, int], order: int = 3, at: tuple[str, str, str] = ("pz", "py", "px"), key: str = "poi", out: str = "value") -> DataFrame:
    """key and the spline's value at each point; see sample_all()."""
    return sample_all(points, {out: table}, shape, order, at, key)
