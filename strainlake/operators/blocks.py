"""Volumes as rows of blocks, and their halo exchange: no row for a voxel between a chunked store and a correlation.

A block row is (frame, z0, y0, x0, nz, ny, nx, dtype, data): a box of a frame's voxels as bytes in C order. A use says
which frame takes which role (r, d, mr, md) in which pair, and that frame's block edges. The points to correlate are
dealt to tiles of some lattice points per axis; a tile needs the box that its points' windows cover, so tiles without
points need nothing and sparse tiles little. Each block learns from one equi-join which boxes it overlaps, cuts itself
and sends the slices; a tile puts at most the slices of its neighbourhood together. A frame that serves several pairs is
read and joined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strainlake.config import CorrelateConfig, Lattice
from strainlake.operators.ncc_fft import correlation, peak_of, prepared, window_bytes

BLOCK = "frame string, z0 int, y0 int, x0 int, nz int, ny int, nx int, dtype string, data binary"
USE = "pair_id string, role string, frame string, cz int, cy int, cx int"
PEAKS = "pair_id string, poi long, kz int, ky int, kx int, dz double, dy double, dx double, confidence double"
SLICE = "pair_id string, tz int, ty int, tx int, role string, oz int, oy int, ox int, nz int, ny int, nx int, dtype string, data binary"
ORIGIN, TILE = ("z0", "y0", "x0"), ("pair_id", "tz", "ty", "tx")
#: Bytes of transforms in flight within a task: windows are correlated in batches of about so many.
BATCH_BYTES = 96 << 20
#: Bytes of slices a task gathers before it passes them on.
SEND_BYTES = 16 << 20
_SLICES = pa.schema([(n, pa.string() if k == "string" else pa.binary() if k == "binary" else pa.int32()) for n, k in (x.split() for x in SLICE.split(", "))])


def box_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], row["dtype"]).reshape(row["nz"], row["ny"], row["nx"])


def of_voxels(voxels: DataFrame, frame: str | Column, edge: int = 32, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Blocks of `edge` voxels per axis from rows (z, y, x, value); voxels that are missing are zero.

    frame: a name, or a column of voxels. With a shape, voxels outside of it raise. Voxels are shuffled once.
    """
    kind = {"boolean": "bool", "float": "float32"}.get(dict(voxels.dtypes)["value"], "float64")
    f = F.lit(frame) if isinstance(frame, str) else frame
    value = F.col("value") if kind != "float64" else F.col("value").cast("double")

    def run(key, t):
        name, *b = (k.as_py() for k in key)
        at = [t.column(a).to_numpy().astype(np.int64) for a in "zyx"]
        if shape and any(len(i) and (i.min() < 0 or i.max() >= n) for i, n in zip(at, shape, strict=True)):
            raise ValueError(f"{name}: voxels lie outside of the shape {shape}")
        box = np.zeros((edge,) * 3, kind)
        box[tuple(i - k * edge for i, k in zip(at, b, strict=True))] = t.column("value").to_numpy(zero_copy_only=False)
        return pa.table([[name], *[pa.array([k * edge], pa.int32()) for k in b], *[pa.array([edge], pa.int32())] * 3, [kind], pa.array([box.tobytes()], pa.binary())], names=[x.split()[0] for x in BLOCK.split(", ")])

    rows = voxels.select(f.alias("frame"), "z", "y", "x", value.alias("value"), *[F.floor(F.col(a) / edge).cast("int").alias(f"b{a}") for a in "zyx"])
    return rows.groupBy("frame", "bz", "by", "bx").applyInArrow(run, BLOCK)


def of_array(spark: SparkSession, store: str, array: str, frame: str) -> tuple[DataFrame, tuple[int, ...], tuple[int, ...]]:
    """The blocks of a stored volume, one for each chunk, with its shape and block edges."""
    from strainlake.sources import zarr_source

    meta = zarr_source.open_array(store, array)
    if len(meta.shape) != 3:
        raise ValueError(f"{array} is not three-dimensional")
    t = zarr_source.load(spark, store, array, form="blocks")
    return t.select(F.lit(frame).alias("frame"), *ORIGIN, "nz", "ny", "nx", "dtype", "data"), meta.shape, meta.chunks


def window_support(blocks: DataFrame, lattice: Lattice) -> DataFrame:
    """frame, poi and the share of its window where a mask's blocks are true (not zero), where that is not 0.

    Each block adds up its part of every window it overlaps by a prefix sum of its own; the parts are summed.
    """
    (nz, ny, nx), stride, window = lattice.counts, lattice.stride, lattice.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                box = box_of(row) != 0
                sat = np.zeros([n + 1 for n in box.shape], np.int64)
                sat[1:, 1:, 1:] = box.cumsum(0, dtype=np.int64).cumsum(1).cumsum(2)
                points, ends = [], []
                for o, n, s, w, most in zip((row[k] for k in ORIGIN), box.shape, stride, window, lattice.counts, strict=True):
                    i = np.arange(max(0, -(-(o - w + 1) // s)), min(most - 1, (o + n - 1) // s) + 1)
                    points.append(i)
                    ends.append((np.clip(i * s - o, 0, n), np.clip(i * s + w - o, 0, n)))
                total = sum((-1) ** (3 - a - b - c) * sat[np.ix_(ends[0][a], ends[1][b], ends[2][c])] for a in (0, 1) for b in (0, 1) for c in (0, 1))
                poi = (points[0][:, None, None] * ny + points[1][:, None]) * nx + points[2]
                some = total > 0
                yield pa.RecordBatch.from_arrays([pa.array([row["frame"]] * int(some.sum()), pa.string()), pa.array(poi[some]), pa.array(total[some])], names=["frame", "poi", "n"])

    parts = blocks.mapInArrow(run, "frame string, poi long, n long")
    return parts.groupBy("frame", "poi").agg((F.sum("n") / F.lit(float(window[0] * window[1] * window[2]))).alias("fraction"))


def tiles_of(wanted: DataFrame, lattice: Lattice, points: int) -> DataFrame:
    """pair_id, tz, ty, tx, the box (lo, hi: one past its end) that the windows of a tile's points cover, and those points."""
    _, ny, nx = lattice.counts
    index = {"z": F.expr(f"poi div {ny * nx}"), "y": F.expr(f"poi div {nx} % {ny}"), "x": F.col("poi") % nx}
    t = wanted.select("pair_id", "poi", *[i.cast("int").alias(f"i{a}") for a, i in index.items()], *[F.floor(i / points).cast("int").alias(f"t{a}") for a, i in index.items()])
    ends = [g for a, s, w in zip("zyx", lattice.stride, lattice.window, strict=True) for g in ((F.min(f"i{a}") * s).alias(f"lo{a}"), (F.max(f"i{a}") * s + w).alias(f"hi{a}"))]
    return t.groupBy(*TILE).agg(*ends, F.sort_array(F.collect_list("poi")).alias("pois"))


def needs_of(tiles: DataFrame, uses: DataFrame) -> DataFrame:
    """frame, z0, y0, x0 of each block that a tile needs, with the boxes (of which pair, tile and role) it has to serve."""
    need = tiles.drop("pois").join(uses, "pair_id")
    for a in "zyx":
        c = F.col(f"c{a}")
        need = need.withColumn(f"{a}0", F.explode(F.sequence(F.floor(F.col(f"lo{a}") / c), F.floor((F.col(f"hi{a}") - 1) / c))))
        need = need.withColumn(f"{a}0", (F.col(f"{a}0") * c).cast("int"))
    box = [f"{e}{a}" for e in ("lo", "hi") for a in "zyx"]
    return need.groupBy("frame", *ORIGIN).agg(F.collect_list(F.struct(*TILE, "role", *box)).alias("needs"))


#: What the dtype of a slice begins with where its chunk could not be read; the reason follows.
FAULT = "!"


def _cut(rows: Iterator[tuple[np.ndarray | str, list[int], list[dict]]]) -> Iterator[pa.RecordBatch]:
    """Slices of boxes (values, origin, needs), in batches of about SEND_BYTES. A text in place of values is a fault, sent
    to each tile that needs the box."""
    out, held = [], 0
    send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SLICES.types, strict=True)], schema=_SLICES)
    for here, first, needs in rows:
        if isinstance(here, str):
            out += [(*[n[k] for k in TILE], n["role"], *[0] * 6, FAULT + here, b"") for n in needs]
            continue
        first = np.array(first)
        for n in needs:
            lo, hi = (np.array([n[f"{e}{a}"] for a in "zyx"]) for e in ("lo", "hi"))
            a, b = np.maximum(lo, first), np.minimum(hi, first + here.shape)
            if (a < b).all():
                cut = here[tuple(slice(x, y) for x, y in zip(a - first, b - first, strict=True))]
                out.append((*[n[k] for k in TILE], n["role"], *(a - lo).tolist(), *cut.shape, here.dtype.name, cut.tobytes()))
                held += cut.nbytes
            if held >= SEND_BYTES:
                yield send()
                out, held = [], 0
    if out:
        yield send()


def slices(blocks: DataFrame, needs: DataFrame) -> DataFrame:
    """What each tile needs, cut from rows of blocks: its place within the tile's box, its size and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch)))
        yield from _cut((box_of(r), [r[k] for k in ORIGIN], r["needs"]) for r in one)

    return blocks.join(needs, ["frame", *ORIGIN]).select(*ORIGIN, "nz", "ny", "nx", "dtype", "data", "needs").mapInArrow(run, SLICE)


def stored_slices(arrays: dict[str, tuple[str, str]], needs: DataFrame, faults: bool = False) -> DataFrame:
    """The same from stored volumes (frame -> store, array): the task that a need is dealt to opens that chunk.

    Chunks that no tile needs are never opened, and no chunk is shuffled whole. faults: a chunk that cannot be read goes
    to its tiles as a fault and does not fail the task.
    """
    from strainlake.sources.zarr_source import _Reader

    readers = {k: _Reader({"path": store, "array": array}) for k, (store, array) in arrays.items()}

    def opened(row: dict) -> tuple[np.ndarray | str, list[int], list[dict]]:
        reader = readers[row["frame"]]
        at = tuple(row[k] // c for k, c in zip(ORIGIN, reader.meta.chunks, strict=True))
        try:
            values = reader.values(at)[1][0]
        except Exception as e:
            if not faults:
                raise
            return f"{type(e).__name__}: {e} (chunk {at} of {row['frame']})", [], row["needs"]
        return values.astype(values.dtype.newbyteorder("=")), [row[k] for k in ORIGIN], row["needs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(map(opened, (r for batch in batches for r in batch.to_pylist())))

    chunks = sum(len(r.partitions()) for r in readers.values())
    cores = needs.sparkSession.sparkContext.defaultParallelism
    # A number of its own: rows this short would else end in one task, with all chunks to open.
    return needs.repartition(max(1, min(chunks, max(4 * cores, chunks // 64))), "frame", *ORIGIN).mapInArrow(run, SLICE)


def peaks(source: DataFrame | dict[str, tuple[str, str]], uses: DataFrame, wanted: DataFrame, lattice: Lattice, config: CorrelateConfig, points: int = 4, masks: tuple[bool, bool] = (True, False), batch: int | None = None, digits: int | None = None, faults: bool = False) -> DataFrame:
    """Peaks of the wanted points (pair_id, poi), each tile of `points` lattice points per axis in one group.

    faults: of stored arrays, a tile with a chunk that cannot be read gives its points with null peaks and the reason
    in a column `fault`, null for all others.

    source: rows of blocks, or the stored array (store, name) of each frame. masks: whether uses have a mask of the reference (else all is valid) and one of the deformed volume (else that of the
    reference). batch: windows in flight, by default as many as BATCH_BYTES hold.
    """
    (_, ny, nx), stride, window = lattice.counts, np.array(lattice.stride), lattice.window
    alpha, mode, norm, eps, single = config.alpha, config.mode, config.normalization, config.eps, config.precision == "single"
    n = batch or max(1, min(64, BATCH_BYTES // window_bytes(window, mode, single)))
    names = [x.split()[0] for x in PEAKS.split(", ")]

    def run(key, left, right):
        reason = next((k[len(FAULT) :] for k in left.column("dtype").to_pylist() if k.startswith(FAULT)), None)
        if reason is not None:
            poi = right.column("pois")[0].values
            none = [pa.nulls(len(poi), pa.int32())] * 3 + [pa.nulls(len(poi), pa.float64())] * 4
            return pa.table([pa.array([key[0].as_py()] * len(poi), pa.string()), poi, *none, pa.array([reason] * len(poi), pa.string())], names=[*names, "fault"])
        lo, hi = (np.array([right.column(f"{e}{a}")[0].as_py() for a in "zyx"]) for e in ("lo", "hi"))
        full = {k: np.zeros(hi - lo, np.float32 if single else float) for k in "rd"}
        full |= {k: np.zeros(hi - lo, bool) for k, have in zip(("mr", "md"), masks, strict=True) if have}
        for i in range(len(left)):
            row = left.slice(i, 1).to_pylist()[0]
            o = [row[k] for k in ("oz", "oy", "ox")]
            cut = box_of(row)
            full[row["role"]][tuple(slice(a, a + s) for a, s in zip(o, cut.shape, strict=True))] = cut
        view = {k: np.lib.stride_tricks.sliding_window_view(v, window) for k, v in full.items()}
        poi = right.column("pois")[0].values.to_numpy()
        start = np.stack([poi // (ny * nx), poi // nx % ny, poi % nx], 1) * stride - lo
        rows = []
        for i in range(0, len(poi), n):
            s = tuple(start[i : i + n].T)
            mr = view["mr"][s] if masks[0] else None
            md = view["md"][s] if masks[1] else mr
            r, d = prepared(view["r"][s], mr, alpha), prepared(view["d"][s], md, alpha)
            rows.append(peak_of(correlation(r, d, mode, norm, eps), eps, digits))
        lag, fine, value = (np.concatenate(c) for c in zip(*rows, strict=True))
        cols = [pa.array([key[0].as_py()] * len(poi), pa.string()), pa.array(poi), *[pa.array(lag[:, a].astype(np.int32)) for a in range(3)], *[pa.array(fine[:, a]) for a in range(3)], pa.array(value)]
        return pa.table(cols + ([pa.nulls(len(poi), pa.string())] if faults else []), names=names + (["fault"] if faults else []))

    tiles = tiles_of(wanted, lattice, points)
    needs = needs_of(tiles, uses)
    cut = stored_slices(source, needs, faults) if isinstance(source, dict) else slices(source, needs)
    return cut.groupBy(*TILE).cogroup(tiles.groupBy(*TILE)).applyInArrow(run, PEAKS + (", fault string" if faults else ""))
