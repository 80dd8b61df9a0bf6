"""How many windows of a correlation fit into a worker's memory."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, SparkSession, functions as F

from strainlake.config import CorrelateConfig, Lattice, triple

#: Memory a Python worker may use for one tile, where the session's settings leave it more or say nothing.
TILE_MEMORY = 1 << 30
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_log = logging.getLogger(__name__)

#: Bytes per voxel of a window, for each window in flight and once.
PER_POINT = {("cyclic", "global"): 36, ("linear", "global"): 232, ("linear", "overlap"): 480}
ONCE = {("linear", "overlap"): 8}


@dataclass(frozen=True)
class Footprint:
    per_point: int
    once: int


def footprint(window, mode: str = "linear", normalization: str = "overlap") -> Footprint:
    if (mode, normalization) not in PER_POINT:
        raise ValueError(f"no kernel for {mode}, {normalization}")
    voxels = prod(triple(window))
    return Footprint(PER_POINT[mode, normalization] * voxels, ONCE.get((mode, normalization), 0) * voxels)


def resident(shape, distinct_deformed_mask: bool = False) -> int:
    """Two float volumes and one or two masks."""
    return prod(triple(shape, "shape")) * (10 if distinct_deformed_mask else 9)


def largest_batch(free: int, shape, window, mode: str = "linear", normalization: str = "overlap", distinct_deformed_mask: bool = False, headroom: float = 0.15, least: int = 1, most: int = 1024, multiple: int = 8) -> int:
    """The most windows that fit beside what is resident, down to a multiple, at most `most`; an error below `least`."""
    if not 0 <= headroom < 1:
        raise ValueError(f"headroom must lie in [0, 1), got {headroom}")
    if least <= 0 or most <= 0 or multiple <= 0 or least > most or free < 0:
        raise ValueError("least, most and multiple must be positive, least at most most, free not negative")
    f = footprint(window, mode, normalization)
    left = int(free * (1 - headroom)) - resident(shape, distinct_deformed_mask) - f.once
    batch = min(max(0, left) // f.per_point // multiple * multiple, most)
    if batch < least:
        raise RuntimeError(f"no batch of {least} fits: {free} bytes free, {resident(shape, distinct_deformed_mask)} resident, {f.per_point} per window, headroom {headroom}")
    return batch


def batch_of(free: Column, voxels: Column, window: Column, mode: Column, normalization: Column, headroom: float = 0.15, most: int = 1024, multiple: int = 8) -> dict[str, Column]:
    """per_point, resident and batch as columns, for many plans at once; a plan that no batch fits has batch 0."""
    cube = window.cast("long") * window * window
    pick = lambda table: F.coalesce(*[F.when((mode == m) & (normalization == n), F.lit(v).cast("long")) for (m, n), v in table.items()], F.lit(0).cast("long"))
    per_point, resident_ = pick(PER_POINT) * cube, 9 * voxels
    left = F.floor(free * F.lit(1 - headroom)) - resident_ - pick(ONCE) * cube
    batch = F.least(F.floor(F.greatest(F.lit(0), left) / per_point / multiple) * multiple, F.lit(most))
    return {"per_point": per_point, "resident": resident_, "batch": batch.cast("long")}


def size_of(text: str) -> int:
    """Bytes of a Spark memory setting; a bare number is in MiB."""
    t = text.strip().lower().removesuffix("b") or "0"
    return int(t[:-1]) * _UNITS[t[-1]] if t[-1] in _UNITS else int(t) * (1 if text.strip().lower().endswith("b") else 1 << 20)


def worker_memory(spark: SparkSession, most: int = TILE_MEMORY) -> int:
    """Bytes that one Python worker of an executor may take for a tile, `most` at most.

    An executor's Python memory is shared by as many workers as it has cores. It is spark.executor.pyspark.memory; where
    that is unset, what lies beside the heap (the overhead, by its own setting or as a share of spark.executor.memory).
    Sessions that set none of these, local ones among them, get `most`.
    """
    conf = spark.sparkContext.getConf()
    own, beside, heap = (conf.get(f"spark.executor.{k}", "") for k in ("pyspark.memory", "memoryOverhead", "memory"))
    if own or beside:
        whole = size_of(own or beside)
    elif heap:
        whole = max(384 << 20, int(size_of(heap) * float(conf.get("spark.executor.memoryOverheadFactor", "0.1"))))
    else:
        return most
    each = min(most, whole // max(1, int(conf.get("spark.executor.cores", "1"))))
    _log.info("tile memory: whole=%d cores=%s each=%d", whole, conf.get("spark.executor.cores", "1"), each)
    return each


#: Bytes per voxel of a tile while it is put together: volumes and masks as arrays, and as slices that come in.
PER_VOXEL = {"double": 36, "single": 28}
#: Lattice points per axis of a tile at most; and tiles for each core at least, as far as there are points.
MOST_POINTS, TILES_A_CORE = 6, 2


def tile_points(memory: int, lattice: Lattice, config: CorrelateConfig, cores: int = 1, pairs: int = 1) -> int:
    """Points per axis of a tile that fits into memory beside a batch of windows and leaves tiles for all cores."""
    from strainlake.operators.blocks import BATCH_BYTES
    from strainlake.operators.ncc_fft import window_bytes

    batch = max(BATCH_BYTES, window_bytes(lattice.window, config.mode, config.precision == "single"))
    fits = lambda t: PER_VOXEL[config.precision] * prod((min(t, n) - 1) * s + w for n, s, w in zip(lattice.counts, lattice.stride, lattice.window, strict=True)) + batch <= memory
    dealt = lambda t: pairs * prod(-(-n // t) for n in lattice.counts) >= TILES_A_CORE * cores
    return max([1, *[t for t in range(2, MOST_POINTS + 1) if fits(t) and dealt(t)]])
