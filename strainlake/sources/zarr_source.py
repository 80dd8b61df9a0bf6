"""Zarr arrays (version 3, and 2) as a Spark data source, read chunk by chunk; and writers, of arrays and of tables.

spark.read.format("zarr_array").option("array", "base/volume0").load(store) gives voxels (z, y, x, value) of a 3-D
array, or flow rows (z, y, x, dz, dy, dx) of a 4-D one with option axis_order. Option crop="z,y,x" keeps the centred
block and reads only its chunks; option form="blocks" gives one row per chunk with its bytes. Option region="2:4,:8,"
keeps z, y and x in these ranges of the array as cropped, places unchanged, and opens only the chunks they touch (whole
chunks as blocks). It is an option because Spark 4.1 keeps what pushFilters() narrowed for later queries over the same
DataFrame. Chunks may lie in shards: a shard is one task, which reads its index and the ranges it needs.
"""

from __future__ import annotations

import gzip
import json
import math
import os
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strainlake.sources import codecs as K

#: What an index says of a chunk that a shard does not hold.
ABSENT = 2**64 - 1


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def read_bytes(store: str, name: str) -> bytes | None:
    """A file of a store, None if it does not exist."""
    from pyarrow import fs

    system, top = _fs(store)
    path = f"{top}/{name}"
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read()


def read_range(store: str, name: str, offset: int, length: int) -> bytes | None:
    """Bytes of a file; a negative offset counts from its end. None if the file does not exist."""
    from pyarrow import fs

    system, top = _fs(store)
    path = f"{top}/{name}"
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_file(path) as f:
        f.seek(offset if offset >= 0 else f.size() + offset)
        return f.read(length)


def children(store: str, group: str) -> list[str]:
    from pyarrow import fs

    system, top = _fs(store)
    found = system.get_file_info(fs.FileSelector(f"{top}/{group}".rstrip("/"), allow_not_found=True))
    return sorted(os.path.basename(x.path) for x in found if x.type == fs.FileType.Directory)


@dataclass(frozen=True)
class ArrayMeta:
    """What a reader needs of an array; codecs are (name, configuration) from the bytes outwards.

    filters change elements before they become bytes. With a shard (its shape, bytes of its index, whether that stands at
    the end), chunks are those within it.
    """

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: float
    codecs: tuple
    separator: str
    prefix: str
    order: str = "C"
    filters: tuple = ()
    axes: tuple[int, ...] | None = None
    shard: tuple | None = None

    def chunk_name(self, at: tuple[int, ...]) -> str:
        return self.prefix + self.separator.join(map(str, at))

    @property
    def per_shard(self) -> tuple[int, ...]:
        return tuple(s // c for s, c in zip(self.shard[0], self.chunks, strict=True)) if self.shard else (1,) * len(self.shape)


def _number(fill, dtype: np.dtype):
    return np.nan if fill in ("NaN", None) and dtype.kind == "f" else 0 if fill is None else float(fill) if isinstance(fill, str) else fill


def node(store: str, name: str) -> ArrayMeta | str | None:
    """An array's metadata, "group", or None if there is nothing."""
    raw = read_bytes(store, f"{name}/zarr.json".lstrip("/"))
    if raw is not None:
        m = json.loads(raw)
        if m["node_type"] == "group":
            return "group"
        dtype = np.dtype(m["data_type"])
        chunks, shard, given = tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), None, m.get("codecs", [])
        if given and given[0]["name"] == "sharding_indexed":
            c = given[0]["configuration"]
            inner = tuple(c["chunk_shape"])
            extra = [x["name"] for x in c.get("index_codecs", [])]
            if set(extra) - {"bytes", "crc32c"} or any(x.get("configuration", {}).get("endian", "little") != "little" for x in c.get("index_codecs", [])):
                raise ValueError(f"{name}: shard indices with {extra} are not supported")
            n = math.prod(o // i for o, i in zip(chunks, inner, strict=True))
            shard, chunks, given = (chunks, 16 * n + 4 * ("crc32c" in extra), c.get("index_location", "end") == "end"), inner, c["codecs"]
        endian, codecs, axes = "little", [], None
        for c in given:
            if c["name"] == "bytes":
                endian = c.get("configuration", {}).get("endian", "little")
            elif c["name"] == "transpose":
                axes = tuple(c["configuration"]["order"])
            else:
                codecs.append((c["name"], json.dumps(c.get("configuration", {}))))
        key = m.get("chunk_key_encoding", {"name": "default"})
        sep = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
        kind = dtype.newbyteorder("<" if endian == "little" else ">").str
        return ArrayMeta(tuple(m["shape"]), chunks, kind, _number(m.get("fill_value"), dtype), tuple(codecs), sep, f"c{sep}" if key["name"] == "default" else "", axes=axes, shard=shard)
    raw = read_bytes(store, f"{name}/.zarray".lstrip("/"))
    if raw is not None:
        m = json.loads(raw)
        filters = tuple((x["id"], json.dumps(x)) for x in m.get("filters") or [])
        c = m.get("compressor")
        return ArrayMeta(tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], _number(m.get("fill_value"), np.dtype(m["dtype"])), ((c["id"], "{}"),) if c else (), m.get("dimension_separator", "."), "", m.get("order", "C"), filters)
    return "group" if read_bytes(store, f"{name}/.zgroup".lstrip("/")) is not None else None


def attributes(store: str, name: str = "") -> dict:
    raw = read_bytes(store, f"{name}/zarr.json".lstrip("/"))
    if raw is not None:
        return json.loads(raw).get("attributes", {})
    raw = read_bytes(store, f"{name}/.zattrs".lstrip("/"))
    return json.loads(raw) if raw else {}


def open_array(store: str, name: str) -> ArrayMeta:
    m = node(store, name)
    if m is None:
        raise FileNotFoundError(f"no array {name!r} in {store}")
    if m == "group":
        raise TypeError(f"{name!r} in {store} is a group, not an array")
    return m


def decode(raw: bytes | None, meta: ArrayMeta) -> np.ndarray:
    dtype = np.dtype(meta.dtype)
    if raw is None:
        return np.full(meta.chunks, meta.fill, dtype)
    for name, _ in reversed(meta.codecs):
        raw = K.unpacked(name, raw)
    flat = np.frombuffer(raw, np.uint8)
    for name, config in reversed(meta.filters):
        flat = K.unfiltered(name, json.loads(config), flat, dtype).view(np.uint8)
    flat = flat.view(dtype)
    if meta.axes is not None:
        return flat.reshape([meta.chunks[a] for a in meta.axes]).transpose(np.argsort(meta.axes))
    return flat.reshape(meta.chunks, order=meta.order)


def shard_index(store: str, name: str, meta: ArrayMeta, at: tuple[int, ...]) -> np.ndarray | None:
    """Offset and length of each chunk of the shard at a place, None if there is no such shard."""
    length = meta.shard[1]
    raw = read_range(store, f"{name}/{meta.chunk_name(at)}".lstrip("/"), -length if meta.shard[2] else 0, length)
    return None if raw is None else np.frombuffer(raw, "<u8", 2 * math.prod(meta.per_shard)).reshape(*meta.per_shard, 2)


def _put(store: str, name: str, raw: bytes) -> None:
    system, top = _fs(store)
    system.create_dir(os.path.dirname(f"{top}/{name}"), recursive=True)
    with system.open_output_stream(f"{top}/{name}") as f:
        f.write(raw)


def _describe(store: str, name: str, shape: tuple[int, ...], dtype: np.dtype, chunks: tuple[int, ...], codec: str | None, attributes: dict | None) -> None:
    """Writes an array's metadata and that of its parent groups where there is none."""
    parts = name.split("/")
    for i in range(len(parts)):
        group = "/".join([*parts[:i], "zarr.json"])
        if read_bytes(store, group) is None:
            _put(store, group, json.dumps({"zarr_format": 3, "node_type": "group", "attributes": (attributes or {}) if i == 0 else {}}).encode())
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {}}] if codec else [])
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": False if dtype == bool else 0, "codecs": codecs, "attributes": {}}
    _put(store, f"{name}/zarr.json", json.dumps(meta).encode())


def encode(block: np.ndarray, codec: str | None) -> bytes:
    raw = block.tobytes()
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(raw)
    return gzip.compress(raw) if codec == "gzip" else raw


def write_array(store: str, name: str, data: np.ndarray, chunks: tuple[int, ...] | None = None, codec: str | None = "zstd", attributes: dict | None = None) -> None:
    """A version 3 array, with its parent groups, from the driver's memory."""
    chunks = chunks or data.shape
    _describe(store, name, data.shape, data.dtype, chunks, codec, attributes)
    for at in product(*[range(-(-n // c)) for n, c in zip(data.shape, chunks, strict=True)]):
        block = np.zeros(chunks, data.dtype)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        _put(store, "/".join([name, "c", *map(str, at)]), encode(block, codec))


def write_volume(voxels, store: str, name: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], dtype: str = "float32", codec: str | None = "zstd", attributes: dict | None = None) -> int:
    """voxels (z, y, x, value) as a version 3 array, each chunk by the task that holds it; returns the chunks written.

    The store must be a path that driver and executors share. Absent voxels are 0; a chunk without voxels has no file.
    """
    from pyspark.sql import functions as F

    _describe(store, name, shape, np.dtype(dtype), chunks, codec, attributes)

    def run(key, t):
        at = [k.as_py() for k in key]
        block = np.zeros(chunks, dtype)
        block[tuple(t.column(a).to_numpy() - i * c for a, i, c in zip("zyx", at, chunks, strict=True))] = t.column("value").to_numpy(zero_copy_only=False)
        _put(store, "/".join([name, "c", *map(str, at)]), encode(block, codec))
        return pa.table({"n": pa.array([1], pa.int64())})

    of = [F.floor(F.col(a) / c).cast("int").alias(f"c{a}") for a, c in zip("zyx", chunks, strict=True)]
    return voxels.select("z", "y", "x", "value", *of).groupBy("cz", "cy", "cx").applyInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class _Chunks(InputPartition):
    def __init__(self, ats: list[tuple[int, ...]]):
        self.ats = ats


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.store, self.name = options["path"], options.get("array", "")
        self.meta = open_array(self.store, self.name)
        self.form = options.get("form", "voxels")
        self.first = options.get("axis_order", "3_zyx") == "3_zyx"
        self.sign = -1.0 if options.get("convention", "pull_back") == "push_forward" else 1.0
        n = len(self.meta.shape)
        if n not in (3, 4):
            raise ValueError(f"{self.name}: a 3-D volume or a 4-D flow is needed, got {n} dimensions")
        self.spatial = list(range(3)) if n == 3 else [1, 2, 3] if self.first else [0, 1, 2]
        full = [self.meta.shape[a] for a in self.spatial]
        want = [int(v) for v in options["crop"].split(",")] if options.get("crop") else full
        if any(w > f for w, f in zip(want, full, strict=True)):
            raise ValueError(f"crop {want} exceeds {full}")
        self.lo = [(f - w) // 2 for f, w in zip(full, want, strict=True)]
        self.hi = [a + w for a, w in zip(self.lo, want, strict=True)]
        self.ends = list(zip(self.lo, self.hi, strict=True))
        if options.get("region"):
            spans = [x.split(":") if x else ["", ""] for x in options["region"].split(",")]
            if len(spans) != 3 or any(len(x) != 2 for x in spans):
                raise ValueError(f"a region needs three ranges, got {options['region']!r}")
            self.ends = [(max(lo, lo + int(a or 0)), min(hi, lo + int(b)) if b else hi) for (lo, hi), (a, b) in zip(self.ends, spans, strict=True)]
        self.index = (None, None)

    def partitions(self):
        m = self.meta
        spans = [range(-(-n // c)) for n, c in zip(m.shape, m.chunks, strict=True)]
        for a, (lo, hi) in zip(self.spatial, self.ends, strict=True):
            c = m.chunks[a]
            spans[a] = range(lo // c, -(-hi // c)) if lo < hi else range(0)
        if len(spans) == 4:  # all three components of a place come from one task
            spans[0 if self.first else 3] = range(1)
        shards: dict[tuple, list] = {}
        for at in product(*spans):
            shards.setdefault(tuple(i // n for i, n in zip(at, m.per_shard, strict=True)), []).append(at)
        return [_Chunks(ats) for ats in shards.values()] or [_Chunks([])]

    def _block(self, at):
        m = self.meta
        if m.shard is None:
            return decode(read_bytes(self.store, f"{self.name}/{m.chunk_name(at)}".lstrip("/")), m)
        outer = tuple(i // n for i, n in zip(at, m.per_shard, strict=True))
        if self.index[0] != outer:
            self.index = outer, shard_index(self.store, self.name, m, outer)
        if self.index[1] is None:
            return decode(None, m)
        offset, length = (int(v) for v in self.index[1][tuple(i % n for i, n in zip(at, m.per_shard, strict=True))])
        return decode(None if offset == ABSENT else read_range(self.store, f"{self.name}/{m.chunk_name(outer)}".lstrip("/"), offset, length), m)

    def read(self, partition):
        for at in partition.ats:
            yield from self._rows(at)

    def _rows(self, at):
        m = self.meta
        if self.form == "blocks":
            b = self._block(at)
            start = [i * c for i, c in zip(at, m.chunks, strict=True)]
            size = [min(c, n - s) for c, n, s in zip(m.chunks, m.shape, start, strict=True)]
            b = np.ascontiguousarray(b[tuple(slice(0, s) for s in size)])
            yield (self.name, *[at[a] for a in self.spatial], *[start[a] for a in self.spatial], *[size[a] for a in self.spatial], np.dtype(m.dtype).name, b.astype(b.dtype.newbyteorder("=")).tobytes())
            return
        start, values = self.values(at)
        coords = [(i + s - lo).ravel().astype(np.int32) for i, s, lo in zip(np.indices(values[0].shape), start, self.lo, strict=True)]
        kind = bool if np.dtype(m.dtype).kind == "b" else np.float32
        names = ["value"] if len(values) == 1 else ["dz", "dy", "dx"]
        yield pa.RecordBatch.from_arrays([*map(pa.array, coords), *[pa.array(np.ascontiguousarray(x).ravel().astype(kind)) for x in values]], names=["z", "y", "x", *names])

    def values(self, at):
        """Where the values of a chunk begin (z, y, x of the array), and they themselves: a volume's, or a flow's three."""
        m = self.meta
        if len(m.shape) == 3:
            values = [self._block(at)]
        else:
            v = 0 if self.first else 3
            parts = []
            for k in range(-(-3 // m.chunks[v])):
                here = list(at)
                here[v] = k
                parts.append(self._block(tuple(here)))
            whole = np.concatenate(parts, v)
            values = [self.sign * np.take(whole, c, v) for c in range(3)]
        start = [at[a] * m.chunks[a] for a in self.spatial]
        cut = tuple(slice(max(0, lo - s), max(0, min(c, hi - s))) for s, c, (lo, hi) in zip(start, [m.chunks[a] for a in self.spatial], self.ends, strict=True))
        return [s + c.start for s, c in zip(start, cut, strict=True)], [x[cut] for x in values]


class ZarrArray(DataSource):
    @classmethod
    def name(cls):
        return "zarr_array"

    def schema(self):
        if self.options.get("form") == "blocks":
            return "name string, bz int, by int, bx int, z0 int, y0 int, x0 int, nz int, ny int, nx int, dtype string, data binary"
        meta = open_array(self.options["path"], self.options.get("array", ""))
        if len(meta.shape) == 4:
            return "z int, y int, x int, dz float, dy float, dx float"
        return f"z int, y int, x int, value {'boolean' if np.dtype(meta.dtype).kind == 'b' else 'float'}"

    def reader(self, schema):
        return _Reader(dict(self.options))


def load(spark: SparkSession, store: str, array: str, **options):
    from strainlake.functions.shipping import ship

    ship(spark)
    spark.dataSource.register(ZarrArray)
    return spark.read.format("zarr_array").options(array=array, **{k: v for k, v in options.items() if v is not None}).load(store)


#: Ranges of z, y and x, the end past the last; None for an open end.
Region = tuple[tuple[int | None, int | None], ...]


def _region(region: Region | None) -> str | None:
    return ",".join(":".join("" if v is None else str(v) for v in r) for r in region) if region else None


def load_volume(spark: SparkSession, store: str, array: str, crop: tuple[int, int, int] | None = None, region: Region | None = None):
    """A 3-D array as float voxels; with a region only those in it, from its chunks alone."""
    if len(open_array(store, array).shape) != 3:
        raise ValueError(f"{array} is not three-dimensional")
    t = load(spark, store, array, crop=",".join(map(str, crop)) if crop else None, region=_region(region))
    return t.withColumn("value", t["value"].cast("float"))


def load_mask(spark: SparkSession, store: str, array: str, crop: tuple[int, int, int] | None = None, shape: tuple[int, int, int] | None = None, region: Region | None = None):
    """A 3-D array as booleans, true where not zero; shape, if given, must be its shape after the crop."""
    meta = open_array(store, array)
    if shape is not None and tuple(crop or meta.shape) != tuple(shape):
        raise ValueError(f"mask {array} has shape {crop or meta.shape}, expected {shape}")
    t = load(spark, store, array, crop=",".join(map(str, crop)) if crop else None, region=_region(region))
    return t.withColumn("value", t["value"].cast("float") != 0)


def load_flow(spark: SparkSession, store: str, array: str, axis_order: str = "3_zyx", convention: str = "pull_back", crop: tuple[int, int, int] | None = None, region: Region | None = None):
    """A 4-D flow as rows in pull-back sign."""
    return load(spark, store, array, axis_order=axis_order, convention=convention, crop=",".join(map(str, crop)) if crop else None, region=_region(region))
