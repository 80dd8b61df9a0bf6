"""Chunks as other writers pack them: Blosc frames, filters, shards; and filters that reach the reader."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strainlake.functions.shipping import ship
from strainlake.sources import codecs, zarr_source as zarr


def shuffled(raw, item, bits):
    n = len(raw) // item
    if bits:
        if n % 8:
            return raw
        out = np.zeros((item * 8, n), np.uint8)
        for k in range(n):
            for b in range(item * 8):
                out[b, k] = raw[k * item + b // 8] >> (b % 8) & 1
        body = bytes(sum(int(out[b, 8 * j + i]) << i for i in range(8)) for b in range(item * 8) for j in range(n // 8))
    else:
        body = bytes(raw[k * item + j] for j in range(item) for k in range(n))
    return body + raw[n * item :]


def frame(raw, item, codec, mode, block, split):
    """A Blosc frame by its published layout. mode: 0 plain, 1 byte shuffle, 2 bit shuffle."""
    pack = {1: pa.Codec("lz4_raw"), 2: pa.Codec("snappy"), 4: pa.Codec("zstd")}.get(codec)
    squeeze = (lambda b: zlib.compress(b)) if codec == 3 else (lambda b: pack.compress(b, asbytes=True))
    n, bodies = -(-len(raw) // block), []
    for i in range(n):
        own = raw[i * block : (i + 1) * block]
        whole = shuffled(own, item, mode == 2) if mode else own
        parts = item if split and len(own) == block and 1 < item <= 16 and block // item >= 128 else 1
        size, body = len(own) // parts, b""
        for k in range(parts):
            part = whole[k * size : (k + 1) * size]
            packed = squeeze(part)
            packed = part if len(packed) >= len(part) else packed
            body += struct.pack("<i", len(packed)) + packed
        bodies.append(body)
    starts, at = [], 16 + 4 * n
    for b in bodies:
        starts.append(at)
        at += len(b)
    flags = {0: 0, 1: 1, 2: 4}[mode] | (0 if split else 16) | codec << 5
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(raw), block, at) + struct.pack(f"<{n}i", *starts) + b"".join(bodies)


@pytest.mark.parametrize("codec", [1, 2, 3, 4])
def test_blosc_frames(codec):
    rng = np.random.default_rng(codec)
    for item, n in ((4, 1000), (2, 333), (8, 64), (1, 700), (4, 1)):
        raw = (np.cumsum(rng.integers(0, 3, n)) % 250).astype({1: "u1", 2: "u2", 4: "f4", 8: "f8"}[item]).tobytes()
        for mode in (0, 1, 2):
            for split in (True, False):
                for block in (len(raw), 1024, 512):
                    assert codecs.blosc(frame(raw, item, codec, mode, block, split)) == raw
    copied = struct.pack("<BBBBIII", 2, 1, 2, 4, 8, 8, 24) + b"12345678"
    assert codecs.blosc(copied) == b"12345678"
    for bad in (copied[:-1], struct.pack("<BBBBIII", 2, 1, 0, 4, 8, 8, 16)):
        with pytest.raises(ValueError):
            codecs.blosc(bad)


def old_array(top, v, compressor, pack, chunks, filters=None, order="C", key="."):
    top.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": v.shape, "chunks": chunks, "dtype": v.dtype.str, "compressor": compressor, "fill_value": 0, "order": order, "filters": filters, "dimension_separator": key}
    (top / ".zarray").write_text(json.dumps(meta))
    for at in np.ndindex(*[-(-n // c) for n, c in zip(v.shape, chunks)]):
        block = np.zeros(chunks, v.dtype)
        part = v[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        (top / key.join(map(str, at))).write_bytes(pack(block))


def array(t, shape):
    p = t.toPandas()
    out = np.full(shape, np.nan)
    out[p.z, p.y, p.x] = p["value"].astype(float)
    return out


def test_version_2_with_blosc_and_filters(spark, tmp_path):
    ship(spark)
    v = (np.arange(5 * 6 * 7) % 50).reshape(5, 6, 7)
    top = tmp_path / "s.zarr"
    old_array(top / "blosc", v.astype("<f4"), {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}, lambda b: frame(b.tobytes(), 4, 1, 1, 256, True), (3, 4, 7))
    delta = {"id": "delta", "dtype": "<i4", "astype": "<i2"}
    old_array(top / "delta", v.astype("<i4"), {"id": "zlib", "level": 1}, lambda b: zlib.compress(np.diff(b.ravel(), prepend=0).astype("<i2").tobytes()), (5, 3, 4), [delta])
    scaled = {"id": "fixedscaleoffset", "offset": 1.5, "scale": 4, "dtype": "<f4", "astype": "<u1"}
    old_array(top / "scaled", v.astype("<f4") + np.float32(1.5), None, lambda b: np.round((b - 1.5).clip(0) * 4).astype("<u1").tobytes(), (5, 6, 7), [scaled])
    old_array(top / "both", v.astype("<i4"), None, lambda b: shuffled(np.diff(b.ravel(), prepend=0).astype("<i4").tobytes(), 4, False), (5, 6, 7), [{"id": "delta", "dtype": "<i4"}, {"id": "shuffle", "elementsize": 4}])
    for name, plus in (("blosc", 0), ("delta", 0), ("scaled", 1.5), ("both", 0)):
        assert np.allclose(array(zarr.load_volume(spark, str(top), name), v.shape), v + plus), name


@pytest.mark.parametrize("at_end", [True, False])
def test_shards_read_by_ranges(spark, tmp_path, at_end, monkeypatch):
    import zstandard

    ship(spark)
    shape, outer, inner = (8, 9, 10), (8, 6, 10), (4, 3, 5)
    v = np.random.default_rng(1).random(shape).astype("<f4")
    top = tmp_path / "s.zarr" / "v"
    top.mkdir(parents=True)
    order = [2, 0, 1]
    config = {"chunk_shape": inner, "index_location": "end" if at_end else "start", "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}],
              "codecs": [{"name": "transpose", "configuration": {"order": order}}, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {}}]}
    meta = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": outer}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": -1, "codecs": [{"name": "sharding_indexed", "configuration": config}], "attributes": {}}
    (top / "zarr.json").write_text(json.dumps(meta))
    want = v.copy()
    for s in np.ndindex(1, 2, 1):
        index, body, head = [], b"", 0 if at_end else 16 * 8 + 4
        for c in np.ndindex(2, 2, 2):
            lo = [a * o + b * i for a, o, b, i in zip(s, outer, c, inner)]
            if c == (1, 0, 1) or any(a >= n for a, n in zip(lo, shape)):
                index += [zarr.ABSENT, zarr.ABSENT]
                want[tuple(slice(a, a + i) for a, i in zip(lo, inner))] = -1
                continue
            block = np.zeros(inner, "<f4")
            part = v[tuple(slice(a, a + i) for a, i in zip(lo, inner))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            packed = zstandard.ZstdCompressor().compress(block.transpose(order).tobytes())
            index += [head + len(body), len(packed)]
            body += packed
        raw = struct.pack(f"<{len(index)}Q", *index) + b"\0\0\0\0"
        path = top / "c" / "/".join(map(str, s))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body + raw if at_end else raw + body)
    store = str(tmp_path / "s.zarr")
    t = zarr.load_volume(spark, store, "v")
    assert np.allclose(array(t, shape), want) and t.rdd.getNumPartitions() == 2
    blocks = zarr.load(spark, store, "v", form="blocks").collect()
    assert len(blocks) == 12 and all(len(b.data) == 4 * b.nz * b.ny * b.nx for b in blocks)
    reader = zarr._Reader({"path": store, "array": "v", "crop": "2,2,2"})
    got = []
    monkeypatch.setattr(zarr, "read_range", lambda store, name, offset, length, read=zarr.read_range: got.append(length) or read(store, name, offset, length))
    rows = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(rows) == 8 and len(got) <= 2 * 3 + 8 and max(got) < 400


def test_regions_open_their_chunks_alone(spark, tmp_path):
    ship(spark)
    v = np.random.default_rng(2).random((8, 12, 12)).astype(np.float32)
    store = str(tmp_path / "f.zarr")
    zarr.write_array(store, "v", v, (2, 4, 4))
    zarr.write_array(store, "flow", np.stack([v, v, v]), (3, 2, 4, 4))
    any_ = (None, None)
    cases = [(None, 36), (((2, 4), any_, any_), 9), (((3, 4), (5, 6), (8, None)), 1), ((any_, any_, (1, 3)), 12), (((100, None), any_, any_), 1), (((3, 2), any_, any_), 1), ((any_, (None, 4), (4, 99)), 8)]
    for region, chunks in cases:
        for t, shape, lo in ((zarr.load_volume(spark, store, "v", region=region), (8, 12, 12), (0, 0, 0)), (zarr.load_flow(spark, store, "flow", region=region), (8, 12, 12), (0, 0, 0)), (zarr.load_volume(spark, store, "v", (6, 8, 8), region), (6, 8, 8), (1, 2, 2))):
            if lo == (0, 0, 0):
                assert t.rdd.getNumPartitions() == chunks
            cut = tuple(slice(*(r or any_)) for r in region or (any_,) * 3)
            want = v[tuple(slice(o, o + n) for o, n in zip(lo, shape))][cut]
            rows = t.toPandas()
            assert len(rows) == want.size
            got = np.full(shape, np.nan)
            got[rows.z, rows.y, rows.x] = rows["value" if "value" in rows else "dy"]
            assert np.allclose(got[cut], want)
    assert zarr.load(spark, store, "v", form="blocks", region="2:3,,").count() == 9
    with pytest.raises(Exception, match="three ranges"):
        zarr.load(spark, store, "v", region="2:3").count()
