"""What chunks of stored arrays are packed with: compressors, Blosc frames, and filters over their elements.

Every function takes the packed bytes of one chunk and gives the plain ones; none needs more than that chunk in memory.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

#: Fixed values of the Blosc frame: its header, flag bits, and compressors by number.
HEADER = struct.Struct("<BBBBIII")  # version, compressor's version, flags, bytes of an element, bytes, bytes of a block, bytes of the frame
BYTE_SHUFFLE, COPIED, BIT_SHUFFLE, UNSPLIT = 0x01, 0x02, 0x04, 0x10
BLOSC_CODECS = ("blosclz", "lz4", "snappy", "zlib", "zstd")


def plain(name: str, raw: bytes, size: int) -> bytes:
    """Bytes that a compressor packed without a container of its own; size: how many they were."""
    if name == "zlib":
        return zlib.decompress(raw)
    if name in ("lz4", "snappy", "zstd"):
        return pa.Codec("lz4_raw" if name == "lz4" else name).decompress(raw, size, asbytes=True)
    raise ValueError(f"codec {name} is not supported")


def byte_unshuffled(raw: bytes, item: int) -> bytes:
    """Bytes stored by their place within an element, put back into elements; a rest below one element stays."""
    n = len(raw) // item
    a = np.frombuffer(raw, np.uint8)
    return a[: n * item].reshape(item, n).T.tobytes() + raw[n * item :]


def bit_unshuffled(raw: bytes, item: int) -> bytes:
    """Bits stored by their place within an element, put back into elements, for a multiple of eight elements."""
    n = len(raw) // item
    if n % 8:
        return raw
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, n * item).reshape(item * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T.reshape(n, item * 8), axis=1, bitorder="little").tobytes() + raw[n * item :]


def blosc(raw: bytes) -> bytes:
    """The bytes of a Blosc frame: blocks with their own offsets, each one stream, or one for each byte of an element."""
    version, _, flags, item, size, block, packed = HEADER.unpack_from(raw)
    if packed > len(raw):
        raise ValueError(f"a Blosc frame of {packed} bytes was cut to {len(raw)}")
    if flags & COPIED:
        return raw[HEADER.size : HEADER.size + size]
    codec = flags >> 5
    if version > 2 or codec >= len(BLOSC_CODECS) or codec == 0:
        raise ValueError(f"Blosc frames of version {version} with compressor {BLOSC_CODECS[codec] if codec < len(BLOSC_CODECS) else codec} are not supported")
    n = -(-size // block) if size else 0
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{n}i", raw, HEADER.size)):
        own = min(block, size - i * block)
        # Only whole blocks are split into streams, and only where a stream holds 128 bytes or more.
        parts = item if not flags & UNSPLIT and own == block and 1 < item <= 16 and block // item >= 128 else 1
        streams = []
        for _ in range(parts):
            (length,) = struct.unpack_from("<i", raw, at)
            body = raw[at + 4 : at + 4 + length]
            streams.append(body if length == own // parts else plain(BLOSC_CODECS[codec], body, own // parts))
            at += 4 + length
        whole = b"".join(streams)
        if flags & BYTE_SHUFFLE and item > 1:
            whole = byte_unshuffled(whole, item)
        elif flags & BIT_SHUFFLE:
            whole = bit_unshuffled(whole, item)
        out.append(whole)
    return b"".join(out)


def unpacked(name: str, raw: bytes) -> bytes:
    """Bytes of a chunk before a bytes-to-bytes codec packed them."""
    if name == "crc32c":
        return raw[:-4]
    if name == "gzip":
        return gzip.decompress(raw)
    if name == "zlib":
        return zlib.decompress(raw)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if name == "lz4":  # with its size in front
        return plain("lz4", raw[4:], struct.unpack_from("<I", raw)[0])
    if name == "blosc":
        return blosc(raw)
    raise ValueError(f"codec {name} is not supported")


def unfiltered(name: str, config: dict, a: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Elements before a filter changed them; a: flat, as stored. dtype: of the array, where the filter names none."""
    kind = np.dtype(config.get("dtype", dtype))
    if name == "delta":
        stored = a.view(np.dtype(config.get("astype", kind)))
        return np.cumsum(stored, dtype=kind)
    if name == "fixedscaleoffset":
        stored = a.view(np.dtype(config.get("astype", kind)))
        return (stored / config["scale"] + config["offset"]).astype(kind)
    if name == "shuffle":
        return np.frombuffer(byte_unshuffled(a.tobytes(), config.get("elementsize", 4)), np.uint8)
    raise ValueError(f"filter {name} is not supported")
