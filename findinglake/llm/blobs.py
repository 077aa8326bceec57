"""Packing of numeric arrays into small binary cells.

Text operators here exchange millions of hashes between a chunk of documents and a key range.  One shuffle row
per hash would cost 28 bytes and a JVM object each; a sorted, delta-coded and compressed array per
(chunk, range) costs about five bytes per hash.
"""

from __future__ import annotations

import functools

import numpy as np
import zstandard

_LEVEL = 1

# Cells are small and many, so making these anew for each would take longer than using them.
_compressor = functools.cache(lambda level: zstandard.ZstdCompressor(level=level))
_decompressor = functools.cache(zstandard.ZstdDecompressor)


def pack(array: np.ndarray) -> bytes:
    """Any one-dimensional array as bytes: byte planes, compressed."""
    if array.size == 0:
        return b""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(array.size, array.itemsize).T)
    return _compressor(_LEVEL).compress(planes.tobytes())


def unpack(blob: bytes | None, dtype) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype)
    dtype = np.dtype(dtype)
    planes = np.frombuffer(_decompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(array: np.ndarray) -> bytes:
    """A sorted uint64 array as compressed differences."""
    if array.size == 0:
        return b""
    return pack(np.diff(array, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes | None) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def pack_bytes(data: bytes, level: int = _LEVEL) -> bytes:
    return _compressor(level).compress(data) if data else b""


def unpack_bytes(blob: bytes | None) -> bytes:
    return _decompressor().decompress(blob) if blob else b""
