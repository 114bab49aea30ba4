"""Integers as compressed bytes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers byte plane by byte plane, compressed."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(width, n).T.copy().view(f"<u{width}").ravel().astype(np.int64)


def give_back() -> None:
    """Return what a finished group has left in this worker to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
