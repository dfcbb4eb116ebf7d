"""Many small values in a few binary ones, so that a shuffle moves blocks and numpy does the rest."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def squeeze(*columns: np.ndarray, kind: str = "<u4") -> bytes:
    """Columns of integers of one length, byte by byte of all values, compressed."""
    wide = np.dtype(kind).itemsize
    return zstandard.compress(b"".join([np.ascontiguousarray(c.astype(kind).view(np.uint8).reshape(-1, wide).T).tobytes() for c in columns]), 1)


def expand(data: bytes, columns: int, kind: str = "<u4") -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(columns, np.dtype(kind).itemsize, -1)
    return [np.ascontiguousarray(p.T).view(kind).ravel() for p in planes]


def framed(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unframed(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<Q", data)
    out, at = [], 8 * (n + 1)
    for size in struct.unpack_from(f"<{n}Q", data, 8):
        out.append(data[at : at + size])
        at += size
    return out
