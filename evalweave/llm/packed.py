"""Integer columns as compressed bytes, for tables of chunks."""

from __future__ import annotations

import numpy as np
import zstandard


# The tables go to disk and through shuffles, so size counts for more than speed.
_LEVEL = 9


def pack(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Integers as bytes, compressed plane by plane."""
    flat = np.ascontiguousarray(values, kind)
    planes = flat.view(np.uint8).reshape(-1, flat.itemsize).T
    return zstandard.ZstdCompressor(_LEVEL).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str = "<i4") -> np.ndarray:
    """The integers that ``pack`` was given."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_bytes(data: bytes) -> bytes:
    """Compressed bytes."""
    return zstandard.ZstdCompressor(_LEVEL).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    """The bytes that ``pack_bytes`` was given."""
    return zstandard.ZstdDecompressor().decompress(data)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several runs one after another: ``starts[i]`` and the next ``lengths[i] - 1``."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
