"""Words of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
# Longer words are hashed one by one.
_SHORT = 64


def byte_class(chars: bytes, rest: bool = False) -> np.ndarray:
    """A table that is true for the given bytes, and for bytes from 0x80 if ``rest``."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    table[128:] = rest
    return table


# Everything but U+0020 and U+0009 to U+000D; no byte of a longer character is one of these.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
# ASCII letters and digits and all other characters beyond ASCII.
LETTERS = byte_class(
    b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", rest=True
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without NULLs, and each text's bounds in them."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20):
    """Cut a batch into parts of about ``most_bytes`` of text, a row at least."""
    _, bounds = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[at] + most_bytes, "right")) - 1
        end = max(at + 1, min(end, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """Words in text order: hash, hash of the first characters, place and text."""

    hashes: np.ndarray
    prefixes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    first: np.ndarray  # of every text, and the number of words at the end


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit hashes over all bits."""
    h = hashes ^ (hashes >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, prefix: int = 5) -> Words:
    """Runs of bytes of a class within each text, A-Z counting as a-z."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lengths = ends - starts
    hashes = np.full(len(starts), _BASIS)
    prefixes = hashes.copy()
    left = np.flatnonzero(lengths <= _SHORT)
    k = 0
    while len(left):
        byte = _LOWER[data[starts[left] + k]].astype(np.uint64)
        hashes[left] = (hashes[left] ^ byte) * _PRIME
        k += 1
        if k == prefix:
            prefixes[left] = hashes[left]
        left = left[lengths[left] > k]
    short = lengths < prefix
    prefixes[short] = hashes[short]
    for i in np.flatnonzero(lengths > _SHORT):
        lower = _LOWER[data[starts[i] : ends[i]]].tobytes()
        hashes[i] = np.frombuffer(hashlib.blake2b(lower, digest_size=8).digest(), np.uint64)[0]
        head = _BASIS
        for byte in lower[:prefix]:
            head = np.uint64((int(head) ^ byte) * int(_PRIME) & 0xFFFFFFFFFFFFFFFF)
        prefixes[i] = head
    first = np.searchsorted(starts, bounds, "left")
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(mixed(hashes), mixed(prefixes), starts, ends, docs, first)


def word_hash(word: str, prefix: int = 5) -> int:
    """The hash that ``words`` gives a word."""
    column = pa.array([word])
    return int(words(*text_bytes(column), NOT_SPACE, prefix).hashes[0])


def per_text(values: np.ndarray, first: np.ndarray, how: np.ufunc, empty: float = 0) -> np.ndarray:
    """``how`` over the values of each text; ``empty`` for a text without values."""
    n = len(first) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = how.reduceat(values, first[some], axis=0)
    return out
