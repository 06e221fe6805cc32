"""Texts of an Arrow batch as one byte array, and hashes of byte ranges by prefix sums; whole batches at a time."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Keeps the first n bytes of eight that are read as one number.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 1 << 12


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and PRIME**-i modulo 2**64 for i < n."""
    inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
    up, down = np.full(n, PRIME), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint8 of all texts one after another, and the n + 1 offsets. The column has no nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(1 << max(16, int(len(data) + 1).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal bytes and lengths, wherever they stand."""
    _, down = powers(1 << max(16, int(len(sums)).bit_length()))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, eight at a time, each step mixed before the next, so that no sums of powers can cancel out.

    Words hold no zero bytes. Long ones, which would take many steps, are hashed by BLAKE2.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = (end - start).astype(np.uint64) * PRIME
    left = np.flatnonzero((end > start) & (end - start <= LONG_WORD))
    at, stop, h = start[left], end[left], out[left]
    while len(left):
        h = mix(h ^ eight[at] & FIRST_BYTES[np.minimum(stop - at, 8)])
        out[left] = h
        at = at + 8
        more = at < stop
        left, at, stop, h = left[more], at[more], stop[more], h[more] * PRIME
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def slices(batch: pa.RecordBatch, text: str, size: int = 2_000_000):
    """Runs of whole rows with about `size` bytes of text; a longer text comes alone."""
    _, offsets = bytes_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
