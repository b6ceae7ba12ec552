"""Many hashes at a time between tasks: dealt by value to buckets, with those of a bucket in one row of plain bytes.

A row for each hash would take three times the space and many times the time of the hash itself. The number of buckets is the caller's,
and must grow with the data, so that a bucket fits into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its hashes, ascending) for each bucket that has any. Buckets are equal ranges of hash values."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))])
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, all low bytes first: what is small packs well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def cut(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of an array as binary values, from each edge to the next."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * data.itemsize).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def joined(values: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The other way: all binary values as one array."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary())
    edges = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(edges) or edges[0] == edges[-1]:
        return np.zeros(0, dtype)
    return np.frombuffer(values.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(dtype)


def byte_planes(x: np.ndarray) -> bytes:
    """As planes(), for 64 bits."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_byte_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()
