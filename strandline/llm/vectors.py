"""Helpers for tables of vectors: sound rows as integer matrices by length, and small keys for whole vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = float(2**52)  # scaled components are below it, so floor, shift and difference are exact in doubles and longs


def floored(lists: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row numbers, floor(scale * x) as an integer matrix), one for each length of vector. Rows whose vector is
    null, empty, or holds a null, a non-finite component or one of 2^52 and more after scaling are left out."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * float(scale))
        bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < LIMIT))])
    sound = (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    for size in np.unique(sizes[sound]):
        rows = np.flatnonzero(sound & (sizes == size))
        at = starts[rows][:, None] + np.arange(size)[None, :]
        yield rows, values[at].astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them all."""
    least, most = int(x.min(initial=0)), int(x.max(initial=0))
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def keys_of(x: np.ndarray) -> pa.Array:
    """A binary key for each row of an integer matrix, the same for equal rows and for these only: the width of a
    component that the row needs, then its components."""
    most = np.maximum(x.max(axis=1), ~x.min(axis=1))
    width = np.select([most < 2**7, most < 2**15, most < 2**31], [1, 2, 4], 8)
    out = np.empty(len(x), object)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        body = np.ascontiguousarray(x[at].astype(f"<i{w}")).view(np.uint8).reshape(len(at), -1)
        block = np.concatenate([np.full((len(at), 1), w, np.uint8), body], axis=1)
        out[at] = [row.tobytes() for row in block]
    return pa.array(out.tolist(), pa.binary())


def matrices(keys: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row numbers, integer matrix) of keys made by ``keys_of``, one for each length of vector."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    raw = keys.to_pylist()
    shape = np.array([(k[0], len(k) - 1) for k in raw], np.int64).reshape(-1, 2)
    for w, n in np.unique(shape, axis=0):
        rows = np.flatnonzero((shape == (w, n)).all(axis=1))
        joined = np.frombuffer(b"".join(raw[i][1:] for i in rows), f"<i{w}")
        parts.setdefault(int(n // w), []).append((rows, joined.reshape(len(rows), -1).astype(np.int64)))
    for found in parts.values():
        yield np.concatenate([r for r, _ in found]), np.concatenate([m for _, m in found])
