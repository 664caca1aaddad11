"""Packed rows: many small items travel as one binary value per chunk and bucket."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa


def bucket_of(hashed: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the equal range of hashes; follows the order of the hashes."""
    return (((hashed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pieces(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value of the items between each two bounds."""
    flat = np.ascontiguousarray(values)
    step = flat.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * step).astype(np.int32)), pa.py_buffer(flat)])


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many marks as it takes to differ from all of ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
