"""Vectorised word handling over Arrow text columns.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  All the
white space here is ASCII, so boundaries are found on UTF-8 bytes directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text handled at once inside a Python worker, in bytes.
CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S33
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``limit`` bytes of ``column`` (a single longer row stays whole)."""
    text = batch.column(column)
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows count as empty."""
    text = pc.fill_null(text, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32, count=len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a column of texts: ``array`` (one string per word) and ``bounds`` (first word of each row)."""

    def __init__(self, text: pa.Array, lower_ascii: bool = False):
        raw, offsets = text_bytes(text)
        n = len(raw)
        inside = ~_SPACE[raw]
        first = inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            rows = offsets[:-1][offsets[:-1] < n]
            first[rows] = inside[rows]
        starts = np.flatnonzero(first)
        kept = raw[inside]
        if lower_ascii:
            kept = _LOWER[kept]
        place = np.cumsum(inside) if n else np.zeros(0, np.int64)
        word_at = (place[starts] - 1).astype(np.int32) if len(starts) else np.zeros(0, np.int32)
        word_offsets = np.append(word_at, np.int32(len(kept))).astype(np.int32)
        self.array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(word_offsets), pa.py_buffer(np.ascontiguousarray(kept)))
        self.bounds = np.searchsorted(starts, offsets, side="left")
        self._codes: tuple[np.ndarray, pa.Array] | None = None

    def __len__(self) -> int:
        return len(self.array)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """(code of every word, distinct words of the chunk)."""
        if self._codes is None:
            enc = self.array.dictionary_encode()
            self._codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary
        return self._codes

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        codes, distinct = self.codes()
        table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(distinct))
        return table[codes] if len(codes) else np.zeros(0, np.uint64)


def _odd_powers(width: int) -> np.ndarray:
    return mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (rows are not told apart here)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, k in enumerate(_odd_powers(width)):
        out += words[i : i + n] * k
    return mix64(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of one whole word sequence (used where a row is shorter than a window)."""
    with np.errstate(over="ignore"):
        return mix64(np.array([np.sum(words * _odd_powers(len(words)), dtype=np.uint64) + np.uint64(len(words) * 7919 + 13)]))[0]
