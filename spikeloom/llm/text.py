"""Vectorised text primitives used inside tasks: one numpy pass over the bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 22


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and their offsets; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.binary()) if pa.types.is_string(column.type) else column, b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows, bytes, offsets) of whole texts, about ``limit`` bytes at a time, so that arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = utf8(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the result depends on every bit of the argument."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(seed: int) -> np.uint64:
    """A multiplier for hash number ``seed``."""
    return mix(np.array([seed * 2 + 0x5851F42D4C957F2D], np.uint64))[0] | np.uint64(1)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span, from one running polynomial over the whole slice."""
    base = 0x9E3779B97F4A7C15
    n = len(data)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)])
    letters = mix(np.arange(1, 257, dtype=np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(letters[data] * power[:n])]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * odd(99))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, a run of bytes other than ASCII white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    full = np.flatnonzero(at[1:] > at[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[at[full]] = inside[at[full]]
    last[at[full + 1] - 1] = inside[at[full + 1] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


def per_text(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer values by text number."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 52-bit hash) of every run of ``width`` words; shorter texts are one shingle, empty ones none."""
    start, end, row = words(data, at)
    if not len(start):
        return row, np.zeros(0, np.uint64)
    h = span_hash(data, start, end)
    n = len(h)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        whole += h[k : k + len(whole)] * odd(k)
    fits = row[: len(whole)] == row[width - 1 :] if len(whole) else np.zeros(0, bool)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, n])
    short = size < width
    place = np.arange(n) - np.repeat(first, size)
    steps = np.array([odd(k) for k in range(width)])
    parts = np.where(place < width, h * steps[np.minimum(place, width - 1)], np.uint64(0))
    lone = np.add.reduceat(parts, first)[short] + size[short].astype(np.uint64)
    rows = np.r_[row[: len(whole)][fits], row[first][short]]
    return rows, mix(np.r_[whole[fits], lone]) >> np.uint64(12)


def counted(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, shingle) in order, with how often each occurs; at most 4096 texts."""
    key, n = np.unique((row.astype(np.uint64) << np.uint64(52)) | shingle, return_counts=True)
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), n.astype(np.int64)


def bisected(at: Column, cuts: list[int] | list[bytes], low: int = 0) -> Column:
    """Number of cuts, in order, that are not above ``at``: nested comparisons of logarithmic depth."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(at < F.lit(cuts[mid]), bisected(at, cuts[:mid], low)).otherwise(bisected(at, cuts[mid + 1 :], low + mid + 1))
