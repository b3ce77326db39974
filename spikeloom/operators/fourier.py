"""Transforms of whole channels by a distributed four-step Fourier transform.

A channel of n = r * c samples is a matrix of r rows, sample a * c + b in row a and column b.  Blocks of columns
are transformed along the rows, turned by the twiddle factors and dealt anew as blocks of rows, which
are transformed along the columns: row p then holds the frequencies p + r * q.  There the spectrum is changed in
place, and the way back takes the same steps.  A task holds blocks of about BLOCK values, so a channel may be
far longer than what one task holds; a short one (n <= BLOCK) is one row.

r is the largest divisor of n up to its root.  Where none is near (n has a large prime factor), a row has c values and
so has a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spikeloom.operators.chunks import CHAN
from spikeloom.operators.skew import attach
from spikeloom.session import checkpoint

BLOCK = 1 << 18
#: change(z, k, n, keys): new values of the spectrum z at frequencies k of a channel of n samples.
Change = Callable[[np.ndarray, np.ndarray, int, Mapping], np.ndarray]


def grid_of(n: int, block: int) -> tuple[int, int, int, int]:
    """(rows, columns, columns a block, rows a block) of the matrix of a channel of n samples."""
    r = 1 if n <= block else next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    c = n // r
    return r, c, min(c, max(1, block // r)), min(r, max(1, block // c))


def twiddle(n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """exp(-2 pi i p b / n), with the product taken modulo n in whole numbers."""
    return np.exp(-2j * math.pi / n * (np.multiply.outer(rows, columns) % n))


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.LargeListArray.from_arrays(np.cumsum([0] + [len(v) for v in values]), pa.array(flat)).cast(pa.list_(pa.float64()))


def _complex(piece: pa.Scalar) -> np.ndarray:
    return piece["re"].values.to_numpy() + 1j * piece["im"].values.to_numpy()


def _stage(rows: DataFrame, keys: list[str], columns: str, work: Callable) -> DataFrame:
    """``work(keys of the row as a mapping, row)`` yields tuples of ``columns``; the keys go before them."""
    kind = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kind[k]}" for k in keys], columns])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [b.column(k).to_pylist() for k in keys]
            rest = [k for k in b.schema.names if k not in keys]
            held, size = [], 0
            for i in range(b.num_rows):
                head = [h[i] for h in heads]
                for made in work(dict(zip(keys, head)), {k: b.column(k)[i] for k in rest}):
                    held.append((*head, *made))
                    size += sum(len(x) for x in made if isinstance(x, np.ndarray))
                    if size >= BLOCK:
                        yield out(held)
                        held, size = [], 0
            if held:
                yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_lists(list(v)) if pa.types.is_list(f.type) else pa.array(v, f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.mapInArrow(task, schema)


def _gathered(pieces: DataFrame, keys: list[str], part: str, *values: str) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(part, *values))).alias("_p"))


def through_spectrum(chunks: DataFrame, size: int, change: Change, block: int = BLOCK) -> DataFrame:
    """(recording_id, channel, chunk, re, im): every channel with its spectrum changed.

    ``chunks`` are dense from chunk 0 on, ``size`` samples each but the last of a channel.  Every channel is
    transformed at its own length.  Four shuffles of the channel, each in blocks; no chunks: no rows.
    """
    length = chunks.groupBy(*CHAN).agg(F.sum(F.size("samples")).cast("bigint").alias("n")).where("n > 0")
    rows = attach(chunks.select(*CHAN, "chunk", "samples"), length, CHAN, F.col("chunk"))
    key = [*CHAN, "n"]

    def places(n: int, chunk: int) -> np.ndarray:
        return np.arange(chunk * size, min((chunk + 1) * size, n))

    def scatter(keys, row):
        n = keys["n"]
        _, c, wide, _ = grid_of(n, block)
        x = row["samples"].values.to_numpy()
        chunk = row["chunk"].as_py()
        to = places(n, chunk) % c // wide
        for k in np.unique(to):
            yield int(k), chunk, x[to == k]

    def columns_forth(keys, row):
        n = keys["n"]
        r, c, wide, high = grid_of(n, block)
        first = row["cols"].as_py() * wide
        last = min(first + wide, c)
        grid = np.zeros((r, last - first))
        for piece in row["_p"].values:
            at = places(n, piece["chunk"].as_py())
            at = at[(at % c >= first) & (at % c < last)]
            grid[at // c, at % c - first] = piece["x"].values.to_numpy()
        z = np.fft.fft(grid, axis=0) * twiddle(n, np.arange(r), np.arange(first, last))
        for k, p in enumerate(range(0, r, high)):
            part = z[p : p + high].ravel()
            yield k, row["cols"].as_py(), part.real, part.imag

    def rows_through(keys, row):
        n = keys["n"]
        r, c, wide, high = grid_of(n, block)
        k = row["lines"].as_py()
        p = np.arange(k * high, min((k + 1) * high, r))
        z = np.concatenate([_complex(x).reshape(len(p), -1) for x in row["_p"].values], axis=1)
        z = np.fft.fft(z, axis=1)
        at = p[:, None] + r * np.arange(c)
        z = np.fft.ifft(change(z, at, n, keys), axis=1) * twiddle(n, p, np.arange(c)).conj()
        for j, b in enumerate(range(0, c, wide)):
            part = z[:, b : b + wide].ravel()
            yield j, k, part.real, part.imag

    def columns_back(keys, row):
        n = keys["n"]
        r, c, wide, _ = grid_of(n, block)
        first = row["cols"].as_py() * wide
        many = min(first + wide, c) - first
        z = np.concatenate([_complex(x).reshape(-1, many) for x in row["_p"].values], axis=0)
        z = np.fft.ifft(z, axis=0).ravel()
        at = (np.arange(r)[:, None] * c + np.arange(first, first + many)).ravel()
        edge = np.flatnonzero(np.concatenate([[True], at[1:] // size != at[:-1] // size]))
        for a, b in zip(edge, [*edge[1:], len(at)]):
            yield int(at[a] // size), row["cols"].as_py(), z.real[a:b], z.imag[a:b]

    def gather(keys, row):
        n, chunk = keys["n"], row["chunk"].as_py()
        _, c, wide, _ = grid_of(n, block)
        at = places(n, chunk)
        z = np.zeros(len(at), complex)
        for piece in row["_p"].values:
            z[at % c // wide == piece["cols"].as_py()] = _complex(piece)
        yield chunk, z.real, z.imag

    pair = "re array<double>, im array<double>"
    d = _stage(rows, key, "cols int, chunk bigint, x array<double>", scatter)
    d = _stage(_gathered(d, [*key, "cols"], "chunk", "x"), key, f"lines int, cols int, {pair}", columns_forth)
    d = _stage(_gathered(d, [*key, "lines"], "cols", "re", "im"), key, f"cols int, lines int, {pair}", rows_through)
    d = _stage(_gathered(d, [*key, "cols"], "lines", "re", "im"), key, f"chunk bigint, cols int, {pair}", columns_back)
    return _stage(_gathered(d, [*key, "chunk"], "cols", "re", "im"), key, f"chunk bigint, {pair}", gather).drop("n")


def analytic_signal(chunks: DataFrame, size: int, lo: float | None = None, hi: float | None = None, fs: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Analytic signal of whole channels: negative frequencies go, positive ones count twice; optionally a band only."""

    def change(z, k, n, keys):
        gain = np.where((k == 0) | (2 * k == n), 1.0, np.where(2 * k < n, 2.0, 0.0))
        if lo is not None or hi is not None:
            f = np.minimum(k, n - k) * fs / n
            gain = gain * ((f >= (0.0 if lo is None else lo)) & (f <= (math.inf if hi is None else hi)))
        return z * gain

    return through_spectrum(chunks, size, change, block)


#: A prime below 2**31: squares of remainders fit 64 bits, here and in SQL.
PRIME = 2147483647
STEPS = (1013904223, 374761393, 668265263, 1274126177)


def uniform(own: int, k: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for every k, the same wherever and whenever it is drawn: rounds of x(x + 3) + c modulo a prime."""
    x = (k + own) % PRIME
    for c in STEPS:
        x = (x * x + 3 * x + c) % PRIME
    return x / PRIME


def own_number(seed: int, recording, channel) -> int:
    """The number from which a channel draws: the first 28 bits of the md5 digest of its name and the seed."""
    return int(hashlib.md5(f"{seed}/{recording}/{channel}".encode()).hexdigest()[:7], 16)


def surrogate_channels(chunks: DataFrame, size: int, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(recording_id, channel, chunk, samples): whole channels with the amplitudes of their spectrum and random phases.

    The phase of frequency k is a function of (seed, recording, channel, k), so blocks need not share a
    generator.  The mean and, for an even length, the highest frequency are left out.
    """

    def change(z, k, n, keys):
        low = np.minimum(k, n - k)
        turn = 2 * math.pi * uniform(own_number(seed, keys["recording_id"], keys["channel"]), low) * np.where(k == low, 1, -1)
        return np.where((k == 0) | (2 * k == n), 0.0, np.abs(z) * np.exp(1j * turn))

    return through_spectrum(chunks, size, change, block).select(*CHAN, "chunk", F.col("re").alias("samples"))


def band_signals(chunks: DataFrame, size: int, fs: float, bands: Mapping[str, tuple[float, float]], output: str, order: int = 4, block: int = BLOCK) -> DataFrame:
    """(recording_id, channel, band, chunk, samples): the analytic signal of every band-passed channel as phase, power or frequency part.

    Each band is a zero-phase Butterworth filter of the channel, then its whole-channel transform; ``power`` is the
    modulus and ``frequency`` the real part, as the described analysis names them.
    """
    from spikeloom.operators.chunks import filtered

    value = {
        "phase": F.zip_with("im", "re", lambda y, x: F.atan2(y, x)),
        "power": F.zip_with("im", "re", lambda y, x: F.sqrt(x * x + y * y)),
        "frequency": F.col("re"),
    }[output]
    out = None
    for name, (lo, hi) in bands.items():
        z = analytic_signal(checkpoint(filtered(chunks, size, fs, "butterworth_zero", order, lo, hi)), size, block=block)
        d = z.select(*CHAN, F.lit(name).alias("band"), "chunk", value.alias("samples"))
        out = d if out is None else out.unionAll(d)
    return out
