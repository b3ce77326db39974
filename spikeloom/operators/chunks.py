"""Filters over chunked channels.

A channel is a sequence of fixed-size chunks.  FIR-like work sees the chunk with a bounded
halo of its neighbours.  Recursive filters run as a linear system: each chunk yields its
response from rest and its final state; the states that reach a later chunk are a short
weighted sum, because powers of a stable system die out, so chunks run in parallel and the
result equals the sample-by-sample recursion to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from spikeloom.functions import design
from spikeloom.operators.skew import attach, hot_keys

CHAN = ["recording_id", "channel"]
ARR = ArrayType(DoubleType())
#: Rows whose results a task holds as objects before they are packed.
SLICE = 256


def rows_of(column: pa.Array) -> Iterator:
    """The rows of a column one by one, lists of numbers as views of its values."""
    if not pa.types.is_list(column.type):
        return iter(column.to_numpy(zero_copy_only=False))
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(at[:-1], at[1:]))


def packed(kind: DataType, values: list) -> pa.Array:
    """Arrow form of values: arrays for ``ARR``, sequences for other lists, tuples for structs."""
    if isinstance(kind, StructType):
        return pa.StructArray.from_arrays([packed(f.dataType, [v[i] for v in values]) for i, f in enumerate(kind.fields)], kind.names)
    inner = pa.array(np.concatenate([*values, np.zeros(0)])) if kind == ARR else packed(kind.elementType, [x for v in values for x in v])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), inner)


def by_rows(kind: DataType, one: Callable) -> Callable:
    """``one``, from a row's numbers and arrays to what ``packed`` takes, as a function of Arrow columns.

    Only a slice of results is held as objects; the rest is what Arrow holds of the batch.
    """

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*map(rows_of, columns))
        made = iter(lambda: [one(*r) for r in islice(rows, SLICE)], [])
        parts = [packed(kind, v).cast(to_arrow_type(kind)) for v in made]
        return pa.concat_arrays(parts) if parts else pa.array([], to_arrow_type(kind))

    return run


def array_udf(kind: DataType) -> Callable:
    """Column function of a function of one row (see ``by_rows``)."""
    return lambda one: F.arrow_udf(by_rows(kind, one), kind)


def to_long(chunks: DataFrame, size: int, value: str = "samples") -> DataFrame:
    return chunks.select(
        *[c for c in chunks.columns if c not in ("chunk", "samples", value)], F.col("chunk"), F.posexplode(value).alias("_p", "v")
    ).withColumn("idx", F.col("chunk") * size + F.col("_p")).drop("chunk", "_p")


def to_chunks(sig: DataFrame, size: int) -> DataFrame:
    """Long form with every sample present to chunk form."""
    pieces = F.array_sort(F.collect_list(F.struct("idx", "v")))
    return sig.groupBy(*CHAN, F.expr(f"(idx - pmod(idx, {size})) div {size}").alias("chunk")).agg(F.transform(pieces, lambda x: x["v"]).alias("samples"))


def halo(chunks: DataFrame, size: int, left: int, right: int) -> DataFrame:
    """Each chunk with up to ``left`` samples before and ``right`` after it.

    ``lead`` counts the samples before the chunk and ``n`` its own.
    """
    back, ahead = -(-left // size), -(-right // size)
    d = chunks.select(*CHAN, F.col("chunk").alias("_src"), "samples").withColumn(
        "chunk", F.explode(F.sequence(F.col("_src") - ahead, F.col("_src") + back))
    )
    at = F.col("_src") * size
    lo = F.greatest(F.col("chunk") * size - left - at, F.lit(0))
    hi = F.least((F.col("chunk") + 1) * size + right - at, F.size("samples"))
    d = d.withColumn("_lo", lo).withColumn("_k", hi - lo).where("_k > 0").select(
        *CHAN, "chunk", F.struct("_src", F.slice("samples", (F.col("_lo") + 1).cast("int"), F.col("_k").cast("int")).alias("s")).alias("_p"),
    )
    g = d.groupBy(*CHAN, "chunk").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    own = F.filter("_p", lambda p: p["_src"] == F.col("chunk"))
    before = F.filter("_p", lambda p: p["_src"] < F.col("chunk"))
    return g.where(F.size(own) > 0).select(
        *CHAN, "chunk", F.flatten(F.transform("_p", lambda p: p["s"])).alias("samples"),
        F.aggregate(before, F.lit(0), lambda a, p: a + F.size(p["s"])).alias("lead"),
        F.least(F.size(own[0]["s"]), F.lit(size)).alias("n"),
    )


def _conv(x, w):
    if len(w) <= 64:
        return np.convolve(x, w)
    n = 1 << (len(x) + len(w) - 2).bit_length()
    if np.iscomplexobj(w):
        return np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(w, n))[: len(x) + len(w) - 1]
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(w, n), n)[: len(x) + len(w) - 1]


def fir(chunks: DataFrame, size: int, weights: Sequence[float], shift: int, step: int = 1, edge: str = "zero") -> DataFrame:
    """out[i] = sum_m w[m] x[i + shift - m], every ``step``-th sample of the channel kept.

    Beyond its ends a channel is zero, or mirrored through its end point with ``edge="odd"``.
    """
    w = np.asarray(weights, float)
    left, right = len(w) - 1 - shift, shift

    @array_udf(ARR)
    def run(x: np.ndarray, a: int, k: int, c: int) -> np.ndarray:
        if edge == "odd":
            head, tail = left - a, right - (len(x) - a - k)
            x = np.concatenate([2 * x[0] - x[head:0:-1], x, 2 * x[-1] - x[-2 : -2 - tail : -1]])
            a = left
        y = _conv(x, w)[a + shift : a + shift + k]
        return y[(-c * size) % step :: step]

    return halo(chunks, size, left, right).select(*CHAN, "chunk", run("samples", "lead", "n", "chunk").alias("samples"))


def _system(sos, size):
    """Kernels of a chunk: impulse response, free response, input-to-state map."""
    a, b, c, d = design.state_space(sos)
    order = len(b)
    free, drive = np.empty((size, order)), np.empty((order, size))
    row, col = c.copy(), b.copy()
    for i in range(size):
        free[i] = row
        drive[:, size - 1 - i] = col
        row, col = row @ a, a @ col
    h = np.concatenate([[d], free[: size - 1] @ b])
    return a, h, free, drive


def _steady(sos):
    """State that holds the output of a constant unit input steady."""
    a, b, _, _ = design.state_space(sos)
    return np.linalg.solve(np.eye(len(b)) - a, b)


def _recurse(rows: DataFrame, size: int, sos, direction: int, longest: int) -> DataFrame:
    """Run the recursion along the chunks of each channel.

    ``rows`` has x (input) and s0 (state before the first chunk, zero elsewhere).
    """
    a, h, free, drive = _system(sos, longest)
    order = a.shape[0]
    hop = np.linalg.matrix_power(a, size)
    powers = [np.eye(order)]
    while np.abs(powers[-1]).max() > 1e-18:
        powers.append(powers[-1] @ hop)
    stack = np.array(powers)

    @array_udf(ArrayType(ARR))
    def reach(v: np.ndarray, s: np.ndarray) -> np.ndarray:
        return stack @ (drive[:, longest - len(v) :] @ v + np.linalg.matrix_power(a, len(v)) @ s)

    @array_udf(ARR)
    def respond(v: np.ndarray, s: np.ndarray) -> np.ndarray:
        return _conv(v, h[: len(v)])[: len(v)] + free[: len(v)] @ s

    sent = rows.select(*CHAN, "chunk", F.posexplode(reach("x", "s0")).alias("_off", "_s")).select(
        *CHAN, (F.col("chunk") + direction * (F.col("_off") + 1)).alias("chunk"), "_s"
    )
    got = sent.groupBy(*CHAN, "chunk").agg(F.array(*[F.sum(F.col("_s")[i]) for i in range(order)]).alias("_in"))
    d = rows.join(got, [*CHAN, "chunk"], "left").withColumn("s0", F.coalesce("_in", "s0")).drop("_in")
    return d.withColumn("y", respond("x", "s0"))


def recursive(chunks: DataFrame, size: int, sos: np.ndarray) -> DataFrame:
    """Causal recursive filter from rest."""
    zero = F.array(*[F.lit(0.0)] * (2 * len(sos)))
    rows = chunks.select(*CHAN, "chunk", F.col("samples").alias("x"), zero.alias("s0"))
    return _recurse(rows, size, sos, 1, size).select(*CHAN, "chunk", F.col("y").alias("samples"))


def zero_phase(chunks: DataFrame, size: int, sos: np.ndarray) -> DataFrame:
    """Forward-backward recursive filter with odd extension at both ends of the channel."""
    pad = design.edge_length(sos)
    if pad + size < 1:
        raise ValueError("chunk size must be positive")
    zi = _steady(sos)
    order = len(zi)
    a, _, free, drive = _system(sos, pad)
    ends = chunks.groupBy(*CHAN).agg(F.max("chunk").alias("_last"))
    d = attach(halo(chunks, size, pad + 1, pad + 1), ends, CHAN, F.col("chunk"), hot_keys(chunks, CHAN))
    first, last = F.col("chunk") == 0, F.col("chunk") == F.col("_last")
    both = StructType([StructField("x", ARR), StructField("s0", ARR)])
    through = np.linalg.matrix_power(a, pad)

    @array_udf(both)
    def begin(x: np.ndarray, k: int, m: int, f: bool, e: bool) -> tuple[np.ndarray, np.ndarray]:
        own, s = x[k : k + m], np.zeros(order)
        if f:
            ext = 2 * x[k] - x[k + pad : k : -1]
            s = drive @ ext + through @ (zi * ext[0])
        if e:
            own = np.concatenate([own, 2 * x[-1] - x[-2 : -2 - pad : -1]])
        return own, s

    @array_udf(both)
    def turn(v: np.ndarray, e: bool) -> tuple[np.ndarray, np.ndarray]:
        v, s = v[::-1], np.zeros(order)
        if e:
            s = drive @ v[:pad] + through @ (zi * v[0])
            v = v[pad:]
        return v, s

    fwd = d.select(*CHAN, "chunk", last.alias("_e"), begin("samples", "lead", "n", first, last).alias("_b")).select(
        *CHAN, "chunk", "_e", "_b.x", "_b.s0"
    )
    y = _recurse(fwd, size, sos, 1, size + pad)
    back = y.select(*CHAN, "chunk", turn("y", "_e").alias("_b")).select(*CHAN, "chunk", "_b.x", "_b.s0")
    return _recurse(back, size, sos, -1, size).select(*CHAN, "chunk", F.reverse("y").alias("samples"))


def band_sos(kind: str, order: int, fs: float, highpass=None, lowpass=None) -> np.ndarray:
    make = {"butterworth": design.butterworth, "bessel": design.bessel}[kind]
    return make(order, fs, highpass, lowpass)


def filtered(chunks: DataFrame, size: int, fs: float, kind: str = "butterworth_zero", order: int = 4, highpass=None, lowpass=None,
             high_width=None, low_width=None, window: str = "hann") -> DataFrame:
    """Filter by name: butterworth, bessel (with _zero), fir_zero_1/2, remez_1/2.

    The first of each FIR pair runs forward and backward, the second once with its delay removed.
    """
    base = kind.partition("_zero")[0]
    if base in ("butterworth", "bessel"):
        sos = band_sos(base, order, fs, highpass, lowpass)
        return zero_phase(chunks, size, sos) if kind.endswith("_zero") else recursive(chunks, size, sos)
    if base in ("fir", "remez_1", "remez_2"):
        taps = order if order % 2 else order + 1
        freq, gain = [0.0], [0.0 if highpass else 1.0]
        if highpass:
            freq += [highpass - (high_width or 0.0), highpass]
            gain += [0.0, 1.0]
        if lowpass:
            freq += [lowpass, lowpass + (low_width or 0.0)]
            gain += [1.0, 0.0]
        freq.append(fs / 2)
        gain.append(0.0 if lowpass else 1.0)
        if base == "fir":
            w = design.firwin_shape(taps, freq, gain, fs, design.window(window, taps, periodic=False))
        else:
            w = design.equiripple(taps, freq, gain[::2], fs)
        if kind.endswith("1"):
            # Forward and backward passes in one: the kernel meets its mirror image.
            return fir(chunks, size, np.convolve(w, w[::-1]), taps - 1, edge="odd")
        return fir(chunks, size, w, (taps - 1) // 2)
    raise ValueError(f"unknown filter {kind}")


def notched(chunks: DataFrame, size: int, fs: float, freq: float, q: float, zero: bool = True) -> DataFrame:
    sos = design.notch(freq, q, fs)
    return zero_phase(chunks, size, sos) if zero else recursive(chunks, size, sos)


def downsample(chunks: DataFrame, size: int, fs: float, target: float) -> DataFrame:
    """Anti-aliased decimation by fs // target; chunks keep their number and get shorter."""
    ratio = int(fs // target)
    if ratio <= 1:
        return chunks
    half = 10 * ratio
    return fir(chunks, size, design.firwin_lowpass(2 * half + 1, 1.0 / ratio), half, step=ratio)


def segments(chunks: DataFrame, size: int, nperseg: int, step: int, keep: Sequence[str] = ()) -> DataFrame:
    """Full windows of ``nperseg`` samples every ``step`` samples."""
    at, k = F.col("chunk") * size, F.size("samples")
    lo = F.greatest(F.ceil((at - nperseg + 1) / step), F.lit(0))
    hi = F.floor((at + k - 1) / step)
    d = chunks.withColumn("segment", F.explode(F.sequence(lo, hi))).where(F.col("segment") * step < at + k)
    a = F.greatest(F.col("segment") * step - at, F.lit(0))
    b = F.least(F.col("segment") * step + nperseg - at, k)
    d = d.where(b > a).select(
        *CHAN, *keep, "segment", F.struct("chunk", F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("s")).alias("_p")
    )
    g = d.groupBy(*CHAN, *keep, "segment").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return g.select(*CHAN, *keep, "segment", F.flatten(F.transform("_p", lambda p: p["s"])).alias("samples")).where(
        F.size("samples") == nperseg
    )


def wavelet_bands(chunks: DataFrame, size: int, wavelets: Sequence[np.ndarray]) -> DataFrame:
    """Wavelet transform: one row per chunk and wavelet with real and imaginary arrays."""
    reach = max(len(w) for w in wavelets)
    pair = ArrayType(StructType([StructField("re", ARR), StructField("im", ARR)]))

    @array_udf(pair)
    def run(x: np.ndarray, a: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        ends = [a + (len(w) - 1) // 2 for w in wavelets]
        return [(y.real, y.imag) for y in (_conv(x, w)[s : s + k] for w, s in zip(wavelets, ends))]

    h = halo(chunks, size, reach, reach)
    return h.select(*CHAN, "chunk", F.posexplode(run("samples", "lead", "n")).alias("f", "_z")).select(
        *CHAN, "chunk", "f", "_z.re", "_z.im"
    )


def wavelet_long(tf: DataFrame, size: int) -> DataFrame:
    """Wavelet transform in long form (channel, f, idx, re, im)."""
    return tf.select(*CHAN, "f", "chunk", F.posexplode(F.arrays_zip("re", "im")).alias("_p", "_z")).select(
        *CHAN, "f", (F.col("chunk") * size + F.col("_p")).alias("idx"), "_z.re", "_z.im"
    )


def power(re: str | Column = "re", im: str | Column = "im") -> Column:
    re, im = (F.col(c) if isinstance(c, str) else c for c in (re, im))
    return re * re + im * im
