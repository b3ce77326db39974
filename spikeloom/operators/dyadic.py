"""Dyadic wavelet filter of chunked channels.

Every level halves the signal: a chunk sees a halo of one filter length, mirrored at the ends of the channel, and
gives half as many coefficients, which are cut into chunks of the same size anew.  So all levels together move
about twice the channel, and no task holds more than a chunk and its halo.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spikeloom.functions import design
from spikeloom.operators.acquisition import regular
from spikeloom.operators.chunks import ARR, CHAN
from spikeloom.operators.skew import attach
from spikeloom.session import checkpoint


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(*CHAN).agg(F.sum(F.size("samples")).cast("bigint").alias("n"))


def most_levels(n: int, taps: int) -> int:
    """Levels until a signal of n samples is shorter than the filter."""
    return max(0, int(np.floor(np.log2(n / (taps - 1))))) if n >= taps - 1 else 0


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places of a signal that is continued by its mirror image, end samples repeated."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def pulled(source: DataFrame, size: int, first, last) -> DataFrame:
    """(CHAN, n, chunk, at, samples): for each output chunk the source samples from ``at`` on that it needs.

    ``first`` and ``last`` are columns of a source chunk: the output chunks that need some of it.
    """
    d = source.withColumn("_to", F.explode(F.sequence(first, last)))
    g = d.groupBy(*CHAN, "n", F.col("_to").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("chunk", "samples"))).alias("_p"))
    return g.select(*CHAN, "n", "chunk", (F.col("_p")[0]["chunk"] * size).alias("at"), F.flatten(F.transform("_p", lambda p: p["samples"])).alias("samples"))


def analysis(chunks: DataFrame, size: int, taps: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(approximation, detail) of ``chunks(CHAN, n, chunk, samples)``: coefficient k weighs the samples 2k + 1 - j.

    n becomes the number of coefficients, (n + taps - 1) div 2.
    """
    low, high, _, _ = design.quadrature(taps)
    reach = len(taps)
    pair = StructType([StructField("a", ARR), StructField("d", ARR)])
    half = (size + 1) // 2

    @F.pandas_udf(pair)
    def run(samples: pd.Series, at: pd.Series, chunk: pd.Series, n: pd.Series) -> pd.DataFrame:
        a, d = [], []
        for x, start, c, m in zip(samples, at, chunk, n):
            x = np.asarray(x)
            k = np.arange(c * half, min((c + 1) * half, (m + reach - 1) // 2))
            near = mirrored(2 * k[:, None] + 1 - np.arange(reach), m) - start
            a.append(x[near] @ low)
            d.append(x[near] @ high)
        return pd.DataFrame({"a": a, "d": d})

    # Output chunk c holds the coefficients from c * half on; at the end the mirror reaches back by a filter length.
    step = 2 * half
    lo = F.floor((F.col("chunk") * size - reach) / step)
    hi = F.floor((F.col("chunk") * size + F.size("samples") + reach) / step)
    top = F.floor((F.floor((F.col("n") + reach - 1) / 2) - 1) / half)
    hi = F.when(F.col("chunk") * size + F.size("samples") + 2 * reach >= F.col("n"), top).otherwise(F.least(hi, top))
    got = pulled(chunks, size, F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(0)))
    both = got.select(*CHAN, "n", "chunk", run("samples", "at", "chunk", "n").alias("_z"))
    out = lambda c: regular(both.select(*CHAN, F.floor((F.col("n") + reach - 1) / 2).alias("n"), "chunk", F.col(f"_z.{c}").alias("samples")), F.col("chunk") * half, size, keep=["n"])
    return out("a"), out("d")


def synthesis(approximation: DataFrame, detail: DataFrame, size: int, taps: np.ndarray) -> DataFrame:
    """The signal of ``n`` samples (column of the detail's level above) from its coefficients, cut to ``want`` samples."""
    _, _, low, high = design.quadrature(taps)
    reach = len(taps)
    d = approximation.join(detail.select(*CHAN, "chunk", "want", F.col("samples").alias("_d")), [*CHAN, "chunk"])
    # An approximation from the level below may have one coefficient more than the detail.
    d = d.withColumn("samples", F.zip_with(F.slice("samples", 1, F.size("_d")), "_d", lambda a, b: F.struct(a.alias("a"), b.alias("d"))))

    @F.pandas_udf(ARR)
    def run(a: pd.Series, b: pd.Series, at: pd.Series, chunk: pd.Series, want: pd.Series) -> pd.Series:
        out = []
        for x, y, start, c, m in zip(a, b, at, chunk, want):
            t = np.arange(c * size, min((c + 1) * size, m))
            # Coefficient k reaches sample t with the tap t + reach - 2 - 2k.
            first = (t - 1 + 1) // 2
            k = first[:, None] + np.arange(reach // 2)
            tap = t[:, None] + reach - 2 - 2 * k
            fits = (tap >= 0) & (tap < reach) & (k - start >= 0) & (k - start < len(x))
            k, tap = np.where(fits, k - start, 0), np.where(fits, tap, 0)
            x, y = np.asarray(x), np.asarray(y)
            out.append(((low[tap] * x[k] + high[tap] * y[k]) * fits).sum(axis=1))
        return pd.Series(out)

    at = F.col("chunk") * size
    lo = F.floor((2 * at - reach + 2) / size)
    hi = F.floor((2 * (at + F.size("samples")) + 1) / size)
    top = F.floor((F.col("want") - 1) / size)
    got = pulled(d.withColumn("n", F.col("want")), size, F.greatest(lo, F.lit(0)), F.least(hi, top))
    part = lambda c: F.transform("samples", lambda z: z[c])
    return got.select(*CHAN, "n", "chunk", run(part("a"), part("d"), "at", "chunk", "n").alias("samples"))


def wavelet_filter(chunks: DataFrame, size: int, drop: int, kind: str, n: int, moments: int = 4) -> DataFrame:
    """Channels with parts of their wavelet transform set to zero.

    The parts are the approximation, then the details from coarse to fine.  ``highpass`` zeroes the first ``drop`` of
    them, ``lowpass`` the last ``drop``.  Channels have ``n`` samples each, which sets the number of levels
    (as many as the filter of 2 * moments taps fits); other lengths are refused.
    """
    taps = design.daubechies(moments)
    levels = most_levels(n, len(taps))
    if kind not in ("highpass", "lowpass"):
        raise ValueError(f"unknown filter {kind}")
    if not levels:
        keep = not drop
        return chunks if keep else chunks.withColumn("samples", F.transform("samples", lambda v: v * 0.0))
    zero = set(range(drop)) if kind == "highpass" else set(range(levels + 1 - drop, levels + 1))
    d = attach(chunks.select(*CHAN, "chunk", "samples"), lengths(chunks), CHAN, F.col("chunk"))
    now = d.withColumn("n", F.when(F.col("n") == n, F.col("n")).otherwise(F.raise_error(F.lit("channels of other lengths")).cast("bigint")))
    details = []
    for _ in range(levels):
        now = checkpoint(now)
        low, high = analysis(now, size, taps)
        details.append((high, now.select(*CHAN, F.col("n").alias("want")).distinct()))
        now = low
    none = lambda x: x.withColumn("samples", F.transform("samples", lambda v: v * 0.0))
    now = none(now) if 0 in zero else now
    for level, (high, want) in enumerate(reversed(details), 1):
        high = none(high) if level in zero else high
        now = synthesis(now.drop("n"), attach(high.drop("n"), want, CHAN, F.col("chunk")), size, taps)
    return now.select(*CHAN, "chunk", "samples")
