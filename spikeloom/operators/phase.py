"""Circular statistics, spike-phase and phase-amplitude coupling from grouped sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.operators.ordered import in_order, stretch
from spikeloom.operators.signals import bin_by
from spikeloom.operators.spikes import UNIT


def circular(df: DataFrame, keys: Sequence[str], phase: str = "phase") -> DataFrame:
    """Count, direction, spread, vector length, Rayleigh p and pairwise phase consistency.

    All follow from n, sum cos and sum sin, so groups combine map-side and no phase pair is formed.
    """
    g = df.groupBy(*keys).agg(F.count(phase).alias("n"), F.sum(F.cos(phase)).alias("c"), F.sum(F.sin(phase)).alias("s"))
    n = F.col("n").cast("double")
    sq = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    r = F.sqrt(sq) / n
    z = sq / n
    small = (
        1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * n * n)
    )
    return g.select(
        *keys, "n",
        F.atan2("s", "c").alias("circ_mean"),
        F.sqrt(F.greatest(-2 * F.log(F.nullif(r, F.lit(0.0))), F.lit(0.0))).alias("circ_std"),
        r.alias("vector_length"),
        F.exp(-z).alias("vector_pval"),
        (F.exp(-z) * F.when(n < 50, small).otherwise(1.0)).alias("rayleigh_pval"),
        F.try_divide(sq - n, n * (n - 1)).alias("ppc"),
    )


# Fitted coefficients of the H-test false-positive probability.
H_LINEAR = (0.9999755, 0.39802)
H_SQUARE = (1.210597, 0.45901, 0.0022900)
H_FLOOR = 4e-8


def h_test(df: DataFrame, keys: Sequence[str], cycle: Column, harmonics: int = 20) -> DataFrame:
    """H statistic over harmonics 1..20, the best number of harmonics and its probability.

    ``cycle`` is the phase in turns.
    """
    k = F.col("k")
    ang = 2 * math.pi * F.col("_x")
    d = df.select(*keys, cycle.alias("_x"))
    sums = [f(F.lit(i) * ang) for i in range(1, harmonics + 1) for f in (F.cos, F.sin)]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    terms = F.array(*[F.struct(F.lit(i + 1).alias("k"), (F.col(f"_s{2 * i}") * F.col(f"_s{2 * i}") + F.col(f"_s{2 * i + 1}") * F.col(f"_s{2 * i + 1}")).alias("q")) for i in range(harmonics)])
    e = g.select(*keys, "n", F.explode(terms).alias("_t")).select(*keys, "n", "_t.k", "_t.q")
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("hc", 2 / F.col("n") * F.sum("q").over(w) - 4 * k + 4)
    best = e.groupBy(*keys).agg(F.max("hc").alias("h"), F.max_by("k", F.struct(F.col("hc"), -k)).alias("m"))
    h = F.col("h")
    fpp = (
        F.when(h <= 23, H_LINEAR[0] * F.exp(-H_LINEAR[1] * h))
        .when(h < 50, H_SQUARE[0] * F.exp(-H_SQUARE[1] * h + H_SQUARE[2] * h * h))
        .otherwise(H_FLOOR)
    )
    return best.withColumn("fpp", fpp)


def ppc_sampled(df: DataFrame, keys: Sequence[str], size: int, iterations: int, seed: int, phase: str = "phase", row_id: str = "spike_id") -> DataFrame:
    """Pairwise consistency of seeded subsamples of ``size`` phases, without replacement.

    A hash of (iteration, row) orders the rows; rows that cannot be among the first ``size`` are
    cut off by their hash before the rest, bounded by ``size``, is ranked.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(n, list(keys)).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "iteration", row_id), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # Expected rank size plus ten deviations: beyond it a row is never among the first ``size``.
    cut = (size + 10 * math.sqrt(size) + 10) / F.col("_n")
    d = d.withColumn("_u", u).where(F.col("_u") <= cut)
    rn = F.row_number().over(Window.partitionBy(*keys, "iteration").orderBy("_u", row_id))
    return circular(d.withColumn("_r", rn).where(F.col("_r") <= size), [*keys, "iteration"], phase).select(*keys, "iteration", "n", "ppc")


def at_samples(spikes: DataFrame, phases: DataFrame, nperseg: int, on: Sequence[str]) -> DataFrame:
    """Phase of the band signal at the sample each spike falls in."""
    return spikes.withColumn("idx", F.expr(f"t div {nperseg}")).join(phases, [*on, "idx"])


def band_average(tf: DataFrame, keys: Sequence[str], freq: str, lo: float, hi: float) -> DataFrame:
    """Complex mean over frequencies strictly inside a band, as phase, amplitude and real part."""
    g = tf.where((F.col(freq) > lo) & (F.col(freq) < hi)).groupBy(*keys).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return g.withColumns({"phase": F.atan2("im", "re"), "amplitude": F.hypot("re", "im")})


def best_frequency(stats: DataFrame, keys: Sequence[str], freq: str, lo: float, hi: float) -> DataFrame:
    """Band summary of per-frequency statistics: circular mean of directions, mean consistency."""
    d = stats.where(F.col(freq).between(lo, hi))
    return d.groupBy(*keys).agg(
        F.atan2(F.avg(F.sin("circ_mean")), F.avg(F.cos("circ_mean"))).alias("circ_mean"),
        F.avg("ppc").alias("ppc"), F.max_by(freq, "ppc").alias("best_freq"),
    )


def modulation_index(df: DataFrame, keys: Sequence[str], phase: Column, amp: Column, steps: int) -> DataFrame:
    """Tort's modulation index of amplitude over phase; null when a bin is empty."""
    b = bin_by(df, keys, phase, amp, steps, -math.pi, math.pi)
    share = F.col("value") / F.col("tot")
    tot = b.groupBy(*keys).agg(F.sum("value").alias("tot"), F.min("value").alias("least"))
    h = b.join(tot, list(keys)).groupBy(*keys).agg(
        F.min("least").alias("least"), F.sum(F.when(F.col("value") > 0, -share * F.log(share))).alias("h")
    )
    return h.select(*keys, F.when(F.col("least") > 0, (math.log(steps) - F.col("h")) / math.log(steps)).alias("mi"))


def coupling_pvalue(df: DataFrame, keys: Sequence[str], phase: Column, amp: Column, steps: int, iterations: int, seed: int, row_id: str, stretches: int = 4) -> DataFrame:
    """Share of shuffles whose range of binned amplitude exceeds the observed one.

    ``stretches`` is the number of tasks a replicate of one group is ranked in.
    """
    d = df.select(*keys, row_id, phase.alias("_p"), amp.alias("_a"))
    spread = lambda x, k: bin_by(x, k, F.col("_p"), F.col("_a"), steps, -math.pi, math.pi).groupBy(*k).agg(
        (F.max("value") - F.min("value")).alias("spread")
    )
    # Shuffling amplitudes over rows equals dealing the bins out again: rows ranked by a seeded
    # hash fill the bins in turn. Ranks are taken per stretch of hash values.
    b = F.floor((F.col("_p") + math.pi) / (2 * math.pi / steps)).cast("int")
    sizes = d.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    cum = sizes.select(*keys, "bin", upto.alias("hi"))
    ranges = cum.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hi", "bin"))).alias("_r"))
    rep = d.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn(
        "_h", F.pmod(F.xxhash64(F.lit(seed), "rep", row_id), F.lit(1 << 52))
    )
    rep = in_order(rep, [*keys, "rep"], "_h", (1 << 52) // stretches, tie=[row_id], index="_rank").join(ranges, list(keys))
    hit = F.filter("_r", lambda x: x["hi"] > F.col("_rank"))[0]["bin"]
    rep = rep.withColumn("_p", (hit + 0.5) * (2 * math.pi / steps) - math.pi)
    null = spread(rep, [*keys, "rep"])
    seen = spread(d, list(keys)).withColumnRenamed("spread", "observed")
    return null.join(seen, list(keys)).groupBy(*keys).agg(
        F.first("observed").alias("cfc_range"), (F.count_if(F.col("spread") > F.col("observed")) / iterations).alias("p")
    )


def phase_synchrony(a: Column, b: Column) -> Column:
    return 1 - F.sin(F.abs(a - b) / 2)


def triggered_average(spikes: DataFrame, sig: DataFrame, window: int, n: int, on: Sequence[str]) -> DataFrame:
    """Mean signal per unit at -window..window samples around its spikes; beyond the ends it counts as zero.

    Spikes are counted per sample first, and each occupied sample's window is cut once, as an array.  Counts are then
    dealt by unit and stretch of ``n`` samples before they are spread over the offsets, so a task sums its own units alone.
    """
    at = spikes.dropna(subset=UNIT).groupBy(*UNIT, *[c for c in on if c not in UNIT], "idx").agg(F.count(F.lit(1)).alias("m"))
    near = at.select(*on, "idx").distinct().withColumn("offset", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    near = near.withColumn("_at", F.col("idx") + F.col("offset")).join(sig.select(*on, F.col("idx").alias("_at"), "v"), [*on, "_at"], "left")
    near = near.groupBy(*on, "idx", "offset").agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("v"))
    near = near.groupBy(*on, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "v"))), lambda x: x["v"]).alias("_w"))
    d = at.join(near, [*on, "idx"], "left").select(
        *UNIT, stretch("idx", n).alias("_part"), "m", F.coalesce("_w", F.array_repeat(F.lit(0.0), 2 * window + 1)).alias("_w")
    )
    d = d.repartition(*UNIT, "_part").select(*UNIT, "m", F.posexplode("_w").alias("_i", "v"))
    s = d.groupBy(*UNIT, (F.col("_i") - window).alias("offset")).agg(F.sum("m").alias("n_spikes"), F.sum(F.col("m") * F.col("v")).alias("_s"))
    return s.select(*UNIT, "offset", "n_spikes", (F.col("_s") / F.col("n_spikes")).alias("mean_v"))
