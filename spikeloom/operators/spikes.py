"""Retrieval, binning, rasters and smoothed rates of sorted spikes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.operators.ordered import in_order, run_number, stretch
from spikeloom.operators.skew import salted_join

UNIT = ["recording_id", "cluster_id"]


def strict_window(spikes: DataFrame, start: int, end: int) -> DataFrame:
    """Spikes strictly inside (start, end)."""
    return spikes.where((F.col("t") > start) & (F.col("t") < end))


def inclusive_window(spikes: DataFrame, start: int, end: int) -> DataFrame:
    """Spikes inside [start, end]; equal bounds mean no bound."""
    return spikes if start == end else spikes.where(F.col("t").between(start, end))


def accepted_only(spikes: DataFrame, units: DataFrame) -> DataFrame:
    return salted_join(spikes, units.where("accepted").select(*UNIT), UNIT, F.col("spike_id"), "left_semi")


def index_to_time(index: str | Column, fs: float, kind: str) -> Column:
    c = F.col(index) if isinstance(index, str) else index
    if kind == "ms":
        return c / F.lit(fs / 1000.0)
    if kind == "sec":
        return c / F.lit(float(fs))
    return c


def trains(spikes: DataFrame, length: int) -> DataFrame:
    """Time-ordered trains, one array per unit and stretch so no array grows with the recording."""
    return (
        spikes.withColumn("stretch", stretch("t", length))
        .groupBy(*UNIT, "stretch")
        .agg(F.array_sort(F.collect_list("t")).alias("times"))
    )


def cluster_templates(spikes: DataFrame) -> DataFrame:
    return spikes.select(*UNIT, "template_id").distinct()


def binary(spikes: DataFrame) -> DataFrame:
    """Samples at which a unit fires; repeats at one sample collapse."""
    return spikes.select(*UNIT, "t").distinct()


def bin_counts(spikes: DataFrame, nperseg: int) -> DataFrame:
    """Sparse counts per unit and bin, after repeats at one sample collapse."""
    return binary(spikes).groupBy(*UNIT, F.expr(f"t div {nperseg}").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def with_spine(counts: DataFrame, units: DataFrame, n_bins: int, keys: Sequence[str] = UNIT) -> DataFrame:
    """Dense counts: every unit and bin, zero where nothing fired."""
    spine = units.select(*keys).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint")))
    )
    return spine.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def raster(spikes: DataFrame, bin_size: int, stop: int, jitter: int = 1, dtype: str = "bool") -> DataFrame:
    """Sparse raster; positions outside the recording clamp into the end bins.

    A jitter above the bin size widens every spike by ceil(jitter / bin) bins on both sides.
    """
    n_bins = math.ceil(stop / bin_size)
    b = F.least(F.greatest(F.expr(f"t div {bin_size}"), F.lit(0)), F.lit(n_bins - 1)).cast("bigint")
    cells = spikes.groupBy(*UNIT, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if dtype == "bool":
        cells = cells.withColumn("n", F.lit(1).cast("bigint"))
    if jitter > 1 and jitter > bin_size:
        r = math.ceil(jitter / bin_size)
        cells = (
            cells.withColumn("bin", F.explode(F.sequence(F.col("bin") - r, F.col("bin") + r)))
            .where(F.col("bin").between(0, n_bins - 1))
            .groupBy(*UNIT, "bin")
            .agg(F.sum("n").alias("n"))
        )
    return cells


def smoothing_window(kind: str, sigma: float, fs: float) -> list[float]:
    """Weights of the rate window: gaussian, exponential, exponential_abi or boxcar."""
    if kind == "gaussian":
        s = sigma * fs
        radius = 4 * s + 0.5
        return [math.exp(-0.5 * (x - radius) ** 2 / (s * s)) for x in range(math.ceil(2 * radius + 1))]
    if kind == "exponential":
        n = int(5 * sigma * fs) * 4
        return [math.exp(-abs(i - (n - 1) / 2) * sigma) for i in range(n)]
    if kind == "exponential_abi":
        n = int(5 * sigma * fs) * 2
        return [0.0] * n + [math.exp(-i * sigma) for i in range(n)]
    return [1.0] * (2 * int(sigma * fs) + 1)


def smoothed_rate(
    counts: DataFrame, weights: Sequence[float], n_bins: int, method: str = "convolve", keys: Sequence[str] = UNIT
) -> DataFrame:
    """Window placed at every spike bin; sparse output (bins no window reaches are absent).

    ``convolve`` adds count x window centred on the bin, ``add`` adds and ``set`` pastes the
    window from its first weight over ``[bin - half, bin + half)``, later bins winning.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    size, half = len(weights), len(weights) // 2
    if method == "convolve":
        reach = counts.select(*keys, "bin", "n", F.posexplode(w).alias("m", "w")).select(
            *keys, (F.col("bin") + F.col("m") - half).alias("out"), "bin", (F.col("n") * F.col("w")).alias("w")
        )
    else:
        half = max(half, 1)
        lo = F.greatest(F.col("bin") - half, F.lit(0))
        reach = (
            counts.where("n > 0")
            .select(*keys, "bin", lo.alias("lo"), F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("m"))
            .select(*keys, (F.col("lo") + F.col("m")).alias("out"), "bin", "m")
            .where(F.col("out") < F.col("bin") + half)
            .withColumn("w", F.when(F.col("m") < size, F.get(w, F.col("m"))).otherwise(F.lit(0.0)))
        )
    reach = reach.where(F.col("out").between(0, n_bins - 1))
    agg = F.max_by("w", "bin") if method == "set" else F.sum("w")
    return reach.groupBy(*keys, F.col("out").alias("bin")).agg(agg.alias("rate"))


def expand(df: DataFrame, count: str) -> DataFrame:
    """Repeat each row ``count`` times."""
    return df.where(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def activity_runs(cells: DataFrame, keys: Sequence[str], n_bins: int, length: int) -> DataFrame:
    """Runs of consecutive positive bins; a run still open at the last bin is not reported."""
    on = cells.where("n > 0")
    starts = F.col("_p").isNull() | (F.col("bin") - F.col("_p") > 1)
    runs = in_order(on, keys, "bin", length, lag={"_p": "bin"}, running={"run": run_number(starts)})
    return (
        runs.groupBy(*keys, "run")
        .agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count(F.lit(1)).alias("length"))
        .where(F.col("last_bin") < n_bins - 1)
    )


def binary_bursts(bursts: DataFrame, nperseg: int, n_bins: int, dt: int = 0) -> DataFrame:
    """Bins covered by bursts, widened by ``dt`` bins on both sides."""
    lo = F.greatest(F.expr(f"start_t div {nperseg}") - dt, F.lit(0))
    hi = F.least(F.expr(f"end_t div {nperseg}") + dt, F.lit(n_bins - 1))
    return bursts.select(*UNIT, F.explode(F.sequence(lo, hi)).alias("bin")).distinct()


def ei_balance(counts: DataFrame, units: DataFrame, n_bins: int) -> DataFrame:
    """Per-bin mean pyramidal minus mean interneuron count, then sum, mean and sd over all bins."""
    kinds = units.groupBy("recording_id").agg(
        F.count_if(F.col("cell_type") == "pyr").alias("n_pyr"), F.count_if(F.col("cell_type") == "int").alias("n_int")
    )
    per_bin = (
        salted_join(counts, units.select(*UNIT, "cell_type"), UNIT, F.col("bin"))
        .groupBy("recording_id", "bin")
        .agg(
            F.sum(F.when(F.col("cell_type") == "pyr", F.col("n")).otherwise(0)).alias("pyr"),
            F.sum(F.when(F.col("cell_type") == "int", F.col("n")).otherwise(0)).alias("inh"),
        )
        .join(kinds, "recording_id")
        .select(
            "recording_id",
            (F.try_divide("pyr", "n_pyr") - F.try_divide("inh", "n_int")).alias("d"),
        )
    )
    mean = F.col("s") / F.lit(n_bins)
    return per_bin.groupBy("recording_id").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q")).select(
        "recording_id",
        F.col("s").alias("balance_sum"),
        mean.alias("balance_mean"),
        F.sqrt(F.greatest(F.col("q") / n_bins - mean * mean, F.lit(0.0))).alias("balance_std"),
    )


