"""Per-unit interval statistics, adaptation and quality metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from spikeloom.operators.ordered import SEG, in_order, with_reach
from spikeloom.operators.skew import attach
from spikeloom.operators.spikes import UNIT, bin_counts

ORDER = dict(tie=["spike_id"])


def intervals(spikes: DataFrame, length: int, keys: list[str] = UNIT) -> DataFrame:
    """Each spike with the interval to the one before and the interval before that."""
    d = in_order(spikes, keys, "t", length, lag={"_p1": "t"}, lag2={"_p2": "t"}, index="pos", **ORDER)
    return d.withColumns({"isi": F.col("t") - F.col("_p1"), "isi_prev": F.col("_p1") - F.col("_p2")}).drop("_p1", "_p2")


def firing_rate(spikes: DataFrame, duration: float | None = None) -> DataFrame:
    span = F.lit(float(duration)) if duration else (F.max("t") - F.min("t")).cast("double")
    return spikes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spikes"), F.try_divide(F.count(F.lit(1)), span).alias("fr"))


def fano_cv(spikes: DataFrame, nperseg: int, n_bins: int) -> DataFrame:
    """Fano factor and variation of bin counts.

    Empty bins enter through ``n_bins``, so no spine is built.
    """
    c = bin_counts(spikes, nperseg)
    m = F.sum("n") / F.lit(n_bins)
    var = F.sum(F.col("n") * F.col("n")) / F.lit(n_bins) - m * m
    return c.groupBy(*UNIT).agg((var / m).alias("fano_factor"), (F.sqrt(var) / m).alias("cv"))


def local_variation(isi: Column, prev: Column) -> Column:
    """Term of the local variation of intervals (Shinomoto et al. 2003)."""
    return F.try_divide(3 * F.pow(prev - isi, 2), F.pow(prev + isi, 2))


def revised_local_variation(isi: Column, prev: Column, refractory: float) -> Column:
    """Term of the revised local variation (Shinomoto et al. 2009)."""
    both = prev + isi
    return 3 * F.try_subtract(F.lit(1.0), F.try_divide(4 * prev * isi, both * both)) * (
        1 + F.try_divide(F.lit(4.0 * refractory), both)
    )


def adaptation_index(isi: Column, prev: Column) -> Column:
    return F.when((isi == 0) & (prev == 0), 0.0).otherwise(F.try_divide(isi - prev, isi + prev))


def adaptation(iv: DataFrame, keys: list[str], refractory: float) -> DataFrame:
    """Mean interval and the four adaptation measures per sequence, in seconds-free ratios."""
    isi, prev = F.col("isi").cast("double"), F.col("isi_prev").cast("double")
    last = F.max_by("isi", F.struct("t", "spike_id"))
    first = F.min_by("isi", F.when(F.col("isi").isNotNull(), F.struct("t", "spike_id")))
    n_pairs = F.count("isi_prev")
    return iv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_spikes"),
        F.avg("isi").alias("mean_isi"),
        F.avg(local_variation(isi, prev)).alias("local_sfa"),
        F.when(n_pairs > 2, F.avg(revised_local_variation(isi, prev, refractory))).alias("rlocal_sfa"),
        F.when(last > 0, F.try_divide(first.cast("double"), last.cast("double"))).alias("divisor_sfa"),
        F.avg(adaptation_index(isi, prev)).alias("abi_sfa"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )


def isi_violations(spikes: DataFrame, length: int, threshold: float, min_isi: float, duration: float) -> DataFrame:
    """Interval violations after dropping spikes too close to their predecessor."""
    d = in_order(spikes, UNIT, "t", length, lag={"_p": "t"}, **ORDER)
    kept = d.where(F.col("_p").isNull() | (F.col("t") - F.col("_p") > min_isi)).drop("_p")
    d = in_order(kept, UNIT, "t", length, lag={"_p": "t"}, **ORDER)
    nv = F.count_if(F.col("t") - F.col("_p") < threshold)
    n = F.count(F.lit(1)).cast("double")
    rate = nv / (2 * n * F.lit(float(threshold - min_isi)))
    return d.groupBy(*UNIT).agg(
        nv.alias("num_violations"), F.try_divide(rate, n / F.lit(float(duration))).alias("fp_rate")
    )


def rb_violations(spikes: DataFrame, length: int, threshold: int, min_isi: float, duration: float) -> DataFrame:
    """Refractory contamination from the number of spike pairs within the threshold.

    Pairs are counted by a range frame, not emitted; rows within reach of a stretch
    border are seen from both sides.
    """
    d = with_reach(spikes, UNIT, "t", length, 0, threshold)
    w = Window.partitionBy(*UNIT, SEG).orderBy("t")
    d = d.select(
        *UNIT,
        "_own",
        F.count(F.lit(1)).over(w.rangeBetween(0, threshold)).alias("ahead"),
        F.count(F.lit(1)).over(w.rangeBetween(0, 0)).alias("same"),
    ).where("_own")
    n = F.count(F.lit(1))
    pairs = F.expr("sum(2 * (ahead - same) + same - 1) div 2")
    g = d.groupBy(*UNIT).agg(n.alias("n"), pairs.alias("rp_pairs"))
    nd = F.col("n").cast("double")
    q = 1 - F.col("rp_pairs") * (F.lit(float(duration)) - 2 * nd * min_isi) / (nd * nd * F.lit(float(threshold - min_isi)))
    return g.select(
        *UNIT,
        "rp_pairs",
        F.when(q >= 0, 1 - F.sqrt(F.greatest(q, F.lit(0.0)))).otherwise(1.0).alias("rp_contam"),
    )


def presence(spikes: DataFrame, start: int, end: int) -> DataFrame:
    """Share of occupied bins and the trend over bins.

    A unit with n spikes has ceil(n/20) edges over [start, end]; the ratio divides
    occupied bins by the number of edges.  Units with two edges or fewer get zeros.
    """
    per = spikes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("edges", F.ceil(F.col("n") * 0.05).cast("bigint"))
    bins = F.col("edges") - 1
    b = F.least(F.floor((F.col("t") - F.lit(start)) * bins / F.lit(float(end - start))), bins - 1).cast("bigint")
    counts = (
        attach(spikes, per.where("edges > 2"), UNIT, F.col("spike_id"))
        .groupBy(*UNIT, "edges", b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # Sums over all bins 0..m-1; empty bins add nothing to sum(c), sum(bin*c) and sum(c*c).
    m = F.max("edges").cast("double") - 1
    sx, sxx = m * (m - 1) / 2, m * (m - 1) * (2 * m - 1) / 6
    top, side = m * F.sum(F.col("bin") * F.col("c")) - sx * F.sum("c"), m * sxx - sx * sx
    spread = m * F.sum(F.col("c") * F.col("c")) - F.sum("c") * F.sum("c")
    stats = counts.groupBy(*UNIT).agg(
        (F.count(F.lit(1)) / F.max("edges")).alias("presence_ratio"), F.try_divide(top, side).alias("presence_slope"),
        F.try_divide(top * top, side * spread).alias("_r2"), (m - 2).alias("_dof"),
    )
    stats = stats.withColumn("presence_pvalue", slope_pvalue(F.col("_r2"), F.col("_dof"))).drop("_r2", "_dof")
    return per.join(stats, UNIT, "left").select(
        *UNIT,
        F.coalesce("presence_ratio", F.lit(0.0)).alias("presence_ratio"),
        F.coalesce("presence_slope", F.lit(0.0)).alias("presence_slope"),
        F.coalesce("presence_pvalue", F.lit(0.0)).alias("presence_pvalue"),
    )


def slope_pvalue(r2: Column, dof: Column) -> Column:
    """Two-sided p of a regression slope from its r squared: the tail of Student's t.

    With t = sqrt(dof) tan(a) the density is cos(a)^(dof - 1), so the tail is a ratio of
    integrals over angles, evaluated with 400 midpoints.
    """
    steps = 400
    angle = F.asin(F.sqrt(F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0))))
    part = lambda lo: F.aggregate(
        F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0),
        lambda acc, i: acc + F.pow(F.greatest(F.cos(lo + (i + 0.5) * (F.lit(math.pi / 2) - lo) / steps), F.lit(0.0)), dof - 1),
    ) * (F.lit(math.pi / 2) - lo)
    return F.when(dof > 0, part(angle) / part(F.lit(0.0)))


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised gaussian weights out to four sigma."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    s = sum(w)
    return [x / s for x in w]


def amplitude_histogram(spikes: DataFrame, bins: int = 500) -> DataFrame:
    """Equal-width amplitude counts per unit over its own range, last bin closed."""
    lim = spikes.groupBy(*UNIT).agg(
        F.min("amplitude").alias("lo"), F.max("amplitude").alias("hi"), F.count(F.lit(1)).alias("total")
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    b = F.when(F.col("width") > 0, F.floor((F.col("amplitude") - F.col("lo")) / F.col("width"))).otherwise(0)
    return (
        attach(spikes, lim, UNIT, F.col("spike_id"))
        .groupBy(*UNIT, F.least(b, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"), F.first("total").alias("total"), F.first("width").alias("width"))
    )


def amplitude_cutoff(spikes: DataFrame, bins: int = 500, sigma: float = 3.0) -> DataFrame:
    """Estimated share of spikes below the detection floor.

    Works on the bounded histogram (at most ``bins`` rows per unit), collected as one row per unit: smooth with
    mirrored edges, find the peak, then the point right of it closest to the first bin.  Taps are added in
    the order of the window, so equal histograms give equal results.
    """
    w = gaussian_weights(sigma)
    r = len(w) // 2
    k = min(r, bins)

    @F.pandas_udf(DoubleType())
    def cutoff(at: pd.Series, counts: pd.Series, total: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(at), 256):
            wide = width[i : i + 256].to_numpy()
            p = np.zeros((len(wide), bins))
            for row, (x, c, n) in enumerate(zip(at[i : i + 256], counts[i : i + 256], total[i : i + 256])):
                p[row, x] = c / (n * wide[row])
            near = np.zeros((len(wide), bins + 2 * r))
            near[:, r : r + bins], near[:, r - k : r], near[:, r + bins : r + bins + k] = p, p[:, :k][:, ::-1], p[:, bins - k :][:, ::-1]
            pdf = sum(near[:, j : j + bins] * x for j, x in enumerate(w))
            for row, peak in zip(pdf, pdf.argmax(1)):
                out.append(row[peak + np.abs(row[peak:] - row[0]).argmin() :].sum())
        return pd.Series(out, dtype=float) * width.to_numpy()

    h = amplitude_histogram(spikes, bins).where("width > 0").groupBy(*UNIT).agg(
        F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("h"), F.first("total").alias("total"), F.first("width").alias("width")
    )
    return h.select(*UNIT, F.least(cutoff("h.bin", "h.c", "total", "width"), F.lit(0.5)).alias("amp_cutoff"))


def unit_table(
    spikes: DataFrame,
    *,
    length: int,
    stop: int,
    nperseg: int,
    threshold: int,
    refractory: float,
    min_isi: float = 0,
    per_second: float = 1.0,
) -> DataFrame:
    """All quality metrics of a unit in one row.

    Units with two spikes or fewer get zero rates, no violations and contamination one.
    """
    ad = adaptation(intervals(spikes, length), UNIT, refractory)
    n_bins = -(-stop // nperseg)
    many = F.col("n_spikes") > 2
    sec = F.lit(float(per_second))
    out = ad.join(fano_cv(spikes, nperseg, n_bins), UNIT)
    out = out.join(isi_violations(spikes, length, threshold, min_isi, stop), UNIT)
    out = out.join(rb_violations(spikes, length, threshold, min_isi, stop), UNIT)
    out = out.join(presence(spikes, 0, stop), UNIT)
    out = out.join(amplitude_cutoff(spikes), UNIT, "left")
    z = lambda c: F.when(many, c).otherwise(0.0)
    x = lambda c: F.when(many, F.col(c)).alias(c)
    return out.select(
        *UNIT,
        "n_spikes",
        "fano_factor",
        "cv",
        z(F.col("mean_isi") / sec).alias("iei"),
        z(F.try_divide(sec, F.col("mean_isi"))).alias("fr_iei"),
        z(F.col("n_spikes") / (F.lit(float(stop)) / sec)).alias("fr"),
        x("abi_sfa"),
        x("local_sfa"),
        x("rlocal_sfa"),
        x("divisor_sfa"),
        x("fp_rate"),
        x("num_violations"),
        F.when(many, F.col("rp_contam")).otherwise(1.0).alias("rp_contam"),
        "presence_ratio",
        "amp_cutoff",
    )


def narrow_band(correlogram: DataFrame, keys: list[str], bins: int, fs: float) -> DataFrame:
    """Whether a correlogram oscillates more at 50-70 Hz than anywhere in 40-300 Hz; ``bins`` counts per unit."""

    @F.pandas_udf(BooleanType())
    def test(cells: pd.Series) -> pd.Series:
        out = []
        for c in cells:
            x = np.zeros(bins)
            for r in c:
                x[r["bin"]] = r["n"]
            z, f = np.abs(np.fft.rfft(x)), np.fft.rfftfreq(bins, 1 / fs)
            near, wide = z[(f >= 50) & (f <= 70)], z[(f >= 40) & (f <= 300)]
            out.append(bool(len(near) and near.max() >= wide.max() * (1 - 1e-9)))  # equal peaks count, whatever their rounding
        return pd.Series(out)

    return correlogram.groupBy(*keys).agg(F.collect_list(F.struct("bin", "n")).alias("_c")).select(*keys, test("_c").alias("narrow_band"))


def longest_burst_interval(kde: DataFrame, keys: list[str]) -> DataFrame:
    """Interval at which the running mean of the interval density, over its count, is largest."""
    d = kde.select(*keys, F.posexplode(F.arrays_zip("x", "y")).alias("k", "_z")).select(*keys, "k", "_z.x", "_z.y")
    before = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("cma", F.try_divide(F.avg("y").over(before), F.col("k").cast("double")))
    return d.where("cma is not null").groupBy(*keys).agg(F.max_by("x", F.struct("cma", -F.col("k"))).alias("isi_max"))
