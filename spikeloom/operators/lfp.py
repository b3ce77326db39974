"""Field-potential events: energy bursts, baselines, oscillation masks, phase discontinuity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from spikeloom.functions import design
from spikeloom.operators.chunks import ARR, CHAN
from spikeloom.operators.ordered import in_order, run_number
from spikeloom.operators.skew import attach, spread_out


def above_baseline(ste: DataFrame, level: Column, gap: int, length: int) -> DataFrame:
    """Runs of samples above the level; shorter pauses than ``gap`` do not end a run. Half-open [start, end)."""
    on = ste.where(F.col("v") > level).select(*CHAN, "idx")
    starts = F.col("_p").isNull() | (F.col("idx") - F.col("_p") > gap)
    runs = in_order(on, CHAN, "idx", length, lag={"_p": "idx"}, running={"run": run_number(starts)})
    return runs.groupBy(*CHAN, "run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).drop("run")


def cut(spans: DataFrame, chunks: DataFrame, size: int, lo: Column, hi: Column, name: str, keep: Sequence[str]) -> DataFrame:
    """Samples [lo, hi) of each span as an array; spans are bounded, so arrays are too."""
    d = spans.select(*CHAN, *keep, F.greatest(lo, F.lit(0)).alias("_lo"), hi.alias("_hi"))
    first, last = F.floor(F.col("_lo") / size), F.floor((F.greatest(F.col("_hi") - 1, F.col("_lo"))) / size)
    p = d.withColumn("chunk", F.explode(F.sequence(first, last))).join(chunks.select(*CHAN, "chunk", "samples"), [*CHAN, "chunk"], "left")
    at = F.col("chunk") * size
    a = F.greatest(F.col("_lo") - at, F.lit(0))
    b = F.least(F.col("_hi") - at, F.coalesce(F.size("samples"), F.lit(0)))
    piece = F.when(b > a, F.slice("samples", (a + 1).cast("int"), (b - a).cast("int"))).otherwise(F.array().cast("array<double>"))
    g = p.groupBy(*CHAN, *keep, "_lo").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("s")))).alias("_p"))
    return g.select(*CHAN, *keep, F.col("_lo").alias(f"{name}_lo"), F.flatten(F.transform("_p", lambda x: x["s"])).alias(name))


def _minima(x, order):
    if len(x) == 0:
        return np.zeros(0, int)
    at = np.arange(len(x))
    keep = np.ones(len(x), bool)
    for k in range(1, order + 1):
        keep &= (x < x[np.minimum(at + k, len(x) - 1)]) & (x < x[np.maximum(at - k, 0)])
    return np.flatnonzero(keep)


def extend_to_minima(spans: DataFrame, ste_chunks: DataFrame, size: int, pre: int, post: int, order: int) -> DataFrame:
    """Move both ends to the nearest local minimum of the energy within pre and post samples."""
    before = cut(spans, ste_chunks, size, F.col("start") - pre, F.col("start"), "pre", ["start", "end"])
    after = cut(spans, ste_chunks, size, F.col("end"), F.col("end") + post, "post", ["start", "end"])

    @F.pandas_udf(LongType())
    def first_min(x: pd.Series) -> pd.Series:
        m = [_minima(np.asarray(a), order) for a in x]
        return pd.Series([int(k[0]) if len(k) else 0 for k in m])

    @F.pandas_udf(LongType())
    def last_min(x: pd.Series) -> pd.Series:
        m = [_minima(np.asarray(a), order) for a in x]
        return pd.Series([int(k[-1]) if len(k) else len(a) for k, a in zip(m, x)])

    d = before.join(after.drop("post_lo"), [*CHAN, "start", "end"])
    return d.select(*CHAN, (F.col("pre_lo") + last_min("pre")).alias("start"), (F.col("end") + first_min("post")).alias("end"))


def merge_overlaps(spans: DataFrame, length: int) -> DataFrame:
    """Coalesce spans that overlap, touch or contain each other.

    Starts and ends are swept in order: a merged span begins where the number of open spans rises
    to one and ends where it falls to zero, so a long span covers all that begin within it.
    """
    starts = spans.select(*CHAN, F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step"))
    ends = spans.select(*CHAN, F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step"))
    swept = in_order(starts.union(ends), CHAN, "at", length, tie=["kind"], running={"open": F.col("step")})
    edges = swept.where(((F.col("kind") == 0) & (F.col("open") == 1)) | (F.col("open") == 0)).select(*CHAN, "at", "kind")
    paired = in_order(edges, CHAN, "at", length, tie=["kind"], lead={"end": "at"})
    return paired.where(F.col("kind") == 0).select(*CHAN, F.col("at").alias("start"), "end")


def find_peaks(x, distance=1.0, prominence=0.0):
    """Indices of local maxima at least ``distance`` apart (higher first) with the given prominence."""
    n = len(x)
    if n < 3:
        return np.zeros(0, int)
    change = np.flatnonzero(np.diff(x)) + 1
    left, right = np.concatenate([[0], change]), np.concatenate([change - 1, [n - 1]])
    h = x[left]
    top = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])) + 1
    peaks = (left[top] + right[top]) // 2
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < math.ceil(distance)
            near[i] = False
            keep[near] = False
    out = []
    for p in peaks[keep]:
        lo = np.flatnonzero(x[:p] > x[p])
        hi = np.flatnonzero(x[p + 1 :] > x[p])
        a = x[(lo[-1] if len(lo) else 0) : p + 1].min()
        b = x[p : p + 1 + (hi[0] if len(hi) else n)].min()
        if x[p] - max(a, b) >= prominence:
            out.append(p)
    return np.array(out, int)


def with_peaks(spans: DataFrame, chunks: DataFrame, size: int, fs: float, at_least: int) -> DataFrame:
    """Spans with enough peaks of the rectified signal, 25 ms apart and as prominent as the span's RMS."""

    @F.pandas_udf(IntegerType())
    def count(x: pd.Series) -> pd.Series:
        arr = [np.asarray(a) for a in x]
        return pd.Series([len(find_peaks(np.abs(a), fs * 0.025, math.sqrt(np.mean(a * a)))) if len(a) else 0 for a in arr], dtype="int32")

    d = cut(spans, chunks, size, F.col("start"), F.col("end"), "x", ["start", "end"])
    return d.where(count("x") >= at_least).select(*CHAN, "start", "end")


def find_bursts(ste: DataFrame, ste_chunks: DataFrame, chunks: DataFrame, size: int, level: Column, fs: float, *, min_len: float, max_len: float,
                gap: float, pre: float, post: float, order: float, peaks: int, length: int) -> DataFrame:
    """Energy bursts: above the level, grown to energy minima, filtered by length, merged, with enough peaks."""
    s = above_baseline(ste, level, int(gap * fs), length)
    s = extend_to_minima(s, ste_chunks, size, int(pre * fs), int(post * fs), int(order * fs))
    s = s.where((F.col("end") - F.col("start")).between(min_len * fs, max_len * fs))
    return with_peaks(merge_overlaps(s, length), chunks, size, fs, peaks)


def baseline_periods(bursts: DataFrame, size: int | None, length: int, channels: DataFrame | None = None) -> DataFrame:
    """Complement of the bursts inside [0, size); of ``channels`` those without bursts are baseline throughout.

    Without a common ``size``, that of each channel is the column ``size`` of ``channels``.
    """
    d = in_order(bursts, CHAN, "start", length, lag={"_pe": "end"}, lead={"_ns": "start"})
    gaps = d.select(*CHAN, F.coalesce("_pe", F.lit(0)).alias("start"), F.col("start").alias("end"), F.col("_pe").isNull().alias("edge"))
    known = channels if size is None else None if channels is None else channels.withColumn("size", F.lit(size).cast("bigint"))
    known = None if known is None else known.select(*CHAN, F.col("size").cast("bigint").alias("size")).distinct()
    last = d.where("_ns is null").select(*CHAN, F.col("end").alias("start"))
    last = last.join(known, CHAN) if size is None else last.withColumn("size", F.lit(size).cast("bigint"))
    tail = last.select(*CHAN, "start", F.col("size").alias("end"), F.lit(True).alias("edge"))
    found = gaps.unionByName(tail).where(~(F.col("edge") & (F.col("start") == F.col("end")))).drop("edge")
    if known is None:
        return found
    quiet = known.join(bursts.select(*CHAN).distinct(), CHAN, "left_anti")
    return found.unionByName(quiet.select(*CHAN, F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end")))


def burst_statistics(bursts: DataFrame, chunks: DataFrame, size: int, fs: float, length: int, nperseg: int = 200) -> DataFrame:
    """Length, onset interval, RMS, flatness and mean interval of troughs of each burst."""
    out = StructType([StructField(c, DoubleType()) for c in ("rms", "flatness", "intra_iei")])

    @F.pandas_udf(out)
    def stats(x: pd.Series) -> pd.DataFrame:
        rows = []
        for a in x:
            a = np.asarray(a)
            rms = math.sqrt(np.mean(a * a))
            parts = [math.sqrt(np.mean(a[i : i + nperseg] ** 2)) for i in range(0, len(a), nperseg)]
            troughs = find_peaks(-a, 1.0, 0.5 * rms)
            iei = float(np.mean(np.diff(troughs)) / fs) if len(troughs) > 1 else None
            rows.append((rms, min(parts) / max(parts) if max(parts) > 0 else None, iei))
        return pd.DataFrame(rows, columns=["rms", "flatness", "intra_iei"])

    d = in_order(bursts, CHAN, "start", length, lead={"_ns": "start"})
    c = cut(d, chunks, size, F.col("start"), F.col("end"), "x", ["start", "end", "_ns"])
    return c.withColumn("_s", stats("x")).select(
        *CHAN, "start", "end", ((F.col("end") - F.col("start")) / fs).alias("len"), ((F.col("_ns") - F.col("start")) / fs).alias("iei"), "_s.*"
    )


def span_spectra(spans: DataFrame, chunks: DataFrame, size: int, fs: float, nfft: int, shortest: int = 200, nw: float = 2.5) -> DataFrame:
    """Multitaper density of each span longer than ``shortest`` samples, on one frequency grid."""
    from spikeloom.operators.spectral import _one_sided, _weighted

    @F.pandas_udf(ARR)
    def run(x: pd.Series) -> pd.Series:
        out, known = [], {}
        for a in x:
            a = np.asarray(a) - np.mean(a)
            if len(a) not in known:
                t, lam = design.dpss(len(a), nw, int(2 * nw))
                known[len(a)] = (t[lam > 0.9], lam[lam > 0.9])
            t, lam = known[len(a)]
            out.append(_one_sided(_weighted(np.fft.fft(t * a, nfft, axis=1), lam, a, "eigen") / fs, nfft))
        return pd.Series(out)

    c = cut(spans, chunks, size, F.col("start"), F.col("end"), "x", ["start", "end"]).where(F.size("x") > shortest)
    return c.select(*CHAN, "start", "end", F.posexplode(run("x")).alias("f", "p")).withColumn("freq", F.col("f") * fs / nfft)


def half_open_bands(psd: DataFrame, keys: Sequence[str], bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Mean power per band [lo, hi)."""
    f = F.col("freq")
    return psd.groupBy(*keys).agg(*[F.avg(F.when((f >= lo) & (f < hi), F.col("p"))).alias(b) for b, (lo, hi) in bands.items()])


def grid_counts(df: DataFrame, keys: Sequence[str], value: str, tol: float, bins: int) -> DataFrame:
    """Linearly binned weights of values on an even grid that reaches tol times the variance beyond the data."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.var_samp(value).alias("_v"), F.count(value).alias("n"))
    lim = lim.select(*keys, "n", (F.col("_lo") - F.col("_v") * tol).alias("lo"), (F.col("_hi") + F.col("_v") * tol).alias("hi"))
    pos = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1)
    d = attach(df, lim, list(keys)).where("hi > lo").withColumn("_x", pos).withColumn("_i", F.floor("_x").cast("int"))
    w = F.col("_x") - F.col("_i")
    both = F.array(F.struct(F.col("_i").alias("i"), (1 - w).alias("w")), F.struct((F.col("_i") + 1).alias("i"), w.alias("w")))
    return d.select(*keys, "n", "lo", "hi", F.explode(both).alias("_b")).groupBy(*keys, "n", "lo", "hi", F.col("_b.i").alias("i")).agg(
        F.sum("_b.w").alias("w")
    )


def isj_bandwidth(weights, span, n):
    """Improved Sheather-Jones bandwidth of binned data (Botev, Grotowski and Kroese 2010)."""
    m = len(weights)
    p = weights / weights.sum()
    ext = np.concatenate([p, p[::-1]])
    a = np.real(np.fft.fft(ext)[:m] * np.exp(-1j * math.pi * np.arange(m) / (2 * m)))
    k2, a2 = np.arange(1, m) ** 2.0, (a[1:] / 2) ** 2

    def gap(t):
        f = 2 * math.pi**14 * np.sum(k2**7 * a2 * np.exp(-k2 * math.pi**2 * t))
        for s in range(6, 1, -1):
            odd = np.prod(np.arange(1, 2 * s, 2.0)) / math.sqrt(2 * math.pi)
            t2 = (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / (n * f)) ** (2 / (3 + 2 * s))
            f = 2 * math.pi ** (2 * s) * np.sum(k2**s * a2 * np.exp(-k2 * math.pi**2 * t2))
        return t - (2 * n * math.sqrt(math.pi) * f) ** -0.4

    lo, hi = 1e-12, 0.1
    if not (gap(lo) < 0 < gap(hi)):
        return 1.06 * span * math.sqrt(max(np.average((np.arange(m) / m) ** 2, weights=p) - np.average(np.arange(m) / m, weights=p) ** 2, 1e-12)) * n**-0.2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) < 0 else (lo, mid)
    return math.sqrt(lo) * span


def density(counts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Biweight kernel density on the grid, one array per key; at most ``bins`` rows per key reach a task."""
    out = StructType([StructField("x", ARR), StructField("y", ARR), StructField("bw", DoubleType())])

    @F.pandas_udf(out)
    def run(cells: pd.Series, lo: pd.Series, hi: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for c, a, b, k in zip(cells, lo, hi, n):
            w = np.zeros(bins + 1)
            for r in c:
                w[r["i"]] += r["w"]
            w = w[:bins]
            bw = isj_bandwidth(w, b - a, k)
            dx = (b - a) / (bins - 1)
            reach = math.sqrt(7) * bw
            half = min(int(reach / dx), bins - 1)
            u = np.arange(-half, half + 1) * dx / reach
            kern = 15 / 16 * (1 - np.minimum(u * u, 1)) ** 2 / reach
            y = np.convolve(w / w.sum(), kern)[half : half + bins] if half else w / w.sum() / dx
            rows.append((np.linspace(a, b, bins), y, bw))
        return pd.DataFrame(rows, columns=["x", "y", "bw"])

    g = spread_out(counts, keys).groupBy(*keys, "n", "lo", "hi").agg(F.collect_list(F.struct("i", "w")).alias("_c"))
    return g.select(*keys, run("_c", "lo", "hi", "n").alias("_d")).select(*keys, "_d.*")


def fixed_baseline(kde: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First grid value above the geometric mean of the density, and the accepted maximum (mean + 3 sd of logs)."""
    d = kde.select(*keys, F.explode(F.arrays_zip("x", "y")).alias("_z")).select(*keys, "_z.x", "_z.y").where("x > 0")
    m = F.sum(F.log10("x") * F.col("y")) / F.sum("y")
    q = F.sum(F.log10("x") * F.log10("x") * F.col("y")) / F.sum("y")
    g = d.groupBy(*keys).agg(m.alias("_m"), F.sqrt(F.greatest(q - m * m, F.lit(0.0))).alias("_sd"))
    lv = d.join(g, list(keys)).groupBy(*keys).agg(F.min(F.when(F.col("x") > F.pow(F.lit(10.0), F.col("_m")), F.col("x"))).alias("level"))
    return lv.join(g, list(keys)).select(*keys, "level", F.pow(F.lit(10.0), F.col("_m") + 3 * F.col("_sd")).alias("ste_max"))


def _basis(idx, n, kind, deg):
    """Basis functions at sample positions: Legendre polynomials or cubic B-splines on even knots."""
    u = idx / max(n - 1, 1)
    if kind == "polynomial":
        return np.polynomial.legendre.legvander(2 * u - 1, deg)
    k = deg + 1
    x = u * k
    j = np.minimum(x.astype(int), k - 1)
    f = x - j
    vals = np.stack([(1 - f) ** 3, 3 * f**3 - 6 * f**2 + 4, -3 * f**3 + 3 * f**2 + 3 * f + 1, f**3], 1) / 6
    out = np.zeros((len(x), k + 3))
    for d in range(4):
        out[np.arange(len(x)), j + d] = vals[:, d]
    return out


def fitted_baseline(chunks: DataFrame, limits: DataFrame, size: int, kind: str, deg: int, threshold: float) -> DataFrame:
    """Least-squares spline or polynomial through samples below ste_max, plus threshold standard deviations.

    Chunks add up their share of the normal equations; only (deg + 4)^2 sums per channel are solved.
    """
    part = ArrayType(StructType([StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("s", DoubleType())]))

    @F.pandas_udf(part)
    def normal(x: pd.Series, chunk: pd.Series, top: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, c, t, k in zip(x, chunk, top, n):
            a = np.asarray(a)
            b = _basis(c * size + np.arange(len(a)), k, kind, deg)
            ok = a < t
            g, r = b[ok].T @ b[ok], b[ok].T @ a[ok]
            ii, jj = np.nonzero(g)
            rows = [{"i": int(i), "j": int(j), "s": float(g[i, j])} for i, j in zip(ii, jj)]
            out.append(rows + [{"i": int(i), "j": -1, "s": float(v)} for i, v in enumerate(r) if v != 0])
        return pd.Series(out)

    @F.pandas_udf(ARR)
    def solve(rows: pd.Series) -> pd.Series:
        out = []
        for c in rows:
            m = max(r["i"] for r in c) + 1
            g, v = np.zeros((m, m)), np.zeros(m)
            for r in c:
                if r["j"] < 0:
                    v[r["i"]] = r["s"]
                else:
                    g[r["i"], r["j"]] = r["s"]
            out.append(np.linalg.lstsq(g, v, rcond=None)[0])
        return pd.Series(out)

    @F.pandas_udf(ARR)
    def evaluate(x: pd.Series, chunk: pd.Series, coef: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(
            [(lambda b: b[:, : len(w)] @ np.asarray(w))(_basis(c * size + np.arange(len(a)), k, kind, deg)) for a, c, w, k in zip(x, chunk, coef, n)]
        )

    total = chunks.groupBy(*CHAN).agg(F.sum(F.size("samples")).alias("_n"))
    d = attach(chunks, total.join(limits.select(*CHAN, "ste_max"), CHAN), CHAN, F.col("chunk"))
    sums = d.select(*CHAN, F.explode(normal("samples", "chunk", "ste_max", "_n")).alias("_e")).groupBy(
        *CHAN, F.col("_e.i").alias("i"), F.col("_e.j").alias("j")
    ).agg(F.sum("_e.s").alias("s"))
    coef = sums.groupBy(*CHAN).agg(F.collect_list(F.struct("i", "j", "s")).alias("_c")).select(*CHAN, solve("_c").alias("_w"))
    b = d.join(coef, CHAN).select(*CHAN, "chunk", evaluate("samples", "chunk", "_w", "_n").alias("base"))
    sd = b.select(*CHAN, F.explode("base").alias("v")).groupBy(*CHAN).agg((F.stddev_pop("v") * threshold).alias("_sd"))
    return b.join(sd, CHAN).select(*CHAN, "chunk", F.transform("base", lambda v: v + F.col("_sd")).alias("base"))


def oscillation_mask(tf_power: DataFrame, keys: Sequence[str], percentile: float = 95.0, multiple: float | None = None,
                     corrected: bool = False) -> DataFrame:
    """Samples whose power exceeds the background: a chi-square quantile, or a fixed multiple.

    The background is the time average per frequency; two degrees of freedom have the closed
    quantile -2 ln(1 - p).
    """
    bg = tf_power.groupBy(*keys).agg(F.avg("p").alias("_bg"), F.count(F.lit(1)).alias("_n"))
    if corrected:
        chan = [k for k in keys if k != "f"]
        bg = bg.join(bg.groupBy(*chan).agg(F.sum("_n").alias("_px")), chan)
    d = attach(tf_power, bg, list(keys), F.col("idx"))
    if multiple is not None:
        level = F.col("_bg") * multiple
    elif corrected:
        level = F.col("_bg") * -F.log(F.lit(1 - percentile / 100) / F.col("_px"))
    else:
        level = F.col("_bg") * -math.log(1 - percentile / 100)
    return d.withColumn("oscillation", F.col("p") > level).drop("_bg", "_n", "_px")


def phase_steps(tf: DataFrame, keys: Sequence[str], window: int, length: int) -> DataFrame:
    """Change of the coherency angle between successive windows of the transform."""
    m = tf.groupBy(*keys, F.expr(f"idx div {window}").alias("w")).agg(
        F.avg("re").alias("re"), F.avg("im").alias("im"), F.count(F.lit(1)).alias("_k")
    ).where(F.col("_k") == window)
    d = in_order(m, keys, "w", length, lag={"pr": "re", "pi": "im"})
    re = F.col("pr") * F.col("re") + F.col("pi") * F.col("im")
    im = F.col("pi") * F.col("re") - F.col("pr") * F.col("im")
    d = d.where("pr is not null").withColumn("angle", F.atan2(im, re))
    d = in_order(d, keys, "w", length, lag={"_a": "angle"})
    return d.where("_a is not null").select(*keys, "w", (F.col("angle") - F.col("_a")).alias("step"))


def discontinuity_index(steps: DataFrame, keys: Sequence[str], tol: float = 0.01, bins: int = 1024) -> DataFrame:
    """Density mass of phase steps beyond pi/5 over the mass within."""
    kde = density(grid_counts(steps, keys, "step", tol, bins), keys, bins)
    d = kde.select(*keys, F.explode(F.arrays_zip("x", "y")).alias("_z")).select(*keys, "_z.x", "_z.y")
    far = F.abs("x") > math.pi / 5
    return d.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(far, F.col("y")).otherwise(0.0)), F.sum(F.when(~far, F.col("y")).otherwise(0.0))).alias("pdi")
    )


def channel_summary(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of bursts and mean and deviation of each burst measure per channel."""
    return stats.groupBy(*CHAN).agg(
        F.count(F.lit(1)).alias("n_bursts"),
        *[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))],
    )


def derivative_baseline(ste_chunks: DataFrame, size: int, weights: Sequence[float], threshold: float) -> DataFrame:
    """Running sum of the smoothed gradient of the energy, plus threshold standard deviations."""
    from spikeloom.operators.chunks import fir, to_long

    # Smoothing and gradient are one kernel; the running sum adds chunk totals of earlier chunks.
    smooth = fir(ste_chunks, size, np.convolve(weights, [0.5, 0.0, -0.5]), len(weights) // 2 + 1, edge="odd")
    d = in_order(to_long(smooth, size), CHAN, "idx", size, running={"base": F.col("v")})
    sd = d.groupBy(*CHAN).agg((F.stddev_pop("base") * threshold).alias("_sd"))
    return attach(d, sd, CHAN, F.col("idx")).select(*CHAN, "idx", (F.col("base") + F.col("_sd")).alias("base"))
