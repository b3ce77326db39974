"""Spectral estimates from windows of chunked channels; averages are grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from spikeloom.functions import design
from spikeloom.operators.chunks import CHAN, power
from spikeloom.operators.skew import spread_out

ARR = ArrayType(DoubleType())
PAIR = StructType([StructField("re", ARR), StructField("im", ARR)])


def _one_sided(p, nfft):
    p = p[: nfft // 2 + 1].copy()
    p[1 : len(p) - (nfft % 2 == 0)] *= 2
    return p


def spectra(segs: DataFrame, win: np.ndarray, nfft: int, detrend: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Windowed Fourier coefficients of each segment as re/im arrays."""

    @F.pandas_udf(PAIR)
    def run(samples: pd.Series) -> pd.DataFrame:
        x = np.stack(samples.to_numpy())
        if detrend:
            x = x - x.mean(axis=1, keepdims=True)
        z = np.fft.rfft(x * win, nfft, axis=1)
        return pd.DataFrame({"re": list(z.real), "im": list(z.imag)})

    return segs.select(*CHAN, *keep, "segment", run("samples").alias("_z")).select(*CHAN, *keep, "segment", "_z.re", "_z.im")


def spectra_long(z: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return z.select(*CHAN, *keep, "segment", F.posexplode(F.arrays_zip("re", "im")).alias("f", "_z")).select(
        *CHAN, *keep, "segment", "f", "_z.re", "_z.im"
    )


def welch(segs: DataFrame, nfft: int, fs: float, win: np.ndarray, scaling: str = "density", detrend: bool = True) -> DataFrame:
    """One-sided mean periodogram per channel and frequency number f (f * fs / nfft Hz)."""
    scale = 1.0 / (fs * float((win * win).sum())) if scaling == "density" else 1.0 / float(win.sum()) ** 2
    double = F.when((F.col("f") == 0) | ((F.col("f") == nfft // 2) & F.lit(nfft % 2 == 0)), 1.0).otherwise(2.0)
    d = spectra_long(spectra(segs, win, nfft, detrend))
    return d.groupBy(*CHAN, "f").agg((F.avg(power()) * F.lit(scale)).alias("p")).withColumn("p", F.col("p") * double).withColumn(
        "freq", F.col("f") * fs / nfft
    )


def _weighted(yk, lam, x, method):
    """Taper weights: unity, eigen, or adaptive (Thomson 1982)."""
    sk = np.abs(yk) ** 2
    if method == "unity":
        return sk.mean(axis=0)
    if method == "eigen":
        return (lam[:, None] * sk).sum(axis=0) / lam.sum()
    var = float(np.mean(x * x))
    s = sk[:2].mean(axis=0)
    for _ in range(150):
        d = np.sqrt(lam)[:, None] * s / (lam[:, None] * s + (1 - lam[:, None]) * var + 1e-300)
        new = (d * d * sk).sum(axis=0) / (d * d).sum(axis=0)
        done = np.mean(np.abs(new - s)) < 5e-4 * var / len(s)
        s = new
        if done:
            break
    return s


def multitaper(segs: DataFrame, nperseg: int, nfft: int, fs: float, nw: float = 2.5, k: int | None = None, method: str = "eigen",
               low_bias: bool = True, jackknife: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One-sided multitaper density of each segment; optional jackknife variance of its log."""
    tapers, lam = design.dpss(nperseg, nw, k or int(2 * nw))
    if low_bias:
        tapers, lam = tapers[lam > 0.9], lam[lam > 0.9]
    both = StructType([StructField("p", ARR), StructField("jack", ARR)])

    @F.pandas_udf(both)
    def run(samples: pd.Series) -> pd.DataFrame:
        ps, js = [], []
        for x in samples:
            x = np.asarray(x) - np.mean(x)
            yk = np.fft.fft(tapers * x, nfft, axis=1)
            s = _one_sided(_weighted(yk, lam, x, method) / fs, nfft)
            ps.append(s)
            if jackknife:
                m = len(lam)
                loo = [np.log(_one_sided(_weighted(np.delete(yk, i, 0), np.delete(lam, i), x, method) / fs, nfft)) for i in range(m)]
                js.append((m - 1) / m * np.sum((np.array(loo) - np.mean(loo, axis=0)) ** 2, axis=0))
            else:
                js.append(None)
        return pd.DataFrame({"p": ps, "jack": js})

    d = segs.select(*CHAN, *keep, "segment", run("samples").alias("_s")).select(*CHAN, *keep, "segment", "_s.p", "_s.jack")
    if jackknife:
        return d.select(*CHAN, *keep, "segment", F.posexplode(F.arrays_zip("p", "jack")).alias("f", "_x")).select(
            *CHAN, *keep, "segment", "f", "_x.p", "_x.jack"
        )
    return d.select(*CHAN, *keep, "segment", F.posexplode("p").alias("f", "p"))


def band_power(psd: DataFrame, keys: Sequence[str], bands: Mapping[str, tuple[float, float]], log: bool = True, how: str = "sum") -> DataFrame:
    """Sum or mean of (log10) power per band, both edges included."""
    v = F.log10("p") if log else F.col("p")
    agg = F.sum if how == "sum" else F.avg
    return psd.groupBy(*keys).agg(
        *[agg(F.when(F.col("freq").between(lo, hi), v)).alias(b) for b, (lo, hi) in bands.items()]
    )


def trapezoid_power(psd: DataFrame, keys: Sequence[str], lo: float, hi: float, df: float) -> DataFrame:
    """Trapezoid integral of the density over [lo, hi]; null below two points.

    Frequencies are evenly spaced, so each point weighs df and the two ends half of it.
    """
    d = psd.where(F.col("freq").between(lo, hi)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("p").alias("_s"), F.min_by("p", "freq").alias("_a"), F.max_by("p", "freq").alias("_b")
    )
    return d.select(*keys, F.when(F.col("_k") >= 2, F.lit(df) * (F.col("_s") - (F.col("_a") + F.col("_b")) / 2)).alias("power"))


def aperiodic_fit(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line through log10 power against log10 frequency: offset, exponent (minus slope), r2."""
    x, y = F.log10("freq"), F.log10("p")
    return psd.where("freq > 0 and p > 0").groupBy(*keys).agg(
        F.regr_intercept(y, x).alias("offset"), (-F.regr_slope(y, x)).alias("exponent"), F.regr_r2(y, x).alias("r2")
    )


# Usual tuning constants of the robust estimators.
ANDREW, HUBER, TUKEY, RAMSAY, TRIM, HAMPEL = 1.339, 1.345, 4.685, 0.3, 2.0, (2.0, 4.0, 8.0)


def robust_weights(z, norm):
    """Weights of scaled residuals for the named M-estimator."""
    a = np.abs(z)
    safe = np.maximum(a, 1e-300)
    if norm == "andrew":
        return np.where(a < math.pi * ANDREW, np.sinc(z / ANDREW / math.pi), 0.0)
    if norm == "huber":
        return np.minimum(1.0, HUBER / safe)
    if norm == "tukey":
        return np.where(a < TUKEY, (1 - (z / TUKEY) ** 2) ** 2, 0.0)
    if norm == "ramsay":
        return np.exp(-RAMSAY * a)
    if norm == "trimmed":
        return (a <= TRIM).astype(float)
    if norm == "hampel":
        lo, mid, hi = HAMPEL
        return np.select([a <= lo, a <= mid, a <= hi], [1.0, lo / safe, lo * (hi - a) / (hi - mid) / safe], 0.0)
    if norm == "least_squares":
        return np.ones_like(z)
    raise ValueError(f"unknown estimator {norm}")


def robust_line(psd: DataFrame, keys: Sequence[str], norm: str = "andrew", rounds: int = 30) -> DataFrame:
    """Robust line of log10 power over frequency by reweighted least squares.

    One spectrum (a bounded number of frequencies) is one row; residuals are scaled by their
    median absolute deviation.
    """
    return robust_lines(psd, keys, [norm], rounds).drop("estimator")


def robust_lines(psd: DataFrame, keys: Sequence[str], norms: Sequence[str], rounds: int = 30) -> DataFrame:
    """``robust_line`` by every named estimator, in one pass over the spectra: a row per key and ``estimator``."""
    point = F.struct(F.col("freq").alias("x"), F.log10("p").alias("y"))
    pts = spread_out(psd.where("p > 0"), keys).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_p"))
    line = StructType([StructField("estimator", StringType()), StructField("slope", DoubleType()), StructField("intercept", DoubleType())])

    def fit(x: np.ndarray, y: np.ndarray, norm: str) -> np.ndarray:
        """Lines of spectra of one length, a row each; a spectrum whose residuals vanish is done."""
        a, w = np.stack([x, np.ones(x.shape)], 2), np.ones(x.shape)
        beta, on = np.zeros((len(x), 2)), np.arange(len(x))
        for _ in range(rounds):
            root = np.sqrt(w[on])
            inverse = np.linalg.pinv(a[on] * root[..., None], rcond=np.finfo(float).eps * max(a.shape[1:]))
            beta[on] = (inverse @ (y[on] * root)[..., None])[..., 0]
            r = y[on] - (a[on] @ beta[on][..., None])[..., 0]
            s = np.median(np.abs(r), axis=1) / 0.6744897501960817
            on, r, s = on[s != 0], r[s != 0], s[s != 0]
            if not len(on):
                break
            w[on] = robust_weights(r / s[:, None], norm)
        return beta

    @F.pandas_udf(ArrayType(line))
    def fits(pts: pd.Series) -> pd.Series:
        out, sizes = [None] * len(pts), np.array([len(rows) for rows in pts])
        for n in np.unique(sizes):
            same = np.flatnonzero(sizes == n)
            for at in np.array_split(same, -(-len(same) // 1024)):
                x, y = (np.array([[r[c] for r in pts.iloc[i]] for i in at]) for c in ("x", "y"))
                betas = [fit(x, y, norm) for norm in norms]
                for k, i in enumerate(at):
                    out[i] = [dict(zip(line.names, (norm, *map(float, b[k])))) for norm, b in zip(norms, betas)]
        return pd.Series(out)

    return pts.select(*keys, F.explode(fits("_p")).alias("_f")).select(*keys, "_f.*")


def cross_spectra(z: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Segment-averaged auto and cross spectra of every channel pair of a group."""
    s = spectra_long(z, group)
    a = s.withColumnsRenamed({"channel": "c1", "re": "ar", "im": "ai"})
    b = s.withColumnsRenamed({"channel": "c2", "re": "br", "im": "bi"})
    keys = ["recording_id", *group, "segment", "f"]
    return a.join(b, keys).where("c1 < c2").groupBy("recording_id", *group, "c1", "c2", "f").agg(
        F.avg(power("ar", "ai")).alias("sxx"), F.avg(power("br", "bi")).alias("syy"),
        F.avg(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"),
        F.avg(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("im"),
    )


def coherence(cross: DataFrame) -> DataFrame:
    """Coherency and the coherence measures derived from it."""
    root = F.sqrt(F.col("sxx") * F.col("syy"))
    d = cross.withColumns({"coh_re": F.try_divide("re", root), "coh_im": F.try_divide("im", root)})
    re, im = F.col("coh_re"), F.col("coh_im")
    rest = F.greatest(1 - re * re, F.lit(0.0))
    return d.withColumns(
        {
            "icohere": im * im / (rest + 1e-18),
            "lcohere2019": F.abs(im) / (F.sqrt(rest) + 1e-18),
            "icohere2019": F.abs(im),
            "mscohere1": re * re + im * im,
            "mscohere2": F.sqrt(re * re + im * im),
        }
    )


def phase_lag_values(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Phase-locking value, its imaginary part, and the corrected imaginary part."""
    x = a.select(*keys, "idx", F.atan2("im", "re").alias("_a"))
    y = b.select(*keys, "idx", F.atan2("im", "re").alias("_b"))
    d = x.join(y, [*keys, "idx"]).withColumn("_d", F.col("_a") - F.col("_b"))
    g = d.groupBy(*keys).agg(F.avg(F.cos("_d")).alias("c"), F.avg(F.sin("_d")).alias("s"))
    return g.select(
        *keys, F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("plv"), F.abs("s").alias("iplv"),
        F.coalesce(F.try_divide(F.abs("s"), F.sqrt(F.greatest(1 - F.col("c") * F.col("c"), F.lit(0.0)))), F.lit(0.0)).alias("ciplv"),
    )


def phase_slope(coh: DataFrame, keys: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Imaginary part of sum conj(c[f]) c[f+1] over frequencies strictly inside the band."""
    w = Window.partitionBy(*keys).orderBy("f")
    d = coh.where((F.col("freq") > lo) & (F.col("freq") < hi)).select(
        *keys, "coh_re", "coh_im", F.lead("coh_re").over(w).alias("nr"), F.lead("coh_im").over(w).alias("ni")
    )
    return d.groupBy(*keys).agg(F.sum(F.col("coh_re") * F.col("ni") - F.col("coh_im") * F.col("nr")).alias("psi"))


def irasa(blocks: DataFrame, nperseg: int, fs: float, factors: Sequence[float], band: tuple[float, float]) -> DataFrame:
    """Aperiodic and periodic power by irregular resampling (Wen & Liu 2016).

    Works on bounded blocks of a channel; the spectra of the blocks are averaged, so a channel
    of any length spreads over as many tasks as it has blocks.
    """

    def psd(x, f, n):
        win = design.window("hamming", n)
        step = n - n // 2
        segs = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
        segs = (segs - segs.mean(axis=1, keepdims=True)) * win
        p = (np.abs(np.fft.rfft(segs, axis=1)) ** 2).mean(axis=0) / (f * (win * win).sum())
        return np.fft.rfftfreq(n, 1 / f), _one_sided(p, n)

    def stretched(x, m):
        z, n = np.fft.rfft(x), len(x)
        k = min(n, m) // 2 + 1
        y = np.zeros(m // 2 + 1, complex)
        y[:k] = z[:k]
        if min(n, m) % 2 == 0:
            y[k - 1] *= 2 if m < n else (0.5 if m > n else 1)
        return np.fft.irfft(y, m) * m / n

    @F.pandas_udf(ArrayType(StructType([StructField(c, DoubleType()) for c in ("freq", "p", "aperiodic")])))
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for x in samples:
            x = np.asarray(x)
            t = np.arange(len(x))
            x = x - np.polyval(np.polyfit(t, x, 1), t)
            f, p = psd(x, fs, nperseg)
            sel = (f >= band[0]) & (f <= band[1])
            est = []
            for h in factors:
                both = []
                for r in (h, 1 / h):
                    fr, pr = psd(stretched(x, int(round(len(x) * r))), fs * r, int(round(nperseg * r)))
                    both.append(np.interp(f[sel], fr, pr, left=np.nan, right=np.nan))
                est.append(np.sqrt(both[0] * both[1]))
            ap = np.nanmedian(est, axis=0)
            out.append([{"freq": float(a), "p": float(b), "aperiodic": float(c)} for a, b, c in zip(f[sel], p[sel], ap)])
        return pd.Series(out)

    d = blocks.select(*CHAN, F.explode(run("samples")).alias("_r")).select(*CHAN, "_r.*")
    return d.groupBy(*CHAN, "freq").agg(F.avg("p").alias("p"), F.avg("aperiodic").alias("aperiodic")).withColumn(
        "periodic", F.col("p") - F.col("aperiodic")
    )


def superlet_power(tf: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Geometric mean of wavelet magnitudes over the orders of each frequency.

    Fractional orders give the last wavelet a ``weight`` below one.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    size = F.log(F.greatest(F.sqrt(power()), F.lit(1e-300)))
    return tf.groupBy(*keys).agg(F.exp(F.sum(w * size) / F.sum(w)).alias("amplitude")).withColumn(
        "power", F.col("amplitude") * F.col("amplitude")
    )


def superlet_set(freqs: Sequence[float], fs: float, base: float, low: float, high: float, multiplicative: bool = True):
    """Wavelets of an adaptive superlet: orders rise linearly from low to high over the frequencies.

    Returns (frequency number, weight, wavelet) with a fractional weight for the last order.
    """
    f0, f1 = min(freqs), max(freqs)
    out = []
    for i, f in enumerate(freqs):
        order = low + (high - low) * ((f - f0) / (f1 - f0) if f1 > f0 else 0.0)
        for k in range(1, math.ceil(order) + 1):
            cycles = base * k if multiplicative else base + k - 1
            out.append((i, min(1.0, order - (k - 1)), design.morlet(f, fs, n_cycles=cycles)))
    return out


def scale_power(p: Column, scaling: str, fs: float) -> Column:
    """Wavelet power as amplitude, power, density (psd) or amplitude density (asd)."""
    return {"power": p, "amplitude": F.sqrt(p), "psd": p / F.lit(fs), "asd": F.sqrt(p / F.lit(fs))}[scaling]
