"""Spectral queries over embeddings (fs 64 Hz by convention) and hourly counts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.functions import design
from spikeloom.operators import chunks as ch
from spikeloom.operators import spectral as sc
from spikeloom.plans.registry import query

FS, CH = 64.0, 16
NP, STEP = 32, 16
HANN = design.window("hann", NP)
R = lambda c, n=6: F.round(c, n).alias(c)


def _vals(name, cols, rows):
    body = ", ".join("(" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" if isinstance(v, (float, np.floating)) else str(int(v)) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


def _segs(spark, sf, nperseg=NP, step=STEP):
    return ch.segments(S.signal_chunks(spark, sf, CH), CH, nperseg, step)


def _dft_sql(win, nperseg, step, nseg, nf, mean=True, src="sig", n=None):
    """Windowed Fourier sums of every segment by a join of samples, segments and frequencies."""
    centre = "- avg(v) OVER (PARTITION BY channel, s.i)" if mean else ""
    return f"""{_vals('win', 'm, w', [(i, float(x)) for i, x in enumerate(win)])},
  sg AS (SELECT channel, s.i AS segment, idx - s.i * {step} AS m, v {centre} AS v FROM {src} CROSS JOIN range({nseg}) s(i)
         WHERE idx >= s.i * {step} AND idx < s.i * {step} + {nperseg}),
  ft AS (SELECT channel, segment, r.i AS f, sum(v * w * cos(2 * pi() * r.i * m / {n or nperseg})) AS re,
           -sum(v * w * sin(2 * pi() * r.i * m / {n or nperseg})) AS im
         FROM sg JOIN win USING (m) CROSS JOIN range({nf}) r(i) GROUP BY 1, 2, 3)"""


WELCH = f"""WITH {S.SIG}, {_dft_sql(HANN, NP, STEP, 3, NP // 2 + 1)},
  psd AS (SELECT channel, f, f * CAST({FS / NP} AS DOUBLE) AS freq, avg(re * re + im * im) * {1 / (FS * float((HANN**2).sum()))!r}
    * CASE WHEN f = 0 OR f = {NP // 2} THEN 1 ELSE 2 END AS p FROM ft GROUP BY 1, 2)"""


def _welch(spark, sf):
    return sc.welch(_segs(spark, sf), NP, FS, HANN)


@query("welch", f"{WELCH} SELECT channel, freq, round(p, 8) AS p FROM psd")
def _(spark, sf):
    return _welch(spark, sf).select("channel", "freq", R("p", 8))


BOX64 = np.ones(64)


@query(
    "dft64_power",
    f"WITH {S.SIG}, {_dft_sql(BOX64, 64, 64, 1, 33, mean=False)} SELECT channel, f, round(re * re + im * im, 6) AS p FROM ft",
)
def _(spark, sf):
    z = sc.spectra_long(sc.spectra(_segs(spark, sf, 64, 64), BOX64, 64, detrend=False))
    return z.select("channel", F.col("f").cast("bigint").alias("f"), F.round(ch.power(), 6).alias("p"))


BANDS = {"theta": (4.0, 10.0), "beta": (12.0, 20.0)}


@query(
    "periodogram_band_power",
    f"""WITH {S.SIG}, {_dft_sql(design.window(('tukey', 0.25), 64), 64, 64, 1, 33)} SELECT channel, {', '.join(
        f"round(sum((re * re + im * im) * {1 / (FS * float((design.window(('tukey', 0.25), 64) ** 2).sum()))!r} * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END) FILTER (f BETWEEN {lo} AND {hi}), 6) AS {b}"
        for b, (lo, hi) in BANDS.items())} FROM ft GROUP BY 1""",
)
def _(spark, sf):
    p = sc.welch(_segs(spark, sf, 64, 64), 64, FS, design.window(("tukey", 0.25), 64))
    return sc.band_power(p, ["channel"], BANDS, log=False).select("channel", *[R(b) for b in BANDS])


@query(
    "band_sum_log10",
    f"{WELCH} SELECT channel, {', '.join(f'round(sum(log10(p)) FILTER (freq BETWEEN {lo} AND {hi}), 6) AS {b}' for b, (lo, hi) in BANDS.items())} FROM psd GROUP BY 1",
)
def _(spark, sf):
    return sc.band_power(_welch(spark, sf), ["channel"], BANDS).select("channel", *[R(b) for b in BANDS])


@query(
    "trapz_band_power",
    f"""{WELCH}, t AS (SELECT *, lead(p) OVER (PARTITION BY channel ORDER BY f) AS n FROM psd WHERE freq BETWEEN 4 AND 20)
      SELECT channel, round(sum((p + n) / 2) * {FS / NP}, 6) AS power FROM t GROUP BY 1""",
)
def _(spark, sf):
    return sc.trapezoid_power(_welch(spark, sf), ["channel"], 4, 20, FS / NP).select("channel", R("power"))


@query(
    "aperiodic_loglog_fit",
    f"""{WELCH} SELECT channel, round(regr_intercept(log10(p), log10(freq)), 6) AS "offset", round(-regr_slope(log10(p), log10(freq)), 6) AS exponent,
      round(regr_r2(log10(p), log10(freq)), 6) AS r2 FROM psd WHERE freq > 0 GROUP BY 1""",
)
def _(spark, sf):
    return sc.aperiodic_fit(_welch(spark, sf), ["channel"]).select("channel", R("offset"), R("exponent"), R("r2"))


@query("robust_log_spectrum_line")
def _(spark, sf):
    return sc.robust_line(_welch(spark, sf), ["channel"])


TAPERS, LAM = design.dpss(64, 2.5, 5)
TAPERS, LAM = TAPERS[LAM > 0.9], LAM[LAM > 0.9]


@query(
    "multitaper",
    f"""WITH {S.SIG}, {_vals('tp', 'k, lam, m, w', [(k, float(LAM[k]), i, float(x)) for k in range(len(LAM)) for i, x in enumerate(TAPERS[k])])},
      c AS (SELECT channel, idx AS m, v - avg(v) OVER (PARTITION BY channel) AS v FROM sig),
      ft AS (SELECT channel, k, any_value(lam) AS lam, r.i AS f, sum(v * w * cos(2 * pi() * r.i * m / 64)) AS re, sum(v * w * sin(2 * pi() * r.i * m / 64)) AS im
        FROM c JOIN tp USING (m) CROSS JOIN range(33) r(i) GROUP BY channel, k, r.i)
      SELECT channel, f, round(sum(lam * (re * re + im * im)) / sum(lam) / {FS} * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END, 8) AS p FROM ft GROUP BY 1, 2""",
)
def _(spark, sf):
    d = sc.multitaper(_segs(spark, sf, 64, 64), 64, 64, FS)
    return d.select("channel", F.col("f").cast("bigint").alias("f"), R("p", 8))


@query("multitaper_adaptive_jackknife")
def _(spark, sf):
    d = sc.multitaper(_segs(spark, sf, 64, 64), 64, 64, FS, method="adaptive", jackknife=True)
    return d.select("channel", "f", "p", "jack")


@query("multitaper_segmented")
def _(spark, sf):
    d = sc.multitaper(_segs(spark, sf), NP, NP, FS, nw=3, k=5, method="adaptive", low_bias=False)
    return d.select("channel", "segment", "f", "p")


FREQS = [8.0, 12.0, 20.0]
WAVES = [design.morlet(f, FS, n_cycles=3.0) for f in FREQS]
WV = _vals(
    "wv", "f, half, m, wr, wi",
    [(j, (len(w) - 1) // 2, i, float(z.real), float(z.imag)) for j, w in enumerate(WAVES) for i, z in enumerate(w)],
)
CWT = f"""WITH {S.SIG}, {WV}, cwt AS (SELECT channel, f, idx + m - half AS idx, sum(v * wr) AS re, sum(v * wi) AS im
    FROM sig CROSS JOIN wv WHERE idx + m - half BETWEEN 0 AND 63 GROUP BY 1, 2, 3)"""


def cwt(spark, sf):
    return ch.wavelet_long(ch.wavelet_bands(S.signal_chunks(spark, sf, CH), CH, WAVES), CH)


@query("morlet_cwt", f"{CWT} SELECT channel, f, idx, round(re, 6) AS re, round(im, 6) AS im FROM cwt")
def _(spark, sf):
    return cwt(spark, sf).select("channel", F.col("f").cast("bigint").alias("f"), "idx", R("re"), R("im"))


@query("spectrogram_power_mean", f"{CWT} SELECT channel, f, round(avg(re * re + im * im) / {FS}, 6) AS psd FROM cwt GROUP BY 1, 2")
def _(spark, sf):
    d = cwt(spark, sf).groupBy("channel", F.col("f").cast("bigint").alias("f")).agg(F.avg(ch.power()).alias("p"))
    return d.select("channel", "f", F.round(sc.scale_power(F.col("p"), "psd", FS), 6).alias("psd"))


SUPF = [8.0, 12.0, 16.0]


def _superlet(name, waves):
    vals = _vals(
        "sv", "f, k, weight, half, m, wr, wi",
        [(i, k, float(g), (len(w) - 1) // 2, m, float(z.real), float(z.imag)) for k, (i, g, w) in enumerate(waves) for m, z in enumerate(w)],
    )

    @query(
        name,
        f"""WITH {S.SIG}, {vals}, t AS (SELECT channel, f, k, any_value(weight) AS g, idx + m - half AS idx, sum(v * wr) AS re, sum(v * wi) AS im
            FROM sig CROSS JOIN sv WHERE idx + m - half BETWEEN 0 AND 63 GROUP BY channel, f, k, idx + m - half)
          SELECT channel, f, idx, round(exp(sum(g * ln(sqrt(re * re + im * im))) / sum(g)), 6) AS amplitude FROM t GROUP BY 1, 2, 3""",
    )
    def _(spark, sf):
        tf = ch.wavelet_long(ch.wavelet_bands(S.signal_chunks(spark, sf, CH), CH, [w for *_, w in waves]), CH)
        at = lambda vals: F.get(F.array(*[F.lit(v) for v in vals]), F.col("f"))
        tf = tf.withColumns({"freq": at([i for i, *_ in waves]).cast("bigint"), "weight": at([float(g) for _, g, _ in waves])})
        d = sc.superlet_power(tf, ["channel", "freq", "idx"], "weight")
        return d.select("channel", F.col("freq").alias("f"), "idx", R("amplitude"))


_superlet("superlet", [(i, 1.0, design.morlet(f, FS, n_cycles=c)) for i, f in enumerate(SUPF) for c in (2.0, 3.0, 4.0)])
_superlet("superlet_adaptive", sc.superlet_set(SUPF, FS, 2.0, 1.0, 2.5))


HP, HSTEP = 96, 48
HAM = design.window("hamming", HP)
HFS = 24.0  # samples per day
COH = f"""WITH {S.HRS}, {_dft_sql(HAM, HP, HSTEP, 14, HP // 2 + 1, src='hrs')},
  cs AS (SELECT a.channel AS c1, b.channel AS c2, f, avg(a.re * a.re + a.im * a.im) AS sxx, avg(b.re * b.re + b.im * b.im) AS syy,
      avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im
    FROM ft a JOIN ft b USING (segment, f) WHERE a.channel < b.channel GROUP BY 1, 2, 3),
  co AS (SELECT *, f * CAST({HFS / HP} AS DOUBLE) AS freq, re / sqrt(sxx * syy) AS cr, im / sqrt(sxx * syy) AS ci FROM cs)"""


def _coherence(spark, sf):
    c = ch.to_chunks(S.hourly(spark, sf), 120)
    z = sc.spectra(ch.segments(c, 120, HP, HSTEP), HAM, HP)
    return sc.coherence(sc.cross_spectra(z)).withColumn("freq", F.col("f") * HFS / HP)


@query(
    "coherence_segments",
    f"""{COH} SELECT c1, c2, freq, round(ci * ci / (1 - cr * cr + 1e-18), 6) AS icohere, round(abs(ci) / (sqrt(1 - cr * cr) + 1e-18), 6) AS lcohere2019,
      round(abs(ci), 6) AS icohere2019, round(cr * cr + ci * ci, 6) AS mscohere1, round(sqrt(cr * cr + ci * ci), 6) AS mscohere2 FROM co""",
)
def _(spark, sf):
    return _coherence(spark, sf).select("c1", "c2", "freq", *[R(c) for c in ("icohere", "lcohere2019", "icohere2019", "mscohere1", "mscohere2")])


@query(
    "phase_slope_index",
    f"""{COH}, n AS (SELECT *, lead(cr) OVER w AS nr, lead(ci) OVER w AS ni FROM co WHERE freq > 1 AND freq < 6 WINDOW w AS (PARTITION BY c1, c2 ORDER BY f))
      SELECT c1, c2, round(sum(cr * ni - ci * nr), 6) AS psi FROM n GROUP BY 1, 2""",
)
def _(spark, sf):
    return sc.phase_slope(_coherence(spark, sf), ["c1", "c2"], 1, 6).select("c1", "c2", R("psi"))


@query(
    "phase_lag_value",
    f"""{CWT}, d AS (SELECT a.channel AS c1, b.channel AS c2, atan2(a.im, a.re) - atan2(b.im, b.re) AS d FROM cwt a JOIN cwt b
        ON a.f = 1 AND b.f = 1 AND a.idx = b.idx AND b.channel = a.channel + 1),
      g AS (SELECT c1, c2, avg(cos(d)) AS c, avg(sin(d)) AS s FROM d GROUP BY 1, 2)
      SELECT c1, c2, round(sqrt(c * c + s * s), 6) AS plv, round(abs(s), 6) AS iplv, round(abs(s) / sqrt(1 - c * c), 5) AS ciplv FROM g""",
)
def _(spark, sf):
    t = cwt(spark, sf).where("f = 1")
    a = t.select(F.col("channel").alias("c1"), (F.col("channel") + 1).alias("c2"), "idx", "re", "im")
    b = t.select((F.col("channel") - 1).alias("c1"), F.col("channel").alias("c2"), "idx", "re", "im")
    return sc.phase_lag_values(a, b, ["c1", "c2"]).select("c1", "c2", R("plv"), R("iplv"), R("ciplv", 5))


@query("irasa")
def _(spark, sf):
    blocks = ch.segments(S.signal_chunks(spark, sf, CH), CH, 64, 64)
    return sc.irasa(blocks, NP, FS, [1.1, 1.2, 1.3, 1.5, 1.6, 1.75, 1.9], (2.0, 16.0)).drop("recording_id")


def _cascade(name, source, sos, steady):
    """Second-order sections one after the other, sample by sample; ``steady`` starts them at rest for the first sample."""
    zi = ch._steady(sos) if steady else np.zeros(2 * len(sos))
    first, text = source, []
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        made, z1, z2 = f"{name}{k}", float(zi[2 * k]), float(zi[2 * k + 1])
        step = lambda v, s1, s2: f"{b0!r} * {v} + {s1} AS v, {b1!r} * {v} - {a1!r} * ({b0!r} * {v} + {s1}) + {s2} AS z1, {b2!r} * {v} - {a2!r} * ({b0!r} * {v} + {s1}) AS z2"  # noqa: B023, E731
        start = step("x.v", f"{z1!r} * f.v", f"{z2!r} * f.v")
        text.append(f"""{made} AS (SELECT x.channel, x.idx, {start} FROM {source} x JOIN {first} f ON f.channel = x.channel AND f.idx = 0 WHERE x.idx = 0
          UNION ALL SELECT x.channel, x.idx, {step("x.v", "s.z1", "s.z2")} FROM {made} s JOIN {source} x ON x.channel = s.channel AND x.idx = s.idx + 1)""")
        source = made
    return ", ".join(text), source


def _iir_sql(sos, zero):
    text, out = _iir_tables("", np.asarray(sos, float), zero)
    return f"WITH RECURSIVE {S.SIG}, {text} SELECT channel, idx, round(v, 6) AS v FROM {out}"


def _iir_tables(name, sos, zero):
    """Common table expressions of a recursive filter of ``sig`` and the last one's name."""
    if not zero:
        text, out = _cascade(f"{name}c", f"{name}x0", sos, False)
        return f"{name}x0 AS (SELECT channel, idx, v FROM sig), {text}", out
    pad = design.edge_length(sos)
    forth, a = _cascade(f"{name}a", f"{name}x0", sos, True)
    back, b = _cascade(f"{name}b", f"{name}x1", sos, True)
    last = 63 + 2 * pad
    return f"""{name}x0 AS (SELECT channel, r.i + {pad} AS idx, CASE WHEN r.i < 0 THEN 2 * a.v - b.v WHEN r.i > 63 THEN 2 * z.v - b.v ELSE b.v END AS v
        FROM range(-{pad}, {64 + pad}) r(i) JOIN sig b ON b.idx = CASE WHEN r.i < 0 THEN -r.i WHEN r.i > 63 THEN 126 - r.i ELSE r.i END
        JOIN (SELECT channel, v FROM sig WHERE idx = 0) a USING (channel) JOIN (SELECT channel, v FROM sig WHERE idx = 63) z USING (channel)),
      {forth}, {name}x1 AS (SELECT channel, {last} - idx AS idx, v FROM {a}), {back},
      {name}y AS (SELECT channel, {last} - idx - {pad} AS idx, v FROM {b} WHERE {last} - idx - {pad} BETWEEN 0 AND 63)""", f"{name}y"


@query("butter_zero_phase", _iir_sql(design.butterworth(4, FS, 4.0, 20.0), True))
def _(spark, sf):
    d = ch.filtered(S.signal_chunks(spark, sf, CH), CH, FS, "butterworth_zero", 4, 4.0, 20.0)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query("butter_causal", _iir_sql(design.butterworth(4, FS, 4.0, None), False))
def _(spark, sf):
    d = ch.filtered(S.signal_chunks(spark, sf, CH), CH, FS, "butterworth", 4, 4.0, None)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query("bessel_causal", _iir_sql(design.bessel(4, FS, None, 20.0), False))
def _(spark, sf):
    d = ch.filtered(S.signal_chunks(spark, sf, CH), CH, FS, "bessel", 4, None, 20.0)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query("bessel_zero_phase", _iir_sql(design.bessel(3, FS, None, 12.0), True))
def _(spark, sf):
    d = ch.filtered(S.signal_chunks(spark, sf, CH), CH, FS, "bessel_zero", 3, None, 12.0)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query("notch_zero_phase", _iir_sql(design.notch(16.0, 10.0, FS), True))
def _(spark, sf):
    return ch.to_long(ch.notched(S.signal_chunks(spark, sf, CH), CH, FS, 16.0, 10.0), CH).select("channel", "idx", R("v"))


@query("notch_causal", _iir_sql(design.notch(16.0, 10.0, FS), False))
def _(spark, sf):
    return ch.to_long(ch.notched(S.signal_chunks(spark, sf, CH), CH, FS, 16.0, 10.0, zero=False), CH).select("channel", "idx", R("v"))


FIRW = design.firwin_shape(21, [0.0, 3.0, 4.0, 12.0, 13.0, 32.0], [0.0, 0.0, 1.0, 1.0, 0.0, 0.0], FS, design.window("hann", 21, periodic=False))


def _fir_sql(w, shift, step=1):
    return f"""WITH {S.SIG}, {_vals('w', 'm, w', [(i, float(x)) for i, x in enumerate(w)])},
      o AS (SELECT channel, idx + m - {shift} AS idx, sum(v * w) AS v FROM sig CROSS JOIN w WHERE idx + m - {shift} BETWEEN 0 AND 63 GROUP BY 1, 2)
      SELECT channel, idx // {step} AS idx, round(v, 6) AS v FROM o WHERE idx % {step} = 0"""


@query("fir_zero_delay", _fir_sql(FIRW, 10))
def _(spark, sf):
    d = ch.filtered(S.signal_chunks(spark, sf, CH), CH, FS, "fir_zero_2", 21, 4.0, 12.0, 1.0, 1.0)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


FIR2 = np.convolve(FIRW, FIRW[::-1])


@query(
    "fir_zero_twice",
    f"""WITH {S.SIG}, {_vals('w', 'm, w', [(i, float(x)) for i, x in enumerate(FIR2)])},
      e AS (SELECT channel, CASE WHEN r.i < 0 THEN 2 * a.v - b.v WHEN r.i > 63 THEN 2 * z.v - b.v ELSE b.v END AS v, r.i AS idx
        FROM range(-20, 84) r(i) JOIN sig b ON b.idx = CASE WHEN r.i < 0 THEN -r.i WHEN r.i > 63 THEN 126 - r.i ELSE r.i END
        JOIN (SELECT channel, v FROM sig WHERE idx = 0) a USING (channel) JOIN (SELECT channel, v FROM sig WHERE idx = 63) z USING (channel))
      SELECT channel, idx + m - 20 AS idx, round(sum(v * w), 6) AS v FROM e CROSS JOIN w WHERE idx + m - 20 BETWEEN 0 AND 63 GROUP BY 1, 2""",
)
def _(spark, sf):
    d = ch.filtered(S.signal_chunks(spark, sf, CH), CH, FS, "fir_zero_1", 21, 4.0, 12.0, 1.0, 1.0)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query("resample_poly", _fir_sql(design.firwin_lowpass(81, 0.25), 40, 4))
def _(spark, sf):
    d = ch.downsample(S.signal_chunks(spark, sf, CH), CH, FS, 16.0)
    return ch.to_long(d, CH // 4).select("channel", "idx", R("v"))


@query(
    "wavelet_frequencies",
    """SELECT label, vec_id, round(pow(10, log10(1 + label) + (log10(110) - log10(1 + label)) * (vec_id % 20) / 19.0), 6) AS freq,
      round(7.0 / (2 * pi() * (pow(10, log10(1 + label) + (log10(110) - log10(1 + label)) * (vec_id % 20) / 19.0))), 8) AS sigma FROM embeddings""",
)
def _(spark, sf):
    e = S.table(spark, sf, "embeddings").select("label", "vec_id")
    lo = F.log10(1 + F.col("label").cast("double"))
    f = F.pow(F.lit(10.0), lo + (F.lit(math.log10(110)) - lo) * (F.col("vec_id") % 20) / 19.0)
    return e.select("label", "vec_id", F.round(f, 6).alias("freq"), F.round(7.0 / (2 * math.pi * f), 8).alias("sigma"))


REMEZ = design.equiripple(21, [0.0, 12.0, 18.0, 32.0], [1.0, 0.0], FS)


@query("remez_delay", _fir_sql(REMEZ, 10))
def _(spark, sf):
    d = ch.filtered(S.signal_chunks(spark, sf, CH), CH, FS, "remez_2", 21, lowpass=12.0, low_width=6.0)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query("robust_line_estimators")
def _(spark, sf):
    p = _welch(spark, sf)
    names = ["andrew", "trimmed", "huber", "ramsay", "tukey", "hampel", "least_squares"]
    return sc.robust_lines(p, ["channel"], names).select("channel", "slope", "intercept", "estimator")
