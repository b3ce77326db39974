"""Chunked filters and estimates against direct computation on whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.functions import design
from spikeloom.operators import chunks as ch
from spikeloom.operators import lfp
from spikeloom.operators import models as mo
from spikeloom.operators import phase as ph
from spikeloom.operators import population as po
from spikeloom.operators import signals as sg
from spikeloom.operators import spectral as sc
from spikeloom.operators import waveforms as wf

SIZE = 96


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=1000).cumsum() * 0.1 + rng.normal(size=1000)
    rows = [("r", 0, i, x[i * SIZE : (i + 1) * SIZE].tolist()) for i in range(-(-1000 // SIZE))]
    return x, spark.createDataFrame(rows, "recording_id string, channel long, chunk long, samples array<double>")


def whole(df):
    return np.concatenate([np.array(r.samples) for r in sorted(df.collect(), key=lambda r: r.chunk)])


def direct(sos, x, zi=None):
    z = np.zeros((len(sos), 2)) if zi is None else np.array(zi).reshape(-1, 2)
    out = []
    for v in x:
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            y = b0 * v + z[i, 0]
            z[i] = b1 * v - a1 * y + z[i, 1], b2 * v - a2 * y
            v = y
        out.append(v)
    return np.array(out)


@pytest.mark.parametrize("kind,hp,lp", [("butterworth", 2, 80), ("bessel", None, 80), ("butterworth", 5, None)])
def test_recursive_filters_equal_recursion(signal, kind, hp, lp):
    x, df = signal
    sos = ch.band_sos(kind, 4, 1000.0, hp, lp)
    np.testing.assert_allclose(whole(ch.recursive(df, SIZE, sos)), direct(sos, x), atol=1e-8)
    pad, zi = design.edge_length(sos), ch._steady(sos)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -2 - pad : -1]])
    y = direct(sos, ext, zi * ext[0])
    y = direct(sos, y[::-1], zi * y[-1])[::-1][pad:-pad]
    np.testing.assert_allclose(whole(ch.zero_phase(df, SIZE, sos)), y, atol=1e-8)


def test_butterworth_halves_power_at_cutoff():
    sos = design.butterworth(4, 1000.0, None, 80.0)
    z = np.exp(2j * np.pi * 80 / 1000)
    h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos])
    assert abs(h) == pytest.approx(np.sqrt(0.5), abs=1e-9)


def test_fir_decimation_and_windows(signal):
    x, df = signal
    w = np.random.default_rng(1).normal(size=41)
    np.testing.assert_allclose(whole(ch.fir(df, SIZE, w, 20)), np.convolve(x, w)[20:1020], atol=1e-9)
    h = design.firwin_lowpass(81, 0.25)
    np.testing.assert_allclose(whole(ch.downsample(df, SIZE, 1000, 250)), np.convolve(x, h)[40:1040][::4], atol=1e-9)
    for r in ch.segments(df, SIZE, 200, 100).collect():
        np.testing.assert_array_equal(r.samples, x[r.segment * 100 : r.segment * 100 + 200])
    odd = np.concatenate([2 * x[0] - x[40:0:-1], x, 2 * x[-1] - x[-2:-42:-1]])
    np.testing.assert_allclose(whole(ch.fir(df, SIZE, np.ones(81), 40, edge="odd")), np.convolve(odd, np.ones(81), "valid"), atol=1e-8)


def test_wavelets_equal_convolution(signal):
    x, df = signal
    waves = [design.morlet(f, 1000.0) for f in (20, 60)]
    t = ch.wavelet_long(ch.wavelet_bands(df, SIZE, waves), SIZE).toPandas().sort_values(["f", "idx"])
    for i, w in enumerate(waves):
        full = np.convolve(x, w)
        at = (len(full) - 1000) // 2
        g = t[t.f == i]
        np.testing.assert_allclose(g.re.values + 1j * g.im.values, full[at : at + 1000], atol=1e-9)


def test_tapers_are_orthonormal_and_long_ones_agree():
    t, lam = design.dpss(128, 2.5, 4)
    np.testing.assert_allclose(t @ t.T, np.eye(4), atol=1e-10)
    assert 0.9999 < lam[0] <= 1 and lam[3] < lam[0]
    n = 1100
    big, lam2 = design.dpss(n, 2.5, 3)
    np.testing.assert_allclose(big @ big.T, np.eye(3), atol=1e-6)
    np.testing.assert_allclose(lam2[:3], design.dpss(1000, 2.5, 3)[1], atol=1e-4)


def test_white_noise_spectra_agree(spark):
    x = np.random.default_rng(2).normal(size=4096)
    df = spark.createDataFrame([("r", 0, i, x[i * 512 : (i + 1) * 512].tolist()) for i in range(8)],
                               "recording_id string, channel long, chunk long, samples array<double>")
    segs = ch.segments(df, 512, 256, 128)
    w = sc.welch(segs, 256, 100.0, design.window("hann", 256)).toPandas()
    assert w.p.mean() == pytest.approx(2 / 100, rel=0.1)
    m = sc.multitaper(segs, 256, 256, 100.0, method="adaptive").groupBy("f").agg(F.avg("p").alias("p")).toPandas()
    assert m.p.mean() == pytest.approx(2 / 100, rel=0.1)


def test_exact_median_with_ties_and_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("r", int(c), float(np.round(v, 1))) for c in range(3) for v in rng.normal(size=5001 if c == 0 else 40 + c)]
    df = spark.createDataFrame(rows, "recording_id string, channel long, v double")
    for r in sg.exact_median(df, sg.CHAN, "v", accuracy=100).collect():
        assert r["median"] == np.median([v for _, c, v in rows if c == r.channel])


def test_density_integrates_to_one(spark):
    x = np.random.default_rng(4).normal(size=2000)
    df = spark.createDataFrame([(0, float(v)) for v in x], "k int, v double")
    r = lfp.density(lfp.grid_counts(df, ["k"], "v", 1.0, 1024), ["k"], 1024).first()
    assert np.trapezoid(r.y, r.x) == pytest.approx(1, abs=0.01)
    assert 0.1 < r.bw < 0.6


def test_spline_baseline_follows_a_smooth_curve(spark):
    t = np.arange(600)
    x = 2 + np.sin(t / 90)
    df = spark.createDataFrame([("r", 0, i, x[i * 100 : (i + 1) * 100].tolist()) for i in range(6)],
                               "recording_id string, channel long, chunk long, samples array<double>")
    lim = spark.createDataFrame([("r", 0, 100.0)], "recording_id string, channel long, ste_max double")
    for kind, deg in (("spline", 12), ("polynomial", 9)):
        got = lfp.fitted_baseline(df, lim, 100, kind, deg, 0.0).withColumnRenamed("base", "samples")
        np.testing.assert_allclose(whole(got), x, atol=1e-3)


def test_circular_statistics(spark):
    a = np.random.default_rng(5).vonmises(0.7, 1.0, 60)
    r = ph.circular(spark.createDataFrame([(0, float(v)) for v in a], "k int, phase double"), ["k"]).first()
    d = np.cos(a[:, None] - a[None])[np.triu_indices(60, 1)].mean()
    assert r.ppc == pytest.approx(d, abs=1e-12)
    assert r.vector_length == pytest.approx(abs(np.exp(1j * a).mean()))


def test_phrases_against_scan():
    def scan(s):
        at, n = 1, 1
        while at < len(s):
            best = 0
            for p in range(at):
                k = 0
                while at + k < len(s) and s[p + k] == s[at + k]:
                    k += 1
                best = max(best, k)
            n, at = n + 1, at + best + 1
        return n

    rng = np.random.default_rng(6)
    for _ in range(200):
        s = "".join(rng.choice(list("ab"), int(rng.integers(1, 40))))
        assert po.lz_phrases(s) == scan(s), s
    # Published examples.
    assert po.lz_phrases("1001111011000010") == 6
    assert po.lz_phrases("10" * 5) == 3
    assert po.lz_phrases("ABCDEFGHIJKLMNOPQRSTUVWXYZ") == 26
    assert po.lz_phrases("HELLO WORLD! " * 4) == 11


def test_template_spline_reproduces_cubics():
    x = np.linspace(0, 20, 20)
    f = lambda v: 0.02 * v**3 - 0.4 * v**2 + v - 3
    np.testing.assert_allclose(wf.spline_matrix(20, 2) @ f(x), f(np.linspace(0, 20, 40)), atol=1e-8)


def test_decay_fit_recovers_parameters(spark):
    x = np.linspace(1, 50, 25)
    rows = [(0, float(v), float(0.8 * np.exp(-v / 12) + 0.1)) for v in x]
    r = mo.exponential_decay(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").first()
    assert (r.amplitude, r.tau, r.constant) == pytest.approx((0.8, 12, 0.1), rel=1e-3)


def test_autoregression_recovers_coefficients(spark):
    rng = np.random.default_rng(7)
    a = np.array([[0.5, 0.2], [-0.1, 0.4]])
    x = np.zeros((3000, 2))
    for i in range(1, 3000):
        x[i] = a @ x[i - 1] + rng.normal(size=2)
    df = spark.createDataFrame([("r", i, x[i].tolist()) for i in range(3000)], "recording_id string, idx long, x array<double>")
    r = mo.autoregression(df, ["recording_id"], 1, 2, 250).first()
    y, z = x[1:], np.column_stack([x[:-1], np.ones(2999)])
    want = np.linalg.lstsq(z, y, rcond=None)[0][:2].T
    np.testing.assert_allclose(np.array(r.coefficients).reshape(2, 2), want, atol=1e-8)
    assert r.n == 2999


def test_sequence_factorisation_lowers_cost(spark):
    rng = np.random.default_rng(8)
    x = np.zeros((4, 120))
    for t in range(5, 110, 15):
        for i in range(4):
            x[i, t + i] = 1 + rng.random() * 0.1
    df = spark.createDataFrame([(c, x[:, c * 30 : (c + 1) * 30].ravel().tolist()) for c in range(4)], "chunk long, x array<double>")
    _, _, costs = mo.sequence_factors(df, 4, 30, 2, 6, 8, 0.0, 1)
    assert all(b <= a * 1.001 for a, b in zip(costs[1:], costs[2:])) and costs[-1] < 0.7 * costs[0]
