"""Distributed transforms against transforms of whole channels."""

import numpy as np
import pytest

from spikeloom.operators import fourier as fo

SIZE = 7


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    data = {("r", c): rng.normal(size=n) for c, n in enumerate((64, 63, 60, 61, 1, 2, 7, 360, 97))}
    rows = [(r, c, k, x[k * SIZE : (k + 1) * SIZE].tolist()) for (r, c), x in data.items() for k in range(-(-len(x) // SIZE))]
    return spark.createDataFrame(rows, "recording_id string, channel long, chunk long, samples array<double>"), data


def whole(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk):
        out.setdefault((r.recording_id, r.channel), []).append(np.array([getattr(r, c) for c in columns]))
    return {k: np.concatenate(v, axis=1) for k, v in out.items()}


def hilbert(x):
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


@pytest.mark.parametrize("block", [1 << 18, 16])
def test_analytic_signal(made, block):
    """One block or several: both give the transform of the whole channel."""
    chunks, data = made
    got = whole(fo.analytic_signal(chunks, SIZE, block=block), "re", "im")
    assert set(got) == set(data)
    for k, x in data.items():
        z = hilbert(x)
        assert np.allclose(got[k], [z.real, z.imag], atol=1e-9), k


def test_grids_are_bounded():
    for n in (24_000_000, 2**25, 720_720, 10**6):
        r, c, wide, high = fo.grid_of(n, fo.BLOCK)
        assert r * c == n and max(r * wide, c * high) <= fo.BLOCK


def test_band_and_identity(made):
    chunks, data = made
    same = whole(fo.through_spectrum(chunks, SIZE, lambda z, k, n, keys: z, block=16), "re", "im")
    band = whole(fo.analytic_signal(chunks, SIZE, 4.0, 16.0, 64.0, block=16), "re", "im")
    for k, x in data.items():
        assert np.allclose(same[k][0], x, atol=1e-9) and np.allclose(same[k][1], 0, atol=1e-9)
        f = np.abs(np.fft.fftfreq(len(x), 1 / 64.0))
        z = hilbert(np.fft.ifft(np.fft.fft(x) * ((f >= 4) & (f <= 16))))
        assert np.allclose(band[k], [z.real, z.imag], atol=1e-9)


def test_surrogates(made):
    """Real, with the amplitudes of the original, other phases; alike however the channel is cut."""
    chunks, data = made
    got = {b: whole(fo.surrogate_channels(chunks, SIZE, 5, b), "samples") for b in (1 << 18, 16)}
    other = whole(fo.surrogate_channels(chunks, SIZE, 6), "samples")
    for k, x in data.items():
        y = got[16][k][0]
        assert np.allclose(y, got[1 << 18][k][0], atol=1e-9)
        want = np.abs(np.fft.rfft(x))
        want[0] = 0
        if len(x) % 2 == 0:
            want[-1] = 0
        assert np.allclose(np.abs(np.fft.rfft(y)), want, atol=1e-9)
        assert len(x) < 10 or not np.allclose(y, other[k][0], atol=1e-3)
    u = fo.uniform(3, np.arange(100_000))
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02


def test_no_channels(made):
    assert fo.analytic_signal(made[0].where("channel < 0"), SIZE).count() == 0
