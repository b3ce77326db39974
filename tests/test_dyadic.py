"""Wavelet filters and splines against whole channels."""

import numpy as np
import pytest

from spikeloom.functions import design
from spikeloom.operators import dyadic, splines
from spikeloom.plans import load
from spikeloom.plans.registry import QUERIES


def chunked(spark, data, size):
    rows = [("r", c, k, x[k * size : (k + 1) * size].tolist()) for c, x in data.items() for k in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "recording_id string, channel long, chunk long, samples array<double>")


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk):
        out.setdefault(r.channel, []).extend(r.samples)
    return {k: np.array(v) for k, v in out.items()}


def plain(x, drop, kind):
    low, high, up, over = design.quadrature(design.daubechies(4))
    ref = lambda i, n: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    parts, sizes, a = [], [], x
    for _ in range(dyadic.most_levels(len(x), 8)):
        n = len(a)
        at = np.array([[ref(2 * k + 1 - j, n) for j in range(8)] for k in range((n + 7) // 2)])
        parts.insert(0, a[at] @ high)
        sizes.append(n)
        a = a[at] @ low
    parts.insert(0, a)
    for i in range(drop) if kind == "highpass" else range(len(parts) - drop, len(parts)):
        parts[i] = parts[i] * 0
    a = parts[0]
    for d in parts[1:]:
        n = sizes.pop()
        a = np.array([sum(up[t + 6 - 2 * k] * a[k] + over[t + 6 - 2 * k] * d[k] for k in range(len(d)) if 0 <= t + 6 - 2 * k < 8) for t in range(n)])
    return a


@pytest.mark.parametrize("n,size,drop,kind", [(200, 16, 0, "highpass"), (200, 16, 1, "highpass"), (101, 7, 2, "lowpass"), (64, 64, 3, "highpass")])
def test_wavelet_filter(spark, n, size, drop, kind):
    rng = np.random.default_rng(n)
    data = {c: rng.normal(size=n).cumsum() for c in range(3)}
    got = whole(dyadic.wavelet_filter(chunked(spark, data, size), size, drop, kind, n))
    for c, x in data.items():
        want = x if drop == 0 else plain(x, drop, kind)
        assert np.allclose(got[c], want, atol=1e-9)


def test_spline_in_blocks(spark, monkeypatch):
    """Blocks with halos give the spline of all knots; few knots give lines and parabolas."""
    monkeypatch.setattr(splines, "KNOTS", 16)
    monkeypatch.setattr(splines, "BATCH", 50)
    rng = np.random.default_rng(4)
    knots = {0: np.sort(rng.choice(3000, 300, replace=False)), 1: np.array([5]), 2: np.array([3, 9]), 3: np.array([0, 4, 20]), 4: np.arange(17), 5: np.sort(rng.choice(100, 33, replace=False)), 6: np.arange(16)}
    values = {c: rng.normal(size=len(k)) for c, k in knots.items()}
    df = spark.createDataFrame([("r", c, int(i), float(v)) for c in knots for i, v in zip(knots[c], values[c])], "recording_id string, channel long, idx long, v double")
    got = {(r.channel, r.idx): r.v for r in splines.spline_samples(df, ["recording_id", "channel"], 64).collect()}
    for c, k in knots.items():
        x, y = k.astype(float), values[c]
        want = splines.between(x, y, splines.slopes(x, y), np.arange(k[0], k[-1] + 1).astype(float))
        assert [i for j, i in sorted(got) if j == c] == list(range(k[0], k[-1] + 1))
        assert np.allclose([got[c, i] for i in range(k[0], k[-1] + 1)], want, atol=1e-9)
    # Not a knot: a cubic is its own spline.
    x = np.array([0.0, 1.0, 4.0, 6.0, 7.0])
    cubic = lambda t: t**3 - 5 * t * t + 2 * t - 1
    assert np.allclose(splines.between(x, cubic(x), splines.slopes(x, cubic(x)), np.linspace(0, 7, 50)), cubic(np.linspace(0, 7, 50)))


def test_envelope_query(spark):
    load()
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in QUERIES["envelope_spline"](spark, sf).collect():
        got.setdefault((r.channel, r.kind), {})[r.idx] = r.v
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert len(got) == 2 * len(e)
    for r in e[:40]:
        s = np.array(r.embedding, float)
        turn = np.diff(np.sign(np.diff(s)))
        for kind, at, pick in (("min", np.flatnonzero(turn > 0) + 1, np.argmin), ("max", np.flatnonzero(turn < 0) + 1, np.argmax)):
            at = np.array([at[i + pick(s[at[i : i + 2]])] for i in range(0, len(at), 2)])
            k = np.unique(np.r_[0, at, len(s) - 1])
            x = k.astype(float)
            want = splines.between(x, s[k], splines.slopes(x, s[k]), np.arange(64.0))
            assert np.allclose([got[r.vec_id, kind][i] for i in range(64)], want, atol=2e-6)
