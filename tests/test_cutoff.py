"""Amplitude cutoff: a unit's histogram is one row, smoothed in a task."""

import numpy as np

from spikeloom.operators import units as un


def brute(x, bins, w):
    width = (x.max() - x.min()) / bins
    at = np.minimum(np.floor((x - x.min()) / width), bins - 1).astype(int)
    p, r = np.bincount(at, minlength=bins) / (len(x) * width), len(w) // 2
    pdf = np.zeros(bins)
    for j in range(bins):
        for img in (j, -j - 1, 2 * bins - 1 - j):
            for m, v in enumerate(w):
                if 0 <= img + m - r < bins:
                    pdf[img + m - r] += p[j] * v
    peak = pdf.argmax()
    return min(0.5, pdf[peak + np.abs(pdf[peak:] - pdf[0]).argmin() :].sum() * width)


def test_cutoff(spark):
    rng = np.random.default_rng(4)
    x = {u: rng.normal(u, 1 + u, 40 + 30 * u) for u in range(5)}
    rows = [("r", u, i, float(a)) for u, v in x.items() for i, a in enumerate(v)] + [("r", 9, 0, 1.0), ("r", 9, 1, 1.0), ("r", 10, 0, None)]
    s = spark.createDataFrame(rows, "recording_id string, cluster_id long, spike_id long, amplitude double")
    for bins, sigma in ((500, 3.0), (40, 2.0), (6, 3.0)):
        d = un.amplitude_cutoff(s, bins, sigma)
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" not in plan and "explode(sequence(0, 499" not in plan  # no row per bin and tap
        got = {r.cluster_id: r.amp_cutoff for r in d.collect()}
        want = {u: brute(v, bins, un.gaussian_weights(sigma)) for u, v in x.items()}
        assert set(got) == set(want) and all(abs(got[u] - want[u]) < 1e-9 for u in want)
