"""Spike-triggered averages: counts are dealt by unit and stretch before they are spread over the offsets."""

import re

import numpy as np

from spikeloom.operators import phase as ph


def test_triggered_average(spark):
    rng, n, w = np.random.default_rng(3), 50, 4
    sig = {c: rng.integers(0, 9, n).astype(float) for c in "ab"}
    spikes = [(u, "abz"[rng.integers(3)], int(rng.integers(-3, n + 3))) for u in range(6) for _ in range(5 + u)] + [(7, None, 3), (7, "a", None), (None, "a", 3)]
    s = spark.createDataFrame([("r", u, c, i) for u, c, i in spikes], "recording_id string, cluster_id long, channel string, idx long")
    v = spark.createDataFrame([("r", c, i, float(x)) for c, y in sig.items() for i, x in enumerate(y)], "recording_id string, channel string, idx long, v double")
    d = ph.triggered_average(s, v, w, 20, ["recording_id", "channel"])
    at = lambda c, i: sig[c][i] if c in sig and i is not None and 0 <= i < n else 0.0
    want = {}
    for u in {u for u, _, _ in spikes if u is not None}:
        own = [(c, i) for x, c, i in spikes if x == u]
        for o in range(-w, w + 1):
            want[u, o] = (len(own), sum(at(c, None if i is None else i + o) for c, i in own) / len(own))
    got = {(r.cluster_id, r.offset): (r.n_spikes, r.mean_v) for r in d.collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    # What is spread over the offsets was dealt by unit and stretch, so a task's sums are those of its own units.
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate posexplode[^\n]*\n[^G]*RepartitionByExpression \[recording_id#\d+, cluster_id#\d+L, _part#\d+L\]", plan), plan
