"""Lagged tiling counts against all pairs of spikes; no spike is copied per lag."""

import numpy as np

from spikeloom.operators import pairs as pr

LAGS, DT, START, STOP = [0, 7, 40, 95], 3, 10, 200


def tiled(t, end):
    hit = sum(2 * DT + min(b - a - 2 * DT, 0) for a, b in zip(t, t[1:])) + 2 * DT
    head, tail = min(t[0] - DT, 0), min(end - t[-1] - DT, 0)
    return (hit + (head if len(t) == 1 and head < 0 else head + tail)) / end


def test_lagged_counts(spark, monkeypatch):
    monkeypatch.setattr(pr, "LAG_SPIKES", 40)
    rng = np.random.default_rng(4)
    trains = {c: sorted(rng.integers(-20, 230, rng.integers(1, 60)).tolist()) for c in range(6)} | {6: [12], 7: [], 8: [-15]}
    rows = [("r", c, c * 100 + k, t) for c, ts in trains.items() for k, t in enumerate(ts or [None])]
    df = spark.createDataFrame(rows, "recording_id string, cluster_id long, spike_id long, t long")
    for length in (16, 50, 1000):
        d = pr.lagged_sttc(df, DT, LAGS, START, STOP, length)
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
        got = {(r.cluster_id, r.lag): r for r in d.collect()}
        assert set(got) == {(c, lag) for c in trains for lag in LAGS}
        for (c, lag), r in got.items():
            a = [t - lag - START for t in trains[c] if START + lag <= t <= STOP]
            b = [t - START for t in trains[c] if START <= t <= STOP - lag]
            met = lambda x, y: sum(any(abs(p - q) <= DT for q in y) for p in x)
            assert (r.n_a, r.n_b, r.m_a, r.m_b) == (len(a), len(b), met(a, b), met(b, a))
            if not a or not b:
                assert r.sttc == 0
                continue
            end = STOP - START - lag
            pa, pb, ta, tb = met(a, b) / len(a), met(b, a) / len(b), tiled(a, end), tiled(b, end)
            half = lambda p, t: 0.5 if p * t == 1 else 0.5 * (p - t) / (1 - p * t)
            assert np.isclose(r.sttc, half(pa, tb) + half(pb, ta))
