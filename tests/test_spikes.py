"""Burst, tiling and quality operators against plain loops on small trains with ties and hot units."""

import numpy as np
import pytest

from spikeloom.operators import bursts as bu
from spikeloom.operators import models as mo
from spikeloom.operators import pairs as pr
from spikeloom.operators import units as un


def trains(seed, units=6, top=400, hot=120):
    rng = np.random.default_rng(seed)
    out = {}
    for u in range(units):
        out[u] = np.sort(rng.integers(0, top, hot if u == 0 else int(rng.integers(1, 40)))).astype(int)
    return out


def frame(spark, tr):
    rows, k = [], 0
    for u, ts in tr.items():
        for t in ts:
            rows.append(("r", k, u, int(t)))
            k += 1
    return spark.createDataFrame(rows, "recording_id string, spike_id long, cluster_id long, t long")


def tiled(ts, dt, stop):
    n = len(ts)
    total = 2 * n * dt + sum(min(0, b - a - 2 * dt) for a, b in zip(ts, ts[1:]))
    head, tail = min(0, ts[0] - dt), min(0, stop - ts[-1] - dt)
    return total + ((head if head else tail) if n == 1 else head + tail)


def index(a, b, dt, stop):
    def p(x, y):
        first = [next((v for v in y if v >= t - dt), None) for t in x]
        hit = [(t, f) for t, f in zip(x, first) if f is not None and f <= t + dt]
        return len(hit), sum(f > t for t, f in hit)

    na, ka = p(a, b)
    nb, kb = p(b, a)
    pa, pb, ta, tb = na / len(a), nb / len(b), tiled(a, dt, stop) / stop, tiled(b, dt, stop) / stop
    h = lambda u, v: 0.5 * (u - v) / (1 - u * v)
    if pa * tb == 1 and pb * ta == 1:
        s = 1.0
    elif pa * tb == 1:
        s = 0.5 + h(pb, ta)
    elif pb * ta == 1:
        s = 0.5 + h(pa, tb)
    else:
        s = h(pa, tb) + h(pb, ta)
    return s, na, ka, nb, kb


@pytest.mark.parametrize("dt,length,seed", [(1, 50, 0), (5, 37, 1), (30, 1000, 2), (200, 90, 3)])
def test_sttc_equals_definition(spark, dt, length, seed):
    tr = trains(seed)
    got = {
        (r.cluster1_id, r.cluster2_id): (r.sttc, r.n1_dt_2, r.n1_before_2, r.n2_dt_1, r.n2_before_1)
        for r in pr.sttc(frame(spark, tr), dt, 0, 400, length).collect()
    }
    assert len(got) == 15
    for (a, b), g in got.items():
        want = index(list(tr[a]), list(tr[b]), dt, 400)
        assert g[1:] == want[1:], (a, b)
        assert g[0] == pytest.approx(want[0], abs=1e-12)
        assert -1 - 1e-12 <= g[0] <= 1 + 1e-12


def test_sttc_identical_and_empty(spark):
    tr = {0: np.array([10, 50, 90]), 1: np.array([10, 50, 90])}
    units = spark.createDataFrame([("r", 0), ("r", 1), ("r", 2)], "recording_id string, cluster_id long")
    got = {(r.cluster1_id, r.cluster2_id): r.sttc for r in pr.sttc(frame(spark, tr), 3, 0, 100, 40, units=units).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.0, (1, 2): 0.0}


@pytest.mark.parametrize("dt", [3, 40])
def test_coincidences_count_every_pair(spark, dt):
    tr = trains(5)
    got = {(r.c1, r.c2): r.n_pairs for r in pr.correlation_index(frame(spark, tr), dt, 0, 400).collect()}
    for (a, b), n in got.items():
        assert n == int((np.abs(tr[a][:, None] - tr[b][None]) <= dt).sum())


def test_lag_histogram_sums_to_differences(spark):
    tr = trains(6)
    h = pr.lag_histogram(frame(spark, tr), 20, 5, auto=True).collect()
    d = np.subtract.outer(tr[0], tr[0]).T
    d = d[(d != 0) & (d >= -20) & (d < 20)]
    want = np.bincount((d + 20) // 5, minlength=8)
    got = np.zeros(8, int)
    for r in h:
        if r.cluster_id == 0:
            got[r.bin] = r.n
    assert (got == want).all()


def loop_bursts(ts, rule):
    if len(ts) < rule.min_count:
        return []
    raw, i = [], 0
    while i < len(ts) - rule.min_count:
        if ts[i + 1] - ts[i] > rule.max_start:
            i += 1
            continue
        j = i + 1
        while j + 1 < len(ts) and ts[j + 1] - ts[j] <= rule.max_end:
            j += 1
        raw.append(list(ts[i : j + 1]))
        i = j
    merged = []
    for b in raw:
        if merged and b[0] - merged[-1][0][-1] < rule.max_int:
            merged[-1] = (merged[-1][0] + b, merged[-1][1] + 1)
        else:
            merged.append((b, 1))
    if rule.drop_lone_last and len(raw) > 1 and merged[-1][1] == 1:
        merged.pop()
    return [b for b, _ in merged if b[-1] - b[0] >= rule.min_dur and len(b) >= rule.min_count]


@pytest.mark.parametrize("rule", [
    bu.BurstRule(3, 2, 3, 6, 12), bu.BurstRule(2, 0, 2, 2, 3), bu.BurstRule(3, 0, 4, 8, 30, False), bu.BurstRule(5, 1, 6, 6, 6),
])
def test_bursts_equal_loop(spark, rule):
    tr = trains(7)
    df = frame(spark, tr)
    got = {}
    for r in bu.bursts(df, rule, 45).collect():
        got.setdefault(r.cluster_id, []).append((r.start_t, r.end_t, r.n_spikes))
    for u, ts in tr.items():
        want = [(b[0], b[-1], len(b)) for b in loop_bursts([int(t) for t in ts], rule)]
        assert sorted(got.get(u, [])) == sorted(want), u


def test_burst_rule_needs_ordered_thresholds():
    with pytest.raises(ValueError):
        bu.BurstRule(max_start=3, max_end=2)


def test_rb_violations_count_pairs_with_ties(spark):
    tr = trains(8)
    got = {r.cluster_id: r.rp_pairs for r in un.rb_violations(frame(spark, tr), 33, 6, 0, 400).collect()}
    for u, ts in tr.items():
        d = ts[None] - ts[:, None]
        assert got[u] == int(((d <= 6) & (np.arange(len(ts))[None] > np.arange(len(ts))[:, None])).sum())


def test_shuffled_trains_keep_intervals(spark):
    tr = trains(9)
    iv = un.intervals(frame(spark, tr), 50)
    got = {}
    for r in mo.shuffled_trains(iv, 1, 2, 3, 50).collect():
        got.setdefault((r.recording_id, r.cluster_id), []).append(r.t)
    for (_, u), ts in got.items():
        assert sorted(np.diff([0, *sorted(ts)])) == sorted(np.diff(tr[u]))


def test_slope_pvalue_matches_known_tails(spark):
    from pyspark.sql import functions as F

    # One degree of freedom: p = 1 - 2 atan(t) / pi; two: p = 1 - t / sqrt(2 + t^2).
    rows = [(t * t / (d + t * t), float(d), t) for t in (0.5, 2.0, 6.0) for d in (1, 2)]
    df = spark.createDataFrame(rows, "r2 double, dof double, t double").select("dof", "t", un.slope_pvalue(F.col("r2"), F.col("dof")).alias("p"))
    for r in df.collect():
        want = 1 - 2 * np.arctan(r.t) / np.pi if r.dof == 1 else 1 - r.t / np.sqrt(2 + r.t**2)
        assert r.p == pytest.approx(want, abs=1e-4)
