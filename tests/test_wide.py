"""Pairs of units by blocks that are wider than what a task counts at once, and counts of ranges by products."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spikeloom.operators import blocks, pairs

SCHEMA = "recording_id string, cluster_id long, spike_id long, t long"


def trains(spark, n_units, n_spikes, stop, seed=3):
    r = random.Random(seed)
    rows = [("r", u, u * n_spikes + i, r.randrange(stop)) for u in range(n_units) for i in range(n_spikes)]
    return spark.createDataFrame(rows, SCHEMA), rows


def written(spark):
    """Rows that all stages so far put into shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture
def wide(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_UNITS", 2)
    monkeypatch.setattr(blocks, "WIDE_UNITS", 50, raising=False)
    monkeypatch.setattr(blocks, "BLOCKS", 3, raising=False)


def test_copies_of_spikes_are_bounded(spark, wide):
    """Before, a spike was copied once per block of few units: 30 times here, so that 30 x 30 x 16 packs were written."""
    df, _ = trains(spark, 60, 8, 300)
    df = df.cache()
    df.count()
    at = written(spark)
    assert pairs.correlation_index(df, 5, 0, 300).count() == 60 * 59 // 2
    assert written(spark) - at < 3000


def test_wide_blocks_match_brute_force(spark, wide):
    df, rows = trains(spark, 23, 6, 120)
    times = {u: sorted(t for _, c, _, t in rows if c == u) for u in range(23)}
    both = [(u, v) for u in range(23) for v in range(u + 1, 23)]
    got = {(r.c1, r.c2): r.n_pairs for r in pairs.correlation_index(df, 4, 0, 120).collect()}
    assert got == {(u, v): sum(abs(x - y) <= 4 for x in times[u] for y in times[v]) for u, v in both}
    circle = {(r.c1, r.c2, r.shift): r.n for r in pairs.circular_coincidence(df, 5, 120, 2).collect()}
    bins = {u: {t // 5 for t in v} for u, v in times.items()}
    want = {(u, v, s): len(bins[u] & {(b + s) % 24 for b in bins[v]}) for u, v in both for s in (0, 1)}
    assert circle == {k: n for k, n in want.items() if n}
    spikes = sorted((r.c1, r.c2, r.s1, r.s2, r.diff) for r in pairs.differences(df, 6).collect())
    assert spikes == sorted((c, d, s, r, y - x) for _, c, s, x in rows for _, d, r, y in rows if c < d and -6 <= y - x < 6)


def test_null_columns_of_spikes_stay_with_their_spikes(spark, wide):
    df, rows = trains(spark, 9, 4, 60)
    some = df.selectExpr("recording_id", "cluster_id", "if(spike_id % 3 = 0, null, spike_id) AS spike_id", "t")
    got = sorted(((r.c1, r.c2, r.s1 or -1, r.s2 or -1, r.diff) for r in pairs.differences(some, 9).collect()))
    name = lambda s: -1 if s % 3 == 0 else s
    assert got == sorted((c, d, name(s), name(r), y - x) for _, c, s, x in rows for _, d, r, y in rows if c < d and -9 <= y - x < 9)


def test_columns_wanted(spark, wide):
    df, _ = trains(spark, 11, 5, 90)
    every = pairs.sttc_windows(df, [3, 9], 0, 90, 40)
    few = pairs.sttc_windows(df, [3, 9], 0, 90, 40, counts=["n1_dt_2_1"])
    assert few.columns == ["recording_id", "cluster1_id", "cluster2_id", "sttc_0", "sttc_1", "n1_dt_2_1"]
    assert sorted(map(str, every.select(few.columns).collect())) == sorted(map(str, few.collect()))


@pytest.mark.parametrize("few_ends", [False, True])
def test_counts_of_ranges(few_ends, monkeypatch):
    """Ranges that overlap, are empty or end before they begin, counted by products of cells, are those of a plain count."""
    rng = np.random.default_rng(5)
    column, n = rng.integers(0, 30, 4000), 1500
    first = rng.integers(0, 40, n) * 100 if few_ends else rng.integers(0, 4000, n)
    end = first + (rng.integers(0, 9, n) * 100 if few_ends else rng.integers(-200, 900, n))
    end = np.clip(end, 0, 4000)
    row = rng.integers(0, 20, n)
    want = np.zeros((20, 30), np.int64)
    for f, e, r in zip(first, end, row):
        np.add.at(want[r], column[f : max(e, f)], 1)
    listed, plain = [], blocks.sliced
    monkeypatch.setattr(blocks, "sliced", lambda size: listed.append(int(size.sum())) or plain(size))
    assert (blocks.counted(first, end, row, column, (20, 30)) == want).all()
    # Before, every place of every range was listed.
    assert sum(listed) < want.sum() / 10
    assert (blocks.counted(first[:0], end[:0], row[:0], column, (20, 30)) == 0).all()


def test_equal_times_of_many_units_are_not_listed(monkeypatch):
    rng = np.random.default_rng(6)
    ids = rng.permutation(40) * 3
    held = [(int(u), int(b)) for u in ids for b in np.flatnonzero(rng.random(30) < 0.6)]
    units = pa.array([[{"cluster_id": int(u)} for u in ids]], pa.list_(pa.struct([("cluster_id", pa.int64())])))
    cols = [pa.array([[x[k] for x in held]], pa.list_(pa.int64())) for k in (0, 1)]
    block = blocks.Block(pa.table({"_block": [0], "_units": units, "_spike_cluster_id": cols[0], "_spike_t": cols[1]}), 0)
    monkeypatch.setattr(blocks, "sliced", lambda size: [] if not size.sum() else pytest.fail("places were listed"))
    got = blocks.equal_times(block, block, 2, 30)
    bins = {u: {b for v, b in held if v == u} for u in block.ids.tolist()}
    assert got.tolist() == [[len(bins[u] & {(b + 2) % 30 for b in bins[v]}) for v in bins] for u in bins]
