import random

import pytest

from spikeloom.operators import blocks, pairs

SCHEMA = "recording_id string, cluster_id long, spike_id long, t long"


def trains(spark, n_units, n_spikes, stop, seed=1):
    r = random.Random(seed)
    rows = [(f"r{u % 2}", u, u * n_spikes + i, r.randrange(stop)) for u in range(n_units) for i in range(n_spikes)]
    return spark.createDataFrame(rows, SCHEMA), rows


def written(spark):
    """Rows that all stages so far put into shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_UNITS", 5)
    monkeypatch.setattr(blocks, "SLICE", 7)


def test_pairs_of_many_blocks_match_brute_force(spark, small_blocks):
    df, rows = trains(spark, 24, 6, 120)
    got = {(r.cluster1_id, r.cluster2_id): r for r in pairs.sttc(df, 4, 0, 120, 50).collect()}
    times = {u: [t for _, c, _, t in rows if c == u] for u in range(24)}
    assert set(got) == {(u, v) for u in range(24) for v in range(u + 1, 24) if u % 2 == v % 2}
    for (u, v), r in got.items():
        for x, y, n, k in ((u, v, r.n1_dt_2, r.n1_before_2), (v, u, r.n2_dt_1, r.n2_before_1)):
            assert n == sum(any(abs(b - a) <= 4 for b in times[y]) for a in times[x])
            assert k == sum(any(0 < b - a <= 4 for b in times[y]) and not any(-4 <= b - a <= 0 for b in times[y]) for a in times[x])


def test_matches_are_no_rows_of_a_shuffle(spark):
    df, _ = trains(spark, 120, 10, 100)
    df = df.cache()
    df.count()
    at = written(spark)
    assert pairs.sttc(df, 50, 0, 100, 100).where("n1_dt_2 >= 0").count() == 2 * 60 * 59 // 2
    assert written(spark) - at < 3 * 120 * 10


def test_several_windows_are_those_of_each(spark, small_blocks):
    df, _ = trains(spark, 14, 5, 120)
    both = {(r.cluster1_id, r.cluster2_id): r for r in pairs.sttc_windows(df, [4, 15], 0, 120, 50).collect()}
    for d, dt in enumerate((4, 15)):
        one = pairs.sttc(df, dt, 0, 120, 50).collect()
        assert len(one) == len(both)
        assert all(both[r.cluster1_id, r.cluster2_id][f"sttc_{d}"] == r.sttc for r in one)


def test_replicates_are_those_of_each(spark, small_blocks):
    from pyspark.sql import functions as F

    df, _ = trains(spark, 10, 5, 120)
    more = df.withColumn("replicate", F.lit(0)).unionByName(df.where("cluster_id > 2").withColumn("t", 119 - F.col("t")).withColumn("replicate", F.lit(1)))
    got = {(r.cluster1_id, r.cluster2_id): r for r in pairs.replicate_sttc(more, 2, 4, 0, 120, 50).collect()}
    for k in (0, 1):
        one = {(r.cluster1_id, r.cluster2_id): r.sttc for r in pairs.sttc(more.where(F.col("replicate") == k), 4, 0, 120, 50).collect()}
        assert {p for p, r in got.items() if r[f"has_{k}"]} == set(one)
        assert all(got[p][f"sttc_{k}"] == v for p, v in one.items())


def test_shared_periods_are_counted_across_blocks(spark, small_blocks, monkeypatch):
    from spikeloom.operators import population

    members = [(u, p) for u in range(12) for p in range(6) if (u * 7 + p * 5) % 3]
    df = spark.createDataFrame([("r", p, u) for u, p in members], "recording_id string, period long, cluster_id long")
    monkeypatch.setattr(population, "period_members", lambda periods, rates: df)
    got = {(r.c1, r.c2): r.connectivity for r in population.co_participation(None, None).collect()}
    have = {u: {p for v, p in members if v == u} for u in range(12)}
    want = {(u, v): len(have[u] & have[v]) for u in range(12) for v in range(u + 1, 12)}
    assert got == {k: n for k, n in want.items() if n}
