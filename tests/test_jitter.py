from collections import Counter

import pytest

from spikeloom.operators import pairs

SCHEMA = "recording_id string, cluster_id long, spike_id long, t long, amplitude double"
TIMES = {1: [0, 3, 3, 10, 11, 40, -7], 2: [1, 3, 12, 12, 39], 3: [100]}


def frame(spark, times):
    rows = [(c, t) for c, ts in times.items() for t in ts]
    return spark.createDataFrame([("r", c, i, t, 1.0) for i, (c, t) in enumerate(rows)], SCHEMA)


def test_expected_counts_are_means_over_all_offsets(spark):
    width, size, jitter = 12, 4, 5
    n, total, square = Counter(), Counter(), Counter()
    for c1, c2 in ((1, 2), (1, 3), (2, 3)):
        for x in TIMES[c1]:
            for y in TIMES[c2]:
                if -width <= y - x < width:
                    n[c1, c2, (y - x + width) // size] += 1
                reach = Counter((y - x - u + width) // size for u in range(-jitter, jitter) if -width <= y - x - u < width)
                for k, hits in reach.items():
                    total[c1, c2, k] += hits
                    square[c1, c2, k] += hits * hits
    got = {(r.c1, r.c2, r.bin): r for r in pairs.jittered_histogram(frame(spark, TIMES), width, size, jitter).collect()}
    assert set(got) == set(total)
    for k, r in got.items():
        mean = total[k] / (2 * jitter)
        variance = mean - square[k] / (2 * jitter) ** 2
        assert r.n == n[k] and r.expected == pytest.approx(mean) and r.variance == pytest.approx(variance)
        assert (r.z is None) if variance <= 0 else r.z == pytest.approx((n[k] - mean) / variance**0.5)


def test_edges(spark):
    assert pairs.jittered_histogram(frame(spark, {1: [None, 5], 2: [None]}), 12, 4, 5).count() == 0
    assert pairs.jittered_histogram(frame(spark, TIMES).where("t > 1000"), 12, 4, 5).count() == 0
    with pytest.raises(ValueError):
        pairs.jittered_histogram(frame(spark, TIMES), 12, 5, 5)
