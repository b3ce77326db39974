"""Merging of burst spans and their complement."""

from spikeloom.operators import lfp


def frame(spark, rows):
    return spark.createDataFrame([("r", c, a, b) for c, a, b in rows], f"{lfp.CHAN[0]} string, {lfp.CHAN[1]} long, start long, end long")


def test_nested_spans(spark):
    got = lfp.merge_overlaps(frame(spark, [(1, 0, 100), (1, 10, 20), (1, 30, 40), (1, 100, 120), (1, 200, 210), (1, 200, 205), (2, 5, 6), (2, 5, 6)]), 25)
    assert sorted((r[1], r.start, r.end) for r in got.collect()) == [(1, 0, 120), (1, 200, 210), (2, 5, 6)]


def test_channel_without_bursts(spark):
    bursts, channels = frame(spark, [(1, 10, 20)]), frame(spark, [(1, 0, 0), (2, 0, 0)])
    got = lfp.baseline_periods(bursts, 50, 25, channels)
    assert sorted((r[1], r.start, r.end) for r in got.collect()) == [(1, 0, 10), (1, 20, 50), (2, 0, 50)]
