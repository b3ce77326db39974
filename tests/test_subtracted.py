"""Spikes of a chunk stream through a task in order, whatever the size of its batches."""

import numpy as np
import pytest

from spikeloom.operators import waveforms as wf

SIZE, LENGTH, CENTER = 20, 5, 2


def by_hand(signal, shapes, spikes):
    """Windows of a plain loop over the spikes of each chunk, larger troughs first; the signal of a chunk and its halo is its own."""
    out, n = [], signal.shape[1]
    for chunk in range(-(-n // SIZE)):
        mine, first = signal.copy(), chunk * SIZE - LENGTH
        for peak, i, m, t in sorted((shapes[m][1], i, m, t) for i, m, t in spikes if t // SIZE == chunk):
            best, _, lines = shapes[m]
            lo = t - CENTER
            whole = lo >= max(first, 0) and lo + LENGTH <= min((chunk + 1) * SIZE + LENGTH, n)
            for c, w in lines:
                out.append((i, c, mine[c, lo : lo + LENGTH].round(9).tolist() if whole else [0.0] * LENGTH))
            if whole:
                gain = peak / (mine[best, t] + 1e-10) + 1e-10
                for c, w in lines:
                    mine[c, lo : lo + LENGTH] -= np.array(w) / gain
    return sorted(out)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_subtracted_windows_match_a_plain_loop(spark, batch):
    rng = np.random.default_rng(2)
    signal = rng.normal(size=(3, 60)).round(3)
    templates = rng.normal(size=(4, 3, LENGTH)).round(3)
    spikes = [(i, int(rng.integers(4)), int(rng.integers(60))) for i in range(90)]
    shapes = {}
    for m, w in enumerate(templates):
        best = int(np.argmax(np.abs(w).sum(1)))
        lo = min(max(best - 1, 0), 1)
        shapes[m] = best, float(w[best].min()), [(c, w[c].tolist()) for c in range(lo, lo + 2)]
    chunks = spark.createDataFrame(
        [("r", c, k, signal[c, k * SIZE : (k + 1) * SIZE].tolist()) for c in range(3) for k in range(3)],
        "recording_id string, channel long, chunk long, samples array<double>",
    )
    given = spark.createDataFrame([(m, c, templates[m, c].tolist()) for m in range(4) for c in range(3)], "template_id long, channel long, waveform array<double>")
    trains = spark.createDataFrame([("r", *x) for x in [*spikes, (90, 0, None), (91, 0, 1000)]], "recording_id string, spike_id long, template_id long, t long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        made = wf.extract_channels(trains, chunks, given, SIZE, LENGTH, CENTER, 1, 3, True)
        got = sorted((r.spike_id, r.channel, np.round(r.waveform, 9).tolist()) for r in made.collect())
    finally:
        spark.conf.set(name, was)
    want = by_hand(signal, shapes, spikes)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    # Before, a task held all spikes of a chunk, each with its templates, as one table of objects.
    plan = made._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan
