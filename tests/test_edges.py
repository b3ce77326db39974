"""Edges of operators: signal ends, incomplete probes, undefined shapes, empty texts."""

import numpy as np

from spikeloom.operators import models as mo
from spikeloom.operators import population as po
from spikeloom.operators import waveforms as wf


def test_spike_at_the_edge_keeps_a_row_of_zeros(spark):
    chunks = spark.createDataFrame([("r", 0, k, [float(8 * k + i) for i in range(8)]) for k in range(2)], "recording_id string, channel long, chunk long, samples array<double>")
    templates = spark.createDataFrame([(7, 0, [0.0, -1.0, 0.0])], "template_id long, channel long, waveform array<double>")
    spikes = spark.createDataFrame([("r", i, 7, t) for i, t in enumerate((0, 1, 7, 14, 15))], "recording_id string, spike_id long, template_id long, t long")
    out = wf.extract_channels(spikes, chunks, templates, 8, 3, 1, 1, 1, subtract=False)
    assert {r.spike_id: r.waveform for r in out.collect()} == {
        0: [0.0] * 3, 1: [0.0, 1.0, 2.0], 2: [6.0, 7.0, 8.0], 3: [13.0, 14.0, 15.0], 4: [0.0] * 3,
    }


def test_incomplete_probe_has_no_density(spark):
    sig = spark.createDataFrame([(p, e, 0, 1.0) for p, n in ((0, 3), (1, 2)) for e in range(n)], "probe long, electrode int, idx long, v double")
    out = mo.source_estimate(sig, np.ones((2, 3)), ["probe"], "electrode").collect()
    assert {(r.probe, r.point): r.csd for r in out} == {(0, 0): 3.0, (0, 1): 3.0, (1, 0): None, (1, 1): None}


def test_crossings_and_slopes():
    y = np.array([[0.0, 2.0, -2.0, -2.0, 2.0, 0.0], [3.0, 3.0, 3.0, 3.0, 3.0, 3.0]])
    width, found = wf.level_crossings(y, np.zeros(2), np.ones(y.shape, bool))
    assert found.tolist() == [True, False] and width[0] == 2.0
    assert wf.slopes(np.array([[0.0, 1.0, 3.0, 5.0]] * 2), np.array([1, 3]), 3)[0] == 2.0
    assert np.isnan(wf.slopes(np.array([[0.0, 1.0, 3.0, 5.0]]), np.array([3]), 3)[0])


def test_template_shapes_of_mixed_lengths_keep_their_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64 + 16 * (i % 2)).tolist()) for i in range(9)]
    out = wf.template_properties(spark.createDataFrame(rows, "template_id long, waveform array<double>"), ["template_id"], 32).collect()
    for r in out:
        w = np.array(rows[r.template_id][1])
        y = wf.spline_matrix(len(w), 2) @ w
        assert r.min_x == y.argmin() / 2 and abs(r.center_y - y[64]) < 1e-9


def test_empty_text_has_no_phrase(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "aab")], "doc_id long, text string")
    out = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", po.lz_complexity("text"), po.lz_normalised(docs.text)).collect()}
    assert out[1] == (0, None) and out[2] == (0, None) and out[3][0] == po.lz_phrases("aab")
