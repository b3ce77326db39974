from spikeloom.operators import waveforms as wf


def test_parts_of_a_chunk_cut_the_same_windows(spark, monkeypatch):
    chunks = spark.createDataFrame(
        [("r", c, k, [float((c * 31 + k * 20 + i) ** 2 % 17) for i in range(20)]) for c in range(3) for k in range(2)],
        "recording_id string, channel long, chunk long, samples array<double>",
    )
    templates = spark.createDataFrame(
        [(m, c, [float((m + c + i) % 5 - 3) for i in range(5)]) for m in range(2) for c in range(3)],
        "template_id long, channel long, waveform array<double>",
    )
    spikes = spark.createDataFrame([("r", i, i % 2, (i * 7) % 40) for i in range(30)], "recording_id string, spike_id long, template_id long, t long")
    cut = lambda: sorted(map(tuple, wf.extract_channels(spikes, chunks, templates, 20, 5, 2, 1, 3, False).collect()))
    whole = cut()
    monkeypatch.setattr(wf, "PART", 4)
    assert len({r[1] for r in whole}) == 30 and cut() == whole
