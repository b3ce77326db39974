import numpy as np
import pytest

from spikeloom import schema as S
from spikeloom.sources import export, npy, recording


def test_npy_rows_and_sorted_spikes(spark, tmp_path):
    n = 2500
    rng = np.random.default_rng(0)
    t = np.sort(rng.integers(1, 10**6, n))
    np.save(tmp_path / "spike_times.npy", t)
    np.save(tmp_path / "spike_clusters.npy", (np.arange(n) % 3).astype(np.int32))
    np.save(tmp_path / "spike_templates.npy", (np.arange(n) % 5).astype(np.uint16))
    np.save(tmp_path / "amplitudes.npy", rng.normal(size=(n, 1)))
    np.save(tmp_path / "templates.npy", rng.normal(size=(4, 6, 3)).astype(np.float32))
    s = npy.sorted_spikes(spark, str(tmp_path), "r").orderBy("spike_id").toPandas()
    assert (s.t.values == t - 1).all() and (s.cluster_id.values == np.arange(n) % 3).all()
    a = np.load(tmp_path / "templates.npy")
    for r in npy.templates(spark, str(tmp_path)).collect():
        np.testing.assert_allclose(r.waveform, a[r.template_id, :, r.channel])
    units = npy.accepted_units(spark, str(tmp_path), npy.sorted_spikes(spark, str(tmp_path), "r"))
    assert all(r.accepted for r in units.collect())
    np.save(tmp_path / "accepted_units.npy", np.array([True, False, True]))
    units = npy.accepted_units(spark, str(tmp_path), npy.sorted_spikes(spark, str(tmp_path), "r"))
    assert {r.cluster_id: r.accepted for r in units.collect()} == {0: True, 1: False, 2: True}


def test_npy_partitions(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(20).reshape(10, 2))
    r = npy.NpyReader(str(tmp_path / "a.npy"), 4)
    rows = [x for p in r.partitions() for x in r.read(p)]
    assert len(r.partitions()) == 3 and rows[7] == (7, [14.0, 15.0])


def test_signal_round_trip_and_slice(spark, tmp_path):
    x = np.arange(3 * 50).reshape(3, 50).astype(float)
    df = spark.createDataFrame([("r", c, i, x[c, i * 8 : (i + 1) * 8].tolist()) for c in range(3) for i in range(7)], S.SIGNAL_CHUNK)
    recording.write_signal(df, str(tmp_path / "sig"))
    got = recording.read_signal(spark, str(tmp_path / "sig"), 8, channels=(1, 3), samples=(5, 21)).orderBy("channel", "chunk").collect()
    for c in (1, 2):
        np.testing.assert_array_equal(np.concatenate([r.samples for r in got if r.channel == c]), x[c, 5:21])


def test_raw_export(spark, tmp_path):
    x = np.random.default_rng(1).integers(-3000, 3000, (3, 50)).astype(np.int16)
    df = spark.createDataFrame([("r", c, i, x[c, i * 8 : (i + 1) * 8].astype(float).tolist()) for c in range(3) for i in range(7)], S.SIGNAL_CHUNK)
    path = str(tmp_path / "raw.bin")
    export.write_raw(df, path, 3, 8)
    np.testing.assert_array_equal(np.fromfile(path, "<i2").reshape(50, 3), x.T)


def test_curation_tables_and_rounding(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 123456.789, -0.00123456)], "cluster_id long, channel int, center_y double, start_y double")
    t = export.curation_tables(df)
    assert set(t) == {"cluster_info", "cluster_Amplitude", "cluster_ContamPct", "cluster_KSLabel"}
    r = export.rounded(df).first()
    assert (r.center_y, r.start_y) == pytest.approx((123500.0, -0.001235))
    export.write_tsv(df, str(tmp_path / "info"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "info"))
    assert back.columns == ["cluster_id", "channel", "center_y", "start_y"]


def test_settings_and_maps(spark, tmp_path):
    p = str(tmp_path / "settings")
    recording.save_settings(spark, "r", "lfp", recording.LFP_FILTER, p)
    recording.save_settings(spark, "r", "welch", recording.WelchSettings(), p)
    assert recording.load_settings(spark, "r", "lfp", recording.FilterSettings, p) == recording.LFP_FILTER
    assert recording.load_settings(spark, "r", "welch", recording.WelchSettings, p) == recording.WelchSettings()
    recording.save_settings(spark, "r", "lfp", recording.SPIKE_FILTER, p)
    assert recording.load_settings(spark, "r", "lfp", recording.FilterSettings, p) == recording.SPIKE_FILTER
    with pytest.raises(KeyError):
        recording.load_settings(spark, "other", "lfp", recording.FilterSettings, p)
    with pytest.raises(ValueError):
        recording.map_frame(spark, [0, 0, 1], "a")
    (tmp_path / "map.csv").write_text("2\n0\n1\n")
    assert [r.mapped for r in recording.channel_map(spark, str(tmp_path / "map.csv"), "a").orderBy("channel").collect()] == [2, 0, 1]


def test_csv_tables_are_tagged(spark, tmp_path):
    for k in ("m1", "m2"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "spike-properties-x.csv").write_text("cluster_id,fr\n1,2.5\n2,3.5\n")
    d = recording.csv_tables(spark, str(tmp_path / "*" / "spike-properties-*.csv"))
    assert sorted((r.id, r.cluster_id) for r in d.collect()) == [("m1", 1), ("m1", 2), ("m2", 1), ("m2", 2)]


def test_npy_export_round_trip(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(40, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, a[i].astype(float).tolist()) for i in range(40)], "row long, value array<double>").repartition(5)
    path = str(tmp_path / "w.npy")
    export.write_npy(df, path, (40, 2, 3))
    np.testing.assert_array_equal(np.load(path), a.reshape(40, 2, 3))
