"""Composed reads against plain matrices."""

import numpy as np
import pytest

from spikeloom.operators import acquisition as aq
from spikeloom.operators import chunks as ch
from spikeloom.plans import load
from spikeloom.plans.registry import QUERIES
from spikeloom.session import checkpoint
from spikeloom.sources import recording

SIZE = 7


@pytest.fixture(scope="module")
def made(spark):
    """Two recordings of 12 channels; one channel ends early."""
    rng = np.random.default_rng(2)
    data = {(r, c): rng.normal(size=50 if (r, c) == ("b", 3) else 61) for r in "ab" for c in range(12)}
    rows = [(r, c, k, x[k * SIZE : (k + 1) * SIZE].tolist()) for (r, c), x in data.items() for k in range(-(-len(x) // SIZE))]
    chunks = spark.createDataFrame(rows, "recording_id string, channel long, chunk long, samples array<double>")
    channels = spark.createDataFrame([(r, c, 0.5 + c, 0.1 * c) for r, c in data], "recording_id string, channel long, coeff double, mean double")
    probes = spark.createDataFrame([(r, p, 4 * p, 4 * p + 4) for r in "ab" for p in range(3)], "recording_id string, probe long, lo long, hi long")
    scaled = {k: x * (0.5 + k[1]) - 0.1 * k[1] for k, x in data.items()}
    return chunks, channels, probes, scaled


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk):
        out.setdefault((r.recording_id, r.channel), []).append(np.array(r.samples))
    return {k: np.concatenate(v) for k, v in out.items()}


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k].shape == want[k].shape and np.allclose(got[k], want[k], atol=1e-9), k


@pytest.mark.parametrize("start,end", [(0, None), (0, 61), (5, 44), (7, 14), (13, 52), (60, None)])
def test_windows(made, start, end):
    chunks, _, _, scaled = made
    raw = whole(chunks)
    same(whole(aq.window(chunks, SIZE, start, end)), {k: x[start:end] for k, x in raw.items() if len(x[start:end])})


def test_windows_of_recordings(spark, made):
    chunks = made[0]
    table = spark.createDataFrame([("a", 3, 58), ("b", 10, 40)], "recording_id string, start long, stop long")
    at = {"a": (3, 58), "b": (10, 40)}
    raw = whole(chunks)
    same(whole(aq.window(chunks, SIZE, 2, None, table)), {k: x[at[k[0]][0] + 2 : at[k[0]][1]] for k, x in raw.items()})
    same(whole(aq.window(chunks, SIZE, 2, 9, table)), {k: x[at[k[0]][0] + 2 : at[k[0]][0] + 9] for k, x in raw.items()})


def referenced(scaled, fold, start=0, end=None):
    out = {}
    for (r, c), x in scaled.items():
        near = [scaled[r, d] for d in range(c // 4 * 4, c // 4 * 4 + 4)]
        ref = np.array([fold([y[i] for y in near if i < len(y)]) for i in range(len(x))])
        if len((x - ref)[start:end]):
            out[r, c] = (x - ref)[start:end]
    return out


@pytest.mark.parametrize("kind,fold", [("cmr", np.median), ("car", np.mean)])
def test_reference_range_and_map(spark, made, kind, fold):
    chunks, channels, probes, scaled = made
    want = referenced(scaled, fold, 5, 52)
    got = aq.acquired(chunks, SIZE, channels, probes, 1.0, only=(2, 6), start=5, end=52, reference=kind)
    same(whole(got), {k: v for k, v in want.items() if 2 <= k[1] < 6})
    turn = spark.createDataFrame([(p, k, (k + 1) % 4) for p in range(3) for k in range(4)], "probe long, channel long, mapped long")
    got = aq.acquired(chunks, SIZE, channels, probes, 1.0, only=(2, 6), start=5, end=52, reference=kind, mapped=turn)
    move = {c: c // 4 * 4 + (c + 1) % 4 for c in range(2, 6)}
    same(whole(got), {(r, c): want[r, m] for r in "ab" for c, m in move.items()})


def test_average_and_filter(made):
    chunks, channels, probes, scaled = made
    mean = {(r, 4 * p): np.mean([scaled[r, 4 * p + k] for k in range(4)], axis=0) for r in "ab" for p in range(3) if (r, p) != ("b", 0)}
    got = whole(aq.acquired(chunks, SIZE, channels, probes, 1.0, reference="none", average="mean"))
    same({k: v for k, v in got.items() if k != ("b", 0)}, mean)
    f = recording.FilterSettings("butterworth_zero", 2, 2.0, None, 10.0, None, sample_rate=32.0, notch_freq=8.0, notch_q=5.0)
    d = aq.acquired(chunks, SIZE, channels, probes, 32.0, reference="none", filtering=f)
    plain = checkpoint(aq.acquired(chunks, SIZE, channels, probes, 32.0, reference="none"))
    by_hand = ch.notched(checkpoint(ch.filtered(plain, SIZE, 32.0, "butterworth_zero", 2, 2.0, 10.0)), SIZE, 32.0, 8.0, 5.0)
    same(whole(d), whole(by_hand))


@pytest.mark.parametrize("near", [None, 1, 2])
def test_whitening(made, near):
    chunks, channels, probes, scaled = made
    want = {}
    for p in range(3):
        x = np.stack([scaled["a", 4 * p + k] for k in range(4)])
        w = np.zeros((4, 4))
        for c in range(4):
            at = np.arange(4) if near is None else np.arange(max(0, c - near), min(4, c + near + 1))
            w[c, at] = aq.inverse_root(x[at] @ x[at].T / len(at))[list(at).index(c)]
        want |= {("a", 4 * p + k): row for k, row in enumerate(w @ x)}
    got = whole(aq.acquired(chunks.where("recording_id = 'a'"), SIZE, channels, probes, 1.0, reference="none", whiten=True, neighbours=near))
    same(got, want)
    if near is None:
        x = np.stack([got["a", k] for k in range(4)])
        assert np.allclose(x @ x.T / 4, np.eye(4), atol=1e-6)


def test_whitened_query(spark):
    load()
    sf = "/root/testdata/sf0.001"
    got = {(r.channel, r.idx): r.v for r in QUERIES["acq_whitened_local"](spark, sf).collect()}
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.stack([np.array(r.embedding, float) * (0.5 + r.label / 10) for r in sorted(e, key=lambda r: r.vec_id)])
    x -= x.mean(axis=1, keepdims=True)
    for lo in (0, 448):
        p = x[lo : lo + 64]
        p = p - p.mean(axis=0)
        for c in range(len(p)):
            at = np.arange(max(0, c - 4), min(len(p), c + 5))
            w = aq.inverse_root(p[at] @ p[at].T / len(at))[list(at).index(c)]
            assert np.allclose([got[lo + c, i] for i in range(64)], w @ p[at], atol=2e-5)


def test_scan_reads_what_is_asked(spark, made, tmp_path):
    """Channel and time ranges are predicates of the parquet scan."""
    chunks, channels, probes, scaled = made
    recording.write_signal(chunks, str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    d = aq.acquired(stored, SIZE, channels, probes, 1.0, only=(2, 6), start=21, end=35, reference="none")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = d._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for part in ("GreaterThanOrEqual(chunk,3)", "LessThanOrEqual(chunk,4)", "GreaterThanOrEqual(channel,2)", "LessThan(channel,6)"):
        assert part in plan
    same(whole(d), {k: x[21:35] for k, x in scaled.items() if 2 <= k[1] < 6})


def test_empty_and_too_wide(spark, made, monkeypatch):
    chunks, channels, probes, _ = made
    assert aq.acquired(chunks.where("channel < 0"), SIZE, channels, probes, 1.0).count() == 0
    monkeypatch.setattr(aq, "MOST_CHANNELS", 3)
    with pytest.raises(Exception, match="channels in one probe"):
        aq.acquired(chunks, SIZE, channels, probes, 1.0, reference="none", whiten=True).collect()
