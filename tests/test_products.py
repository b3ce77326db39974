"""Sums of products of all pairs of channels, made block by block."""

import numpy as np
import pytest

from spikeloom.operators import signals as sg


@pytest.fixture(scope="module")
def channels(spark):
    """Channels of 12 samples in chunks of 5, of which some samples are null."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(9, 12))
    v[rng.random(v.shape) < 0.1] = np.nan
    rows = [("r", int(c) % 2, int(c), k, [None if np.isnan(x) else float(x) for x in v[c, 5 * k:5 * k + 5]]) for c in range(9) for k in range(3)]
    return v, spark.createDataFrame(rows, "recording_id string, label int, channel long, chunk long, samples array<double>")


@pytest.mark.parametrize("span, block", [(256, 2048), (1, 2), (2, 1)])
def test_products_of_common_samples(channels, span, block):
    v, chunks = channels
    got = {(r.i, r.j): r for r in sg.channel_products(chunks, ["label"], sg.SUMS, span, block).collect()}
    assert set(got) == {(i, j) for i in range(9) for j in range(i, 9) if i % 2 == j % 2}
    for (i, j), r in got.items():
        both = ~np.isnan(v[i]) & ~np.isnan(v[j])
        x, y = v[i][both], v[j][both]
        want = {"n": len(x), "sx": x.sum(), "sy": y.sum(), "sxy": x @ y, "sxx": x @ x, "syy": y @ y}
        assert all(np.isclose(r[c], want[c]) for c in want)


def test_no_pair_is_shuffled(channels):
    v, chunks = channels
    plan = sg.correlation_matrix(chunks, ["label"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    r = {(x.i, x.j): x.r for x in sg.correlation_matrix(chunks, ["label"]).collect()}
    both = ~np.isnan(v[0]) & ~np.isnan(v[2])
    assert np.isclose(r[0, 2], np.corrcoef(v[0][both], v[2][both])[0, 1])
