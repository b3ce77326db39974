"""Lagged products by stretches against all pairs of samples."""

import numpy as np

from spikeloom.operators import signals as sg


def test_lagged_products_with_gaps(spark):
    rng = np.random.default_rng(7)
    a = {(c, int(i)): float(rng.normal()) for c in "pq" for i in rng.choice(np.arange(-40, 90), 70, replace=False)}
    b = {(c, int(i)): float(rng.normal()) for c in "pq" for i in rng.choice(np.arange(-40, 90), 90, replace=False)}
    frame = lambda d: spark.createDataFrame([(c, i, v) for (c, i), v in d.items()] + [("p", 500, None)], "channel string, idx long, v double")
    got = {(r.channel, r.lag): r for r in sg.lagged_products(frame(a), frame(b), 9, ["channel"], length=16).collect()}
    for c in "pq":
        for lag in range(-9, 10):
            x, y = np.array([(v, b[c, i + lag]) for (k, i), v in a.items() if k == c and (c, i + lag) in b]).T
            r = got[c, lag]
            assert r.n == len(x) and np.allclose([r.sxy, r.sx, r.sy, r.sxx, r.syy], [x @ y, x.sum(), y.sum(), x @ x, y @ y])
    assert len(got) == 38


def test_no_samples(spark):
    none = spark.createDataFrame([], "channel string, idx long, v double")
    assert sg.lagged_products(none, none, 3, ["channel"]).count() == 0
