"""Fits of small curves use every partition of a shuffle, and estimators share one pass."""

import numpy as np

from spikeloom.operators import lfp
from spikeloom.operators import models as mo
from spikeloom.operators import spectral as sc


def test_fits_are_spread(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    curves = spark.createDataFrame([(u, float(x), float(np.exp(-x / 3) + u)) for u in range(9) for x in range(6)], "u int, x double, y double")
    fits = mo.exponential_decay(curves, ["u"], "x", "y")
    assert fits.rdd.getNumPartitions() == n and fits.count() == 9
    cells = lfp.grid_counts(curves, ["u"], "y", 0.0, 16)
    assert lfp.density(cells, ["u"], 16).rdd.getNumPartitions() == n


def test_lines_in_one_pass(spark):
    rng = np.random.default_rng(2)
    psd = spark.createDataFrame([(c, float(f), float(10 ** (1 - 0.1 * f + rng.normal() / 9))) for c in range(3) for f in range(12)], "channel int, freq double, p double")
    lines = sc.robust_lines(psd, ["channel"], ["andrew", "huber"])
    assert lines._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r.channel, r.estimator): (r.slope, r.intercept) for r in lines.collect()}
    for norm in ("andrew", "huber"):
        for r in sc.robust_line(psd, ["channel"], norm).collect():
            assert got[r.channel, norm] == (r.slope, r.intercept)
            assert abs(r.slope + 0.1) < 0.05
