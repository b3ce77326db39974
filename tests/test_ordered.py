"""Stretch-wise sequence operators against pandas on the whole sequence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spikeloom.operators.ordered import in_order, rolling, run_number
from spikeloom.operators.skew import attach, hot_keys, salted_join


def table(spark, seed=0, n=900):
    rng = np.random.default_rng(seed)
    unit = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))  # one hot unit
    pdf = pd.DataFrame({"u": unit, "t": rng.integers(0, 3000, n), "id": np.arange(n), "x": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf, "u long, t long, id long, x double")


@pytest.mark.parametrize("length", [7, 100, 10_000])
def test_in_order_equals_whole_sequence(spark, length):
    pdf, df = table(spark)
    got = in_order(
        df, ["u"], "t", length, tie=["id"], lag={"p": "t"}, lag2={"pp": "t"}, lead={"n": "x"}, index="k", total="m",
        running={"run": run_number(F.col("p").isNull() | (F.col("t") - F.col("p") > 20))},
    ).toPandas().sort_values("id").reset_index(drop=True)
    s = pdf.sort_values(["u", "t", "id"])
    g = s.groupby("u")
    want = s.assign(p=g.t.shift(1), pp=g.t.shift(2), n=g.x.shift(-1), k=g.cumcount(), m=g.t.transform("size"))
    want["run"] = (want.p.isna() | (want.t - want.p > 20)).groupby(want.u).cumsum().astype(int)
    want = want.sort_values("id").reset_index(drop=True)
    for c in ("p", "pp", "n", "k", "m", "run"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, err_msg=c)


def test_rolling_equals_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"u": np.repeat([0, 1], 200), "t": np.tile(np.arange(200), 2), "x": rng.normal(size=400)})
    df = spark.createDataFrame(pdf, "u long, t long, x double")
    got = rolling(df, ["u"], "t", 30, 4, 6, {"m": lambda f: F.avg("x").over(f)}).toPandas().sort_values(["u", "t"])
    want = pdf.groupby("u").x.transform(lambda s: pd.Series([s.values[max(0, i - 4) : i + 7].mean() for i in range(len(s))], s.index))
    np.testing.assert_allclose(got.m.values, want.values)


def test_salted_join_keeps_every_pair_of_a_hot_key(spark):
    pdf, df = table(spark)
    few = spark.createDataFrame([(i, i * 10) for i in range(12)] + [(0, 1)], "u long, w long")
    got = salted_join(df, few, ["u"], F.col("id"), share=8)
    want = pdf.merge(pd.DataFrame([(i, i * 10) for i in range(12)] + [(0, 1)], columns=["u", "w"]), on="u")
    assert got.count() == len(want)
    assert got.agg(F.sum("w")).first()[0] == want.w.sum()
    hot = hot_keys(df, ["u"], share=8).collect()
    assert [r.u for r in hot] == [0] and len(hot) <= 8
    assert attach(df, few.where("w <> 1"), ["u"]).count() == len(pdf)
