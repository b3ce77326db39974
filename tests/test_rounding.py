from spikeloom.plans.registry import rounded


def test_halves_of_the_scaled_value_are_those_of_the_sql(spark):
    import duckdb

    values = [2469680517145 / 74 / 1e6, -2469680517145 / 74 / 1e6, 0.0000005, 1.0000015, 33374.0610425, float("nan"), None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 6).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
    assert repr(got) == repr(want)
