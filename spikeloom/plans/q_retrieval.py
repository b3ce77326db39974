"""Spike retrieval, binning, rasters, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import spikes as sp
from spikeloom.plans.registry import query

H = S.HOUR_US
D = S.DAY_US
LO, HI = 3 * D, 20 * D
KEEP = ["cluster_id", "spike_id", "t", "amplitude"]
WITH = f"WITH {S.SPK} "


@query("spike_window_strict", WITH + f"SELECT cluster_id, spike_id, t, amplitude FROM spk WHERE t > {LO} AND t < {HI}")
def _(spark, sf):
    return sp.strict_window(S.spikes(spark, sf), LO, HI).select(*KEEP)


@query("spike_window_inclusive", WITH + f"SELECT cluster_id, spike_id, t, amplitude FROM spk WHERE t BETWEEN {LO} AND {HI}")
def _(spark, sf):
    return sp.inclusive_window(S.spikes(spark, sf), LO, HI).select(*KEEP)


@query(
    "spike_trains_nested",
    WITH + f"""SELECT cluster_id, t // {5 * D} AS stretch, count(*) AS n,
      string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS times FROM spk GROUP BY 1, 2""",
)
def _(spark, sf):
    return sp.trains(S.spikes(spark, sf), 5 * D).select(
        "cluster_id", "stretch", F.size("times").cast("bigint").alias("n"), F.array_join("times", ",").alias("times")
    )


@query(
    "index_to_time",
    WITH + "SELECT spike_id, t AS samples, t / 1000.0 AS ms, t / 1000000.0 AS sec FROM spk",
)
def _(spark, sf):
    d = S.spikes(spark, sf)
    return d.select(
        "spike_id",
        sp.index_to_time("t", 1e6, "samples").alias("samples"),
        sp.index_to_time("t", 1e6, "ms").alias("ms"),
        sp.index_to_time("t", 1e6, "sec").alias("sec"),
    )


@query("cluster_templates", WITH + "SELECT DISTINCT cluster_id, probe AS template_id FROM spk")
def _(spark, sf):
    return sp.cluster_templates(S.spikes(spark, sf).withColumn("template_id", F.col("probe"))).drop("recording_id")


@query("binary_spikes", WITH + f"SELECT DISTINCT cluster_id, t // {H} AS t FROM spk")
def _(spark, sf):
    return sp.binary(S.spikes(spark, sf).withColumn("t", F.expr(f"t div {H}"))).drop("recording_id")


BINS = f"""bins AS (
  SELECT u.cluster_id, b.i AS bin, coalesce(n.n, 0) AS n
  FROM (SELECT DISTINCT cluster_id FROM spk) u CROSS JOIN range(120) b(i)
  LEFT JOIN (SELECT cluster_id, t // {6 * H} AS bin, count(DISTINCT t) AS n FROM spk GROUP BY 1, 2) n
    ON n.cluster_id = u.cluster_id AND n.bin = b.i)"""


@query("binned_counts_spine", f"WITH {S.SPK}, {BINS} SELECT cluster_id, bin, n FROM bins")
def _(spark, sf):
    s = S.spikes(spark, sf)
    return sp.with_spine(sp.bin_counts(s, 6 * H), s, 120).select("cluster_id", "bin", "n")


@query("raster_int", WITH + f"SELECT cluster_id, least(t // {6 * H}, 99) AS bin, count(*) AS n FROM spk GROUP BY 1, 2")
def _(spark, sf):
    return sp.raster(S.spikes(spark, sf), 6 * H, 600 * H, dtype="int").drop("recording_id")


@query("raster_bool", WITH + f"SELECT DISTINCT cluster_id, t // {6 * H} AS bin, CAST(1 AS BIGINT) AS n FROM spk")
def _(spark, sf):
    return sp.raster(S.spikes(spark, sf), 6 * H, 720 * H).drop("recording_id")


@query(
    "raster_jitter_dilated",
    WITH + f"""SELECT cluster_id, bin + o.i AS bin, count(*) AS n
      FROM (SELECT DISTINCT cluster_id, t // {6 * H} AS bin FROM spk) CROSS JOIN range(-2, 3) o(i)
      WHERE bin + o.i BETWEEN 0 AND 119 GROUP BY 1, 2""",
)
def _(spark, sf):
    return sp.raster(S.spikes(spark, sf), 6 * H, 720 * H, jitter=10 * H).drop("recording_id")


@query(
    "accepted_units_semi",
    WITH + "SELECT cluster_id, spike_id, t, amplitude FROM spk WHERE cluster_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def _(spark, sf):
    return sp.accepted_only(S.spikes(spark, sf), units(spark, sf)).select(*KEEP)


def units(spark, sf):
    """Customers as unit metadata: positive balance = accepted, segment decides the cell type."""
    seg = F.col("c_mktsegment")
    return S.table(spark, sf, "customer").select(
        F.lit("events").alias("recording_id"),
        F.col("c_custkey").alias("cluster_id"),
        (F.col("c_acctbal") > 0).alias("accepted"),
        F.when(seg.isin("BUILDING", "MACHINERY"), "int").otherwise("pyr").alias("cell_type"),
    )


UNITS = """units AS (
  SELECT c_custkey AS cluster_id, c_acctbal > 0 AS accepted,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'int' ELSE 'pyr' END AS cell_type
  FROM customer)"""


@query(
    "expand_by_count",
    "SELECT p_partkey, r.i AS copy FROM part JOIN range(1, 1000) r(i) ON r.i <= p_size",
)
def _(spark, sf):
    d = sp.expand(S.table(spark, sf, "part").select("p_partkey", "p_size"), "p_size")
    return d.select("p_partkey", F.col("copy").cast("bigint").alias("copy"))


@query(
    "runs_of_activity",
    f"""WITH {S.SPK}, on_ AS (SELECT DISTINCT cluster_id, t // {6 * H} AS bin FROM spk),
      g AS (SELECT *, bin - row_number() OVER (PARTITION BY cluster_id ORDER BY bin) AS k FROM on_)
      SELECT cluster_id, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS length
      FROM g GROUP BY cluster_id, k HAVING max(bin) < 119""",
)
def _(spark, sf):
    cells = sp.raster(S.spikes(spark, sf), 6 * H, 720 * H)
    return sp.activity_runs(cells, sp.UNIT, 120, 20).drop("recording_id", "run")


def _rate_sql(weights):
    vals = ", ".join(f"({i}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(weights))
    return f"w(m, w) AS (VALUES {vals})"


BOX = sp.smoothing_window("boxcar", 0.5, 4)
GAUSS = sp.smoothing_window("gaussian", 0.5, 4)
CNT = f"cnt AS (SELECT cluster_id, t // {6 * H} AS bin, count(DISTINCT t) AS n FROM spk GROUP BY 1, 2)"


def _convolved(weights):
    return f"""WITH {S.SPK}, {CNT}, {_rate_sql(weights)}
      SELECT cluster_id, bin + m - {len(weights) // 2} AS bin, round(sum(n * w), 6) AS rate
      FROM cnt CROSS JOIN w WHERE bin + m - {len(weights) // 2} BETWEEN 0 AND 119 GROUP BY 1, 2"""


def _rate(spark, sf, weights, method="convolve"):
    c = sp.bin_counts(S.spikes(spark, sf), 6 * H)
    return sp.smoothed_rate(c, weights, 120, method).select("cluster_id", "bin", F.round("rate", 6).alias("rate"))


@query("rate_boxcar", _convolved(BOX))
def _(spark, sf):
    return _rate(spark, sf, BOX)


@query("rate_gaussian", _convolved(GAUSS))
def _(spark, sf):
    return _rate(spark, sf, GAUSS)


ABI = sp.smoothing_window("exponential_abi", 0.5, 4)


@query("rate_exponential_causal", _convolved(ABI))
def _(spark, sf):
    return _rate(spark, sf, ABI)


@query(
    "rate_add_window",
    f"""WITH {S.SPK}, {CNT}, {_rate_sql(GAUSS)},
      p AS (SELECT cluster_id, bin, greatest(bin - {len(GAUSS) // 2}, 0) AS lo FROM cnt)
      SELECT cluster_id, lo + m AS bin, round(sum(w), 6) AS rate FROM p CROSS JOIN w
      WHERE lo + m < bin + {len(GAUSS) // 2} AND lo + m < 120 GROUP BY 1, 2""",
)
def _(spark, sf):
    return _rate(spark, sf, GAUSS, "add")


@query(
    "rate_set_window",
    f"""WITH {S.SPK}, {CNT}, {_rate_sql(GAUSS)},
      p AS (SELECT cluster_id, bin, greatest(bin - {len(GAUSS) // 2}, 0) AS lo FROM cnt)
      SELECT cluster_id, lo + m AS bin, round(arg_max(w, bin), 6) AS rate FROM p CROSS JOIN w
      WHERE lo + m < bin + {len(GAUSS) // 2} AND lo + m < 120 GROUP BY 1, 2""",
)
def _(spark, sf):
    return _rate(spark, sf, GAUSS, "set")


@query(
    "population_rate",
    f"""WITH {S.SPK}, {CNT}, {_rate_sql(BOX)}
      SELECT bin + m - {len(BOX) // 2} AS bin, round(sum(n * w), 6) AS rate
      FROM cnt CROSS JOIN w WHERE bin + m - {len(BOX) // 2} BETWEEN 0 AND 119 GROUP BY 1""",
)
def _(spark, sf):
    c = sp.bin_counts(S.spikes(spark, sf), 6 * H).groupBy("recording_id", "bin").agg(F.sum("n").alias("n"))
    return sp.smoothed_rate(c, BOX, 120, keys=["recording_id"]).select("bin", F.round("rate", 6).alias("rate"))


@query(
    "ei_balance",
    f"""WITH {S.SPK}, {UNITS}, b AS (
        SELECT bin, count(*) FILTER (cell_type = 'pyr') AS pyr, count(*) FILTER (cell_type = 'int') AS inh
        FROM (SELECT DISTINCT cluster_id, t, t // {6 * H} AS bin FROM spk) JOIN units USING (cluster_id) GROUP BY 1),
      k AS (SELECT count(*) FILTER (cell_type = 'pyr') AS np, count(*) FILTER (cell_type = 'int') AS ni FROM units),
      d AS (SELECT pyr / np - inh / ni AS d FROM b CROSS JOIN k)
      SELECT round(sum(d), 6) AS balance_sum, round(sum(d) / 120, 6) AS balance_mean,
        round(sqrt(sum(d * d) / 120 - (sum(d) / 120) * (sum(d) / 120)), 6) AS balance_std FROM d""",
)
def _(spark, sf):
    c = sp.bin_counts(S.spikes(spark, sf), 6 * H)
    d = sp.ei_balance(c, units(spark, sf), 120)
    return d.select(*[F.round(x, 6).alias(x) for x in ("balance_sum", "balance_mean", "balance_std")])
