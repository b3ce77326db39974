"""Null models, fits, source density, autoregression, factorisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import chunks as ch
from spikeloom.operators import lattice as la
from spikeloom.operators import models as mo
from spikeloom.operators import pairs as pr
from spikeloom.operators import spikes as sp
from spikeloom.operators import units as un
from spikeloom.plans.q_units import ISI
from spikeloom.plans.registry import query

H, T, SEG = S.HOUR_US, S.STOP_US, S.SEGMENT_US
R = lambda c, n=6: F.round(c, n).alias(c)


def _iv(spark, sf):
    return un.intervals(S.spikes(spark, sf), SEG)


@query(
    "fit_interval_models",
    f"""WITH {S.SPK}, {ISI}, x AS (SELECT cluster_id, CAST(isi AS DOUBLE) / {H} AS x FROM iv WHERE isi > 0)
      SELECT cluster_id, count(*) AS n, round(min(x), 6) AS loc, round(avg(x) - min(x), 6) AS expon_scale, round(avg(ln(x)), 6) AS mu,
        round(stddev_pop(ln(x)), 6) AS sigma, round(avg(x), 6) AS ig_mean, round(1 / (avg(1 / x) - 1 / avg(x)), 6) AS ig_shape,
        round(avg(x) / (avg(x * ln(x)) - avg(ln(x)) * avg(x)), 6) AS gamma_shape FROM x GROUP BY 1""",
)
def _(spark, sf):
    d = mo.fit_intervals(_iv(spark, sf).withColumn("x", F.col("isi") / float(H)), ["cluster_id"], "x")
    return d.select("cluster_id", "n", *[R(c) for c in ("loc", "expon_scale", "mu", "sigma", "ig_mean", "ig_shape", "gamma_shape")])


@query("sttc_significance")
def _(spark, sf):
    return mo.sttc_significance(S.spikes(spark, sf), _iv(spark, sf), H, 0, T, SEG, 4, 42)


@query("intrinsic_timescale")
def _(spark, sf):
    lags = [i * 6 * H for i in range(8)]
    d = pr.lagged_sttc(S.spikes(spark, sf), 3 * H, lags, 0, T, SEG).where("lag > 0 and abs(sttc) < 1")
    return mo.exponential_decay(d, sp.UNIT, "lag", "sttc")


def _blocks(spark, sf):
    return ch.segments(S.signal_chunks(spark, sf), 16, 64, 64)


@query("sine_fit")
def _(spark, sf):
    return mo.sine_fit(_blocks(spark, sf), ["channel", "segment"], 1 / 64.0)


ELE = np.array([(i % 4, i // 4) for i in range(16)], float)
GRID = np.array([(0.5 + i, 0.5 + j) for j in range(3) for i in range(3)])
SRC = np.array([(i * 0.75 - 0.75, j * 0.75 - 0.75) for j in range(7) for i in range(7)])
EST, RES = mo.source_weights(ELE, GRID, SRC, 1.0, 1.0, 0.3, 0.01)


def _probe(spark, sf):
    return S.signal(spark, sf).select(
        F.expr("channel div 16").alias("probe"), F.expr("cast(channel % 16 as int)").alias("electrode"), "idx", "v"
    )


def _mat(name, cols, m):
    return f"{name}({cols}) AS (VALUES {', '.join(f'({p}, {e}, CAST({float(m[p, e])!r} AS DOUBLE))' for p in range(m.shape[0]) for e in range(m.shape[1]))})"


@query(
    "kcsd_estimate",
    f"""WITH {S.SIG}, {_mat('w', 'point, electrode, w', EST)} SELECT channel // 16 AS probe, point, idx, CASE WHEN count(*) = 16 THEN round(sum(v * w), 6) END AS csd
      FROM sig JOIN w ON electrode = channel % 16 GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return mo.source_estimate(_probe(spark, sf), EST, ["probe"], "electrode").select("probe", "point", "idx", R("csd"))


@query(
    "kcsd_cross_validation",
    f"""WITH {S.SIG}, {_mat('w', 'left_out, electrode, w', RES)}, r AS (SELECT channel // 16 AS probe, left_out, idx, CASE WHEN count(*) = 16 THEN sum(v * w) END AS e
      FROM sig JOIN w ON electrode = channel % 16 GROUP BY 1, 2, 3) SELECT probe, round(sum(e * e), 5) AS error FROM r GROUP BY 1""",
)
def _(spark, sf):
    return mo.cross_validation(_probe(spark, sf), RES, ["probe"], "electrode").select("probe", R("error", 5))


@query(
    "csd_basis_values",
    """WITH d AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 4 AS d FROM embeddings)
      SELECT vec_id, CASE WHEN d <= 0.5 THEN 1 / (pi() * 0.25) ELSE 0.0 END AS step_2d,
        round(exp(-d * d / (2 * (0.5 / 3) * (0.5 / 3))) / (2 * pi() * (0.5 / 3) * (0.5 / 3)), 8) AS gauss_2d,
        round(CASE WHEN d < 0.5 THEN exp(-d * d / (2 * (0.5 / 3) * (0.5 / 3))) / (sqrt(2 * pi()) * (0.5 / 3)) ELSE 0 END, 8) AS gauss_lim_1d FROM d""",
)
def _(spark, sf):
    d = S.table(spark, sf, "embeddings").select("vec_id", (F.abs(F.get("embedding", F.lit(0)).cast("double")) * 4).alias("d"))
    b = lambda k, n: mo.source_basis(F.col("d"), 0.5, k, n)
    return d.select("vec_id", b("step", 2).alias("step_2d"), F.round(b("gauss", 2), 8).alias("gauss_2d"), F.round(b("gauss_lim", 1), 8).alias("gauss_lim_1d"))


@query("electrode_duplicates", "SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    d = S.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("x"), F.col("c_mktsegment").alias("y"))
    return d.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "channel_distance_matrix",
    """WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
      SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d
      FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id""",
)
def _(spark, sf):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = S.table(spark, sf, "embeddings").select("label", "vec_id", e(0).alias("x"), e(1).alias("y"))
    return mo.distances(p, ["label"], "vec_id").select("i", "j", F.round("d", 6).alias("d"))


@query("mvar_least_squares")
def _(spark, sf):
    return mo.autoregression(_hours(spark, sf), ["recording_id"], 3, 5, 240)


def _hours(spark, sf):
    """One vector of all probes' counts an hour, from hour 0 of the table on."""
    h = S.hourly(spark, sf).groupBy("recording_id", "idx").agg(F.array_sort(F.collect_list(F.struct("channel", "v"))).alias("x"))
    return h.select("recording_id", "idx", F.transform("x", lambda r: r["v"]).alias("x"))


# Inverses and Sylvester equations are no SQL: tests run the recursions over the series themselves.
@query("arfit_order_search")
def _(spark, sf):
    return la.order_search(_hours(spark, sf), ["recording_id"], (1, 8), 5, 240)


@query("arfit_residual_test")
def _(spark, sf):
    return la.residual_test(_hours(spark, sf), ["recording_id"], 3, 20, 5, 240)


@query("mvar_nuttall_strand")
def _(spark, sf):
    return la.lattice(_hours(spark, sf), ["recording_id"], 3, 5, 240)


@query("mvar_vieira_morf")
def _(spark, sf):
    return la.lattice(_hours(spark, sf), ["recording_id"], 3, 5, 240, "vieira_morf")


@query("seqnmf")
def _(spark, sf):
    h = S.hourly(spark, sf)
    size = 120
    x = h.groupBy(F.expr(f"idx div {size}").alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "idx", "v"))), lambda r: r["v"]).alias("x")
    )
    w, _, costs = mo.sequence_factors(x, 5, size, 2, 6, 3, 0.001, 42)
    rows = [(int(i), int(k), int(j), float(w[i, k, j]), float(costs[-1])) for i in range(5) for k in range(2) for j in range(6)]
    return spark.createDataFrame(rows, "feature int, factor int, lag int, w double, cost double")


LARGE = " + ".join(f"({a}) * exp((-{k} * (x - {u}) * (x - {u}) - (y - {v}) * (y - {v})) / {w})" for a, k, u, v, w in mo.LARGE_2D)
SMALL = " + ".join(
    f"({a}) * exp(-(((x - {u}) / {mo.SMALL_2D_WIDTH[0]}) ** 2 + ((y - {v}) / {mo.SMALL_2D_WIDTH[1]}) ** 2) / 2)" for u, v, a in mo.SMALL_2D
)


@query(
    "csd_ground_truth",
    f"""WITH p AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS x, abs(CAST(embedding[2] AS DOUBLE)) AS y FROM embeddings)
      SELECT vec_id, round(0.5 * (exp(-(x - 0.7) * (x - 0.7) / 0.6) - exp(-(x - 0.3) * (x - 0.3) / 0.6)) / sqrt(2 * pi() * 0.3), 8) AS dipole,
        round({LARGE}, 8) AS large, round({SMALL}, 8) AS small FROM p""",
)
def _(spark, sf):
    e = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    d = S.table(spark, sf, "embeddings").select("vec_id", e(0).alias("x"), e(1).alias("y"))
    x, y = F.col("x"), F.col("y")
    return d.select(
        "vec_id", F.round(mo.dipole_1d(x), 8).alias("dipole"), F.round(mo.large_source_2d(x, y), 8).alias("large"),
        F.round(mo.small_source_2d(x, y), 8).alias("small"),
    )
