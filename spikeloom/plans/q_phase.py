"""Spike-phase, phase-amplitude and field-potential event queries.

The phase of a spike is its time of day; field potentials are hourly counts.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import chunks as ch
from spikeloom.operators import lfp
from spikeloom.operators import phase as ph
from spikeloom.operators import signals as sg
from spikeloom.plans.q_spectral import CWT, cwt
from spikeloom.plans.registry import query

D, H = S.DAY_US, S.HOUR_US
R = lambda c, n=6: F.round(c, n).alias(c)
PHS = f"phs AS (SELECT *, 2 * pi() * (t % {D}) / CAST({D} AS DOUBLE) - pi() AS phase FROM spk)"
CIRC = """cs AS (SELECT cluster_id, count(*) AS n, sum(cos(phase)) AS c, sum(sin(phase)) AS s FROM phs GROUP BY 1),
  cr AS (SELECT *, sqrt(c * c + s * s) / n AS r, (c * c + s * s) / n AS z FROM cs)"""
HEAD = f"WITH {S.SPK}, {PHS}, {CIRC}"


def phases(spark, sf):
    turn = F.pmod("t", F.lit(D)) / F.lit(float(D))
    return S.spikes(spark, sf).withColumn("phase", 2 * math.pi * turn - math.pi).withColumn("turn", turn)


def _circ(spark, sf):
    return ph.circular(phases(spark, sf), ["cluster_id"])


@query("circular_mean_std", f"{HEAD} SELECT cluster_id, n, round(atan2(s, c), 6) AS circ_mean, round(sqrt(-2 * ln(r)), 6) AS circ_std FROM cr")
def _(spark, sf):
    return _circ(spark, sf).select("cluster_id", "n", R("circ_mean"), R("circ_std"))


@query("mean_vector_length", f"{HEAD} SELECT cluster_id, round(r, 6) AS vector_length, round(exp(-z), 6) AS vector_pval FROM cr")
def _(spark, sf):
    return _circ(spark, sf).select("cluster_id", R("vector_length"), R("vector_pval"))


@query(
    "rayleigh",
    f"""{HEAD} SELECT cluster_id, round(exp(-z) * CASE WHEN n < 50 THEN 1 + (2 * z - z * z) / (4.0 * n)
      - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288.0 * n * n) ELSE 1 END, 6) AS rayleigh_pval FROM cr""",
)
def _(spark, sf):
    return _circ(spark, sf).select("cluster_id", R("rayleigh_pval"))


@query(
    "ppc_closed_form",
    f"""WITH {S.SPK}, {PHS} SELECT a.cluster_id, round(avg(cos(a.phase - b.phase)), 6) AS ppc FROM phs a JOIN phs b
      ON a.cluster_id = b.cluster_id AND a.spike_id < b.spike_id GROUP BY 1""",
)
def _(spark, sf):
    return _circ(spark, sf).select("cluster_id", R("ppc"))


@query(
    "h_test",
    f"""WITH {S.SPK}, h AS (SELECT cluster_id, r.i AS k, count(*) AS n, sum(cos(2 * pi() * r.i * (t % {D}) / CAST({D} AS DOUBLE))) AS c,
        sum(sin(2 * pi() * r.i * (t % {D}) / CAST({D} AS DOUBLE))) AS s FROM spk CROSS JOIN range(1, 21) r(i) GROUP BY 1, 2),
      z AS (SELECT cluster_id, k, sum((c * c + s * s) * 2 / n) OVER (PARTITION BY cluster_id ORDER BY k) - 4 * k + 4 AS hc FROM h),
      b AS (SELECT cluster_id, max(hc) AS h, arg_max(k, (hc, -k)) AS m FROM z GROUP BY 1)
      SELECT cluster_id, m, round(h, 6) AS h, round(CASE WHEN h <= 23 THEN 0.9999755 * exp(-0.39802 * h)
        WHEN h < 50 THEN 1.210597 * exp(-0.45901 * h + 0.0022900 * h * h) ELSE 4e-8 END, 8) AS fpp FROM b""",
)
def _(spark, sf):
    d = ph.h_test(phases(spark, sf), ["cluster_id"], F.col("turn"))
    return d.select("cluster_id", F.col("m").cast("bigint").alias("m"), R("h"), R("fpp", 8))


@query("ppc_sampled")
def _(spark, sf):
    return ph.ppc_sampled(phases(spark, sf), ["cluster_id"], 30, 20, 42)


BAND = f"""{CWT}, bp AS (SELECT channel, idx, avg(re) AS re, avg(im) AS im FROM cwt WHERE f >= 1 GROUP BY 1, 2)"""


def _band(spark, sf):
    t = cwt(spark, sf).withColumn("freq", F.get(F.array(F.lit(8.0), F.lit(12.0), F.lit(20.0)), F.col("f")))
    return ph.band_average(t, ["recording_id", "channel", "idx"], "freq", 8.0, 30.0)


@query("cwt_band_phase", f"{BAND} SELECT channel, idx, round(atan2(im, re), 5) AS phase, round(sqrt(re * re + im * im), 6) AS amplitude FROM bp")
def _(spark, sf):
    return _band(spark, sf).select("channel", "idx", R("phase", 5), R("amplitude"))


@query(
    "spike_phase_join",
    f"""{BAND}, {S.SPK}, s AS (SELECT cluster_id, cluster_id % (SELECT count(*) FROM embeddings) AS channel, (t // {H}) % 64 AS idx FROM spk),
      j AS (SELECT cluster_id, atan2(im, re) AS phase FROM s JOIN bp USING (channel, idx)),
      g AS (SELECT cluster_id, count(*) AS n, sum(cos(phase)) AS c, sum(sin(phase)) AS s FROM j GROUP BY 1)
      SELECT cluster_id, n, round(sqrt(c * c + s * s) / n, 6) AS vector_length, round((c * c + s * s - n) / (n * (n - 1)), 6) AS ppc FROM g""",
)
def _(spark, sf):
    s = S.spikes(spark, sf).select(
        F.col("cluster_id"), (F.col("cluster_id") % S.vectors(spark, sf)).alias("channel"), F.expr(f"(t div {H}) % 64 * 40").alias("t")
    )
    j = ph.at_samples(s, _band(spark, sf).select("channel", "idx", "phase"), 40, ["channel"])
    return ph.circular(j, ["cluster_id"]).select("cluster_id", "n", R("vector_length"), R("ppc"))


@query(
    "cwt_phase_best_frequency",
    f"""{CWT}, {S.SPK}, s AS (SELECT cluster_id, cluster_id % (SELECT count(*) FROM embeddings) AS channel, (t // {H}) % 64 AS idx FROM spk),
      g AS (SELECT cluster_id, f, count(*) AS n, sum(re / sqrt(re * re + im * im)) AS c, sum(im / sqrt(re * re + im * im)) AS s
        FROM s JOIN cwt USING (channel, idx) GROUP BY 1, 2),
      p AS (SELECT *, atan2(s, c) AS m, (c * c + s * s - n) / (n * (n - 1)) AS ppc FROM g)
      SELECT cluster_id, round(atan2(avg(sin(m)), avg(cos(m))), 5) AS circ_mean, round(avg(ppc), 6) AS ppc, arg_max(f, ppc) AS best_freq FROM p GROUP BY 1""",
)
def _(spark, sf):
    s = S.spikes(spark, sf).select("cluster_id", (F.col("cluster_id") % S.vectors(spark, sf)).alias("channel"), F.expr(f"(t div {H}) % 64").alias("idx"))
    t = cwt(spark, sf).select("channel", "idx", F.col("f").cast("bigint").alias("f"), F.atan2("im", "re").alias("phase"))
    st = ph.circular(s.join(t, ["channel", "idx"]), ["cluster_id", "f"])
    return ph.best_frequency(st, ["cluster_id"], "f", 0, 2).select("cluster_id", R("circ_mean", 5), R("ppc"), "best_freq")


DAYPH = "2 * pi() * (idx % 24 + 0.5) / 24 - pi()"


@query(
    "modulation_index",
    f"""WITH {S.HRS}, b AS (SELECT channel, floor(({DAYPH} + pi()) / (2 * pi() / 12)) AS bin, avg(v) AS v FROM hrs GROUP BY 1, 2),
      s AS (SELECT channel, v / sum(v) OVER (PARTITION BY channel) AS p FROM b)
      SELECT channel, round((ln(12) + sum(p * ln(p))) / ln(12), 8) AS mi FROM s GROUP BY 1 HAVING min(p) > 0""",
)
def _(spark, sf):
    p = 2 * math.pi * (F.col("idx") % 24 + 0.5) / 24 - math.pi
    return ph.modulation_index(S.hourly(spark, sf), ["channel"], p, F.col("v"), 12).select("channel", R("mi", 8))


@query("cfc_pvalue")
def _(spark, sf):
    p = 2 * math.pi * (F.col("idx") % 24 + 0.5) / 24 - math.pi
    return ph.coupling_pvalue(S.hourly(spark, sf), ["channel"], p, F.col("v"), 12, 50, 42, "idx")


@query(
    "phase_synchrony",
    f"""{BAND}, p AS (SELECT channel, idx, atan2(im, re) AS ph FROM bp)
      SELECT a.channel, a.idx, round(1 - sin(abs(a.ph - b.ph) / 2), 5) AS synchrony FROM p a JOIN p b ON b.channel = a.channel + 1 AND a.idx = b.idx""",
)
def _(spark, sf):
    b = _band(spark, sf).select("channel", "idx", "phase")
    n = b.select((F.col("channel") - 1).alias("channel"), "idx", F.col("phase").alias("other"))
    return b.join(n, ["channel", "idx"]).select("channel", "idx", F.round(ph.phase_synchrony(F.col("phase"), F.col("other")), 5).alias("synchrony"))


@query(
    "spike_triggered_average",
    f"""WITH {S.SPK}, {S.HRS}, s AS (SELECT cluster_id, probe, t // {H} AS idx FROM spk),
      n AS (SELECT cluster_id, count(*) AS n_spikes FROM s GROUP BY 1)
      SELECT s.cluster_id, r.i AS "offset", any_value(n_spikes) AS n_spikes, round(sum(coalesce(v, 0)) / any_value(n_spikes), 6) AS mean_v
      FROM s JOIN n USING (cluster_id) CROSS JOIN range(-6, 7) r(i) LEFT JOIN hrs ON hrs.channel = s.probe AND hrs.idx = s.idx + r.i GROUP BY 1, 2""",
)
def _(spark, sf):
    s = S.spikes(spark, sf).select("recording_id", "cluster_id", F.col("probe").alias("channel"), F.expr(f"t div {H}").alias("idx"))
    d = ph.triggered_average(s, S.hourly(spark, sf), 6, 720, ["recording_id", "channel"])
    return d.select("cluster_id", F.col("offset").cast("bigint").alias("offset"), "n_spikes", R("mean_v"))


ABOVE = f"""WITH {S.HRS}, e AS (SELECT channel, idx, avg(v * v) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM hrs),
  t AS (SELECT channel, avg(v) + stddev_pop(v) AS level FROM e GROUP BY 1),
  a AS (SELECT channel, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY channel ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS s FROM e JOIN t USING (channel) WHERE v > level),
  b AS (SELECT channel, min(idx) AS start, max(idx) + 1 AS "end" FROM (SELECT *, sum(s) OVER (PARTITION BY channel ORDER BY idx) AS g FROM a) GROUP BY channel, g)"""


def _energy(spark, sf):
    from spikeloom.session import checkpoint

    e = sg.moving(S.hourly(spark, sf), "e", lambda v: F.avg(v * v), 3, 3, 240)
    e = checkpoint(e.select("recording_id", "channel", "idx", F.col("e").alias("v")))
    lv = e.groupBy(*sg.CHAN).agg((F.avg("v") + F.stddev_pop("v")).alias("level"))
    return e, sg.attach(e, lv, sg.CHAN, F.col("idx"))


def _spans(spark, sf):
    return lfp.above_baseline(_energy(spark, sf)[1], F.col("level"), 2, 240)


@query("lfp_burst_intervals", f'{ABOVE} SELECT channel, start, "end" FROM b')
def _(spark, sf):
    return _spans(spark, sf).drop("recording_id")


@query(
    "baseline_complement_intervals",
    f"""{ABOVE}, n AS (SELECT channel, max(idx) + 1 AS size FROM hrs GROUP BY 1),
      c AS (SELECT channel, coalesce(lag("end") OVER w, 0) AS start, start AS "end" FROM b WINDOW w AS (PARTITION BY channel ORDER BY start)
      UNION ALL SELECT channel, max("end"), any_value(size) FROM b JOIN n USING (channel) GROUP BY 1
      UNION ALL SELECT channel, 0, size FROM n ANTI JOIN b USING (channel)) SELECT channel, start, "end" FROM c WHERE start < "end" """,
)
def _(spark, sf):
    size = S.hourly(spark, sf).groupBy(*sg.CHAN).agg((F.max("idx") + 1).alias("size"))
    return lfp.baseline_periods(_spans(spark, sf), None, 240, size).drop("recording_id")


@query("lfp_bursts_cleaned")
def _(spark, sf):
    e, lv = _energy(spark, sf)
    raw = ch.to_chunks(S.hourly(spark, sf), 120)
    return lfp.find_bursts(
        lv, ch.to_chunks(e, 120), raw, 120, F.col("level"), 1.0, min_len=3, max_len=200, gap=2, pre=12, post=12, order=2, peaks=1, length=240
    ).drop("recording_id")


@query("lfp_burst_stats")
def _(spark, sf):
    raw = ch.to_chunks(S.hourly(spark, sf), 120)
    return lfp.burst_statistics(_spans(spark, sf), raw, 120, 1.0, 240, nperseg=6).drop("recording_id")


@query("lfp_burst_band_power")
def _(spark, sf):
    raw = ch.to_chunks(S.hourly(spark, sf), 120)
    p = lfp.span_spectra(_spans(spark, sf), raw, 120, 24.0, 256, shortest=8)
    return lfp.half_open_bands(p, ["channel", "start", "end"], {"slow": (0.5, 2.0), "fast": (2.0, 12.0)})


@query("kde_fixed_baseline")
def _(spark, sf):
    e, _ = _energy(spark, sf)
    return lfp.fixed_baseline(lfp.density(lfp.grid_counts(e, sg.CHAN, "v", 0.001, 1024), sg.CHAN, 1024), sg.CHAN)


@query("spline_baseline")
def _(spark, sf):
    e, lv = _energy(spark, sf)
    lim = lv.groupBy(*sg.CHAN).agg((F.max("level") * 3).alias("ste_max"))
    d = lfp.fitted_baseline(ch.to_chunks(e, 120), lim, 120, "spline", 20, 3.0)
    return ch.to_long(d, 120, "base").select("channel", "idx", "v")


@query(
    "bosc_threshold_mask",
    f"""{CWT}, p AS (SELECT channel, f, idx, re * re + im * im AS p, avg(re * re + im * im) OVER (PARTITION BY channel, f) AS bg FROM cwt)
      SELECT channel, f, idx, p > bg * -ln(1 - 0.95) AS oscillation FROM p""",
)
def _(spark, sf):
    t = cwt(spark, sf).select("recording_id", "channel", F.col("f").cast("bigint").alias("f"), "idx", ch.power().alias("p"))
    return lfp.oscillation_mask(t, ["recording_id", "channel", "f"]).select("channel", "f", "idx", "oscillation")


@query(
    "bosc_band_any",
    f"""{CWT}, p AS (SELECT channel, f, idx, re * re + im * im AS p, avg(re * re + im * im) OVER (PARTITION BY channel, f) AS bg FROM cwt)
      SELECT channel, idx, bool_or(p > bg * 2.0) AS oscillation FROM p WHERE f >= 1 GROUP BY 1, 2""",
)
def _(spark, sf):
    t = cwt(spark, sf).select("recording_id", "channel", "f", "idx", ch.power().alias("p"))
    m = lfp.oscillation_mask(t, ["recording_id", "channel", "f"], multiple=2.0)
    return m.where("f >= 1").groupBy("channel", "idx").agg(F.bool_or("oscillation").alias("oscillation"))


STEPS = f"""{CWT}, m AS (SELECT channel, f, idx // 8 AS w, avg(re) AS re, avg(im) AS im FROM cwt GROUP BY 1, 2, 3),
  q AS (SELECT *, lag(re) OVER u AS pr, lag(im) OVER u AS pi_ FROM m WINDOW u AS (PARTITION BY channel, f ORDER BY w)),
  a AS (SELECT channel, f, w, atan2(pi_ * re - pr * im, pr * re + pi_ * im) AS angle FROM q WHERE pr IS NOT NULL),
  s AS (SELECT channel, f, w, angle - lag(angle) OVER (PARTITION BY channel, f ORDER BY w) AS step FROM a)"""


def _steps(spark, sf):
    return lfp.phase_steps(cwt(spark, sf), ["recording_id", "channel", "f"], 8, 4)


@query("phase_discontinuity_steps", f"{STEPS} SELECT channel, f, w, round(step, 4) AS step FROM s WHERE step IS NOT NULL")
def _(spark, sf):
    return _steps(spark, sf).select("channel", F.col("f").cast("bigint").alias("f"), "w", R("step", 4))


@query("phase_discontinuity_index")
def _(spark, sf):
    return lfp.discontinuity_index(_steps(spark, sf), ["f"])


@query(
    "spike_bin_phase_counts",
    f"""WITH {S.SPK}, {PHS} SELECT cluster_id, CAST(floor((phase + pi()) / (2 * pi() / 12)) AS BIGINT) AS bin, count(*) AS n FROM phs GROUP BY 1, 2""",
)
def _(spark, sf):
    b = F.floor((F.col("phase") + math.pi) / (2 * math.pi / 12)).cast("bigint")
    return phases(spark, sf).groupBy("cluster_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))




@query("lfp_burst_channel_summary")
def _(spark, sf):
    raw = ch.to_chunks(S.hourly(spark, sf), 120)
    st = lfp.burst_statistics(_spans(spark, sf), raw, 120, 1.0, 240, nperseg=6)
    return lfp.channel_summary(st, ["len", "iei", "rms", "flatness"]).drop("recording_id")


@query("derivative_baseline")
def _(spark, sf):
    e, _ = _energy(spark, sf)
    return lfp.derivative_baseline(ch.to_chunks(e, 120), 120, [0.2] * 5, 3.0).drop("recording_id")
