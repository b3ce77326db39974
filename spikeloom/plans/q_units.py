"""Interval statistics and unit quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import spikes as sp
from spikeloom.operators import units as un
from spikeloom.plans.registry import query, rounded

H = S.HOUR_US
THR = 2 * H
REF = 0.5 * H
BIN = 6 * H
NB = 120
T = S.STOP_US
SEG = S.SEGMENT_US

ISI = """iv AS (
  SELECT *, t - lag(t) OVER w AS isi, lag(t) OVER w - lag(t, 2) OVER w AS isi_prev,
         row_number() OVER w - 1 AS pos
  FROM spk WINDOW w AS (PARTITION BY cluster_id ORDER BY t, spike_id))"""
WITH = f"WITH {S.SPK}, {ISI} "


def _iv(spark, sf):
    return un.intervals(S.spikes(spark, sf), SEG)


@query("isi", WITH + "SELECT cluster_id, spike_id, isi, isi_prev, pos FROM iv")
def _(spark, sf):
    return _iv(spark, sf).select("cluster_id", "spike_id", "isi", "isi_prev", "pos")


@query(
    "firing_rate",
    f"WITH {S.SPK} SELECT cluster_id, count(*) AS n_spikes, round(count(*) * 3.6e9 / nullif(max(t) - min(t), 0), 9) AS fr FROM spk GROUP BY 1",
)
def _(spark, sf):
    return un.firing_rate(S.spikes(spark, sf)).select("cluster_id", "n_spikes", rounded(F.col("fr") * 3.6e9, 9).alias("fr"))


@query("fr_iei", WITH + "SELECT cluster_id, round(avg(isi) / 1e6, 6) AS iei, round(3.6e9 / avg(isi), 9) AS fr_iei FROM iv GROUP BY 1")
def _(spark, sf):
    d = _iv(spark, sf).groupBy("cluster_id").agg(F.avg("isi").alias("m"))
    return d.select("cluster_id", rounded(F.col("m") / 1e6, 6).alias("iei"), rounded(3.6e9 / F.col("m"), 9).alias("fr_iei"))


FANO = f"""cnt AS (SELECT cluster_id, t // {BIN} AS bin, count(DISTINCT t) AS n FROM spk GROUP BY 1, 2),
  fano AS (SELECT u.cluster_id, var_pop(coalesce(n, 0)) / avg(coalesce(n, 0)) AS fano_factor,
             stddev_pop(coalesce(n, 0)) / avg(coalesce(n, 0)) AS cv
           FROM (SELECT DISTINCT cluster_id FROM spk) u CROSS JOIN range({NB}) r(i)
           LEFT JOIN cnt ON cnt.cluster_id = u.cluster_id AND cnt.bin = r.i GROUP BY 1)"""


@query("fano_cv", f"WITH {S.SPK}, {FANO} SELECT cluster_id, round(fano_factor, 6) AS fano_factor, round(cv, 6) AS cv FROM fano")
def _(spark, sf):
    d = un.fano_cv(S.spikes(spark, sf), BIN, NB)
    return d.select("cluster_id", rounded("fano_factor", 6).alias("fano_factor"), rounded("cv", 6).alias("cv"))


LV = "3 * (isi_prev - isi) * (isi_prev - isi) / nullif(CAST(isi_prev + isi AS DOUBLE) * (isi_prev + isi), 0)"
LVR = f"""3 * (1 - 4.0 * isi_prev * isi / (CAST(isi_prev + isi AS DOUBLE) * (isi_prev + isi))) * (1 + {4 * REF} / (isi_prev + isi))"""
ABI = """CASE WHEN isi = 0 AND isi_prev = 0 THEN 0.0 ELSE CAST(isi - isi_prev AS DOUBLE) / (isi + isi_prev) END"""
SFA = f"""sfa AS (SELECT cluster_id, count(*) AS n_spikes, avg(isi) AS mean_isi,
    avg(CAST(3 AS DOUBLE) * (CAST(isi_prev AS DOUBLE) - isi) * (CAST(isi_prev AS DOUBLE) - isi) / (CAST(isi_prev + isi AS DOUBLE) * (isi_prev + isi))) AS local_sfa,
    avg(3 * (1 - 4 * CAST(isi_prev AS DOUBLE) * isi / (CAST(isi_prev + isi AS DOUBLE) * (isi_prev + isi))) * (1 + CAST({4 * REF} AS DOUBLE) / (isi_prev + isi))) AS rlocal_sfa,
    arg_min(isi, t) FILTER (isi IS NOT NULL) / CAST(arg_max(isi, t) AS DOUBLE) AS divisor_sfa,
    avg({ABI}) FILTER (isi_prev IS NOT NULL) AS abi_sfa
  FROM iv GROUP BY 1)"""


def _sfa(name):
    @query(name, f"{WITH}, {SFA} SELECT cluster_id, round({name}, 6) AS {name} FROM sfa")
    def _(spark, sf):
        d = un.adaptation(_iv(spark, sf), ["cluster_id"], REF)
        return d.select("cluster_id", rounded(name, 6).alias(name))


for _name in ("local_sfa", "rlocal_sfa", "divisor_sfa", "abi_sfa"):
    _sfa(_name)

MIN_ISI = 600_000_000
def viol_sql(min_isi):
    return f"""k AS (SELECT * FROM (SELECT *, t - lag(t) OVER (PARTITION BY cluster_id ORDER BY t) AS g FROM spk)
            WHERE g IS NULL OR g > {min_isi}),
  v AS (SELECT *, t - lag(t) OVER (PARTITION BY cluster_id ORDER BY t) AS h FROM k),
  viol AS (SELECT cluster_id, count(*) FILTER (h < {THR}) AS num_violations,
             count(*) FILTER (h < {THR}) / (2.0 * count(*) * {THR - min_isi}) / (count(*) / {float(T)}) AS fp_rate
           FROM v GROUP BY 1)"""


VIOL = viol_sql(MIN_ISI)


@query("isi_violations", f"WITH {S.SPK}, {VIOL} SELECT cluster_id, num_violations, round(fp_rate, 6) AS fp_rate FROM viol")
def _(spark, sf):
    d = un.isi_violations(S.spikes(spark, sf), SEG, THR, MIN_ISI, T)
    return d.select("cluster_id", "num_violations", rounded("fp_rate", 6).alias("fp_rate"))


RB = f"""rbp AS (SELECT a.cluster_id, count(b.t) AS rp_pairs, count(DISTINCT a.spike_id) AS n
           FROM spk a LEFT JOIN spk b ON a.cluster_id = b.cluster_id AND a.t < b.t AND b.t - a.t <= {THR} GROUP BY 1),
  rb AS (SELECT cluster_id, rp_pairs, 1 - rp_pairs * CAST({T} AS DOUBLE) / (n * n * CAST({THR} AS DOUBLE)) AS q FROM rbp)"""
RBSEL = "CASE WHEN q >= 0 THEN 1 - sqrt(greatest(q, 0)) ELSE 1.0 END"


@query("rb_violations", f"WITH {S.SPK}, {RB} SELECT cluster_id, rp_pairs, round({RBSEL}, 6) AS rp_contam FROM rb")
def _(spark, sf):
    d = un.rb_violations(S.spikes(spark, sf), SEG, THR, 0, T)
    return d.select("cluster_id", "rp_pairs", rounded("rp_contam", 6).alias("rp_contam"))


PRES = f"""pn AS (SELECT cluster_id, CAST(ceil(count(*) * 0.05) AS BIGINT) AS edges FROM spk GROUP BY 1),
  pb AS (SELECT cluster_id, edges, least(CAST(floor(t * (edges - 1) / CAST({T} AS DOUBLE)) AS BIGINT), edges - 2) AS bin
         FROM spk JOIN pn USING (cluster_id) WHERE edges > 2),
  pc AS (SELECT p.cluster_id, p.edges, r.i AS bin, (SELECT count(*) FROM pb WHERE pb.cluster_id = p.cluster_id AND pb.bin = r.i) AS c
         FROM pn p CROSS JOIN range(1000) r(i) WHERE r.i < p.edges - 1 AND p.edges > 2),
  pres AS (SELECT pn.cluster_id, coalesce(count(c) FILTER (c > 0) / CAST(pn.edges AS DOUBLE), 0) AS presence_ratio,
             coalesce(CASE WHEN count(c) > 0 THEN regr_slope(c, bin) END, 0) AS presence_slope
           FROM pn LEFT JOIN pc USING (cluster_id) GROUP BY pn.cluster_id, pn.edges)"""


@query(
    "presence_ratio",
    f"WITH {S.SPK}, {PRES} SELECT cluster_id, round(presence_ratio, 6) AS presence_ratio, round(presence_slope, 6) AS presence_slope FROM pres",
)
def _(spark, sf):
    d = un.presence(S.spikes(spark, sf), 0, T)
    return d.select(
        "cluster_id", rounded("presence_ratio", 6).alias("presence_ratio"), rounded("presence_slope", 6).alias("presence_slope")
    )


HIST = """lim AS (SELECT cluster_id, min(amplitude) AS lo, (max(amplitude) - min(amplitude)) / 500 AS width, count(*) AS total
         FROM spk GROUP BY 1),
  hist AS (SELECT cluster_id, width, total,
             CAST(least(CASE WHEN width > 0 THEN floor((amplitude - lo) / width) ELSE 0 END, 499) AS BIGINT) AS bin, count(*) AS c
           FROM spk JOIN lim USING (cluster_id) GROUP BY ALL)"""


@query("amplitude_hist", f"WITH {S.SPK}, {HIST} SELECT cluster_id, bin, c FROM hist")
def _(spark, sf):
    return un.amplitude_histogram(S.spikes(spark, sf)).select("cluster_id", "bin", "c")


GW = un.gaussian_weights(3.0)
CUT = f"""gw(m, w) AS (VALUES {', '.join(f'({i}, CAST({w!r} AS DOUBLE))' for i, w in enumerate(GW))}),
  sm AS (SELECT cluster_id, img + m - 12 AS bin, sum(c / (total * width) * w) AS p, any_value(width) AS width
         FROM (SELECT *, unnest([bin, -bin - 1, 999 - bin]) AS img FROM hist WHERE width > 0) CROSS JOIN gw
         WHERE img + m - 12 BETWEEN 0 AND 499 GROUP BY 1, 2),
  pdf AS (SELECT l.cluster_id, l.width, r.i AS bin, coalesce(sm.p, 0) AS p FROM lim l CROSS JOIN range(500) r(i)
          LEFT JOIN sm ON sm.cluster_id = l.cluster_id AND sm.bin = r.i WHERE l.width > 0),
  pk AS (SELECT cluster_id, min(bin) AS peak, any_value(p0) AS p0 FROM (
           SELECT *, max(p) OVER (PARTITION BY cluster_id) AS mp,
             max(CASE WHEN bin = 0 THEN p END) OVER (PARTITION BY cluster_id) AS p0 FROM pdf) WHERE p = mp GROUP BY 1),
  gg AS (SELECT cluster_id, arg_min(bin, (abs(p - p0), bin)) AS g FROM pdf JOIN pk USING (cluster_id) WHERE bin >= peak GROUP BY 1),
  cut AS (SELECT cluster_id, least(sum(p) * any_value(width), 0.5) AS amp_cutoff
          FROM pdf JOIN gg USING (cluster_id) WHERE bin >= g GROUP BY 1)"""


@query("amplitude_cutoff", f"WITH {S.SPK}, {HIST}, {CUT} SELECT cluster_id, round(amp_cutoff, 6) AS amp_cutoff FROM cut")
def _(spark, sf):
    d = un.amplitude_cutoff(S.spikes(spark, sf))
    return d.select("cluster_id", rounded("amp_cutoff", 6).alias("amp_cutoff"))


COLS = [
    "fano_factor", "cv", "iei", "fr_iei", "fr", "abi_sfa", "local_sfa", "rlocal_sfa", "divisor_sfa",
    "fp_rate", "rp_contam", "presence_ratio", "amp_cutoff",
]
VIOL0 = viol_sql(0)


@query(
    "unit_qc_table",
    f"""{WITH}, {FANO}, {SFA}, {VIOL0}, {RB}, {PRES}, {HIST}, {CUT},
     x AS (SELECT cluster_id, n_spikes, fano_factor, cv, mean_isi / 1e6 AS iei, 1e6 / mean_isi AS fr_iei,
        n_spikes / {T / 1e6} AS fr, abi_sfa, local_sfa, rlocal_sfa, divisor_sfa, fp_rate, num_violations,
        {RBSEL} AS rp_contam, presence_ratio, amp_cutoff
      FROM sfa JOIN fano USING (cluster_id) JOIN viol USING (cluster_id) JOIN rb USING (cluster_id)
      JOIN pres USING (cluster_id) LEFT JOIN cut USING (cluster_id))
     SELECT cluster_id, n_spikes, num_violations, {', '.join(f'round({c}, 6) AS {c}' for c in COLS)} FROM x""",
)
def unit_qc(spark, sf):
    d = un.unit_table(
        S.spikes(spark, sf), length=SEG, stop=T, nperseg=BIN, threshold=THR, refractory=REF, per_second=1e6
    )
    return d.select("cluster_id", "n_spikes", "num_violations", *[rounded(c, 6).alias(c) for c in COLS])


@query(
    "correlogram_narrow_band",
    f"""WITH {S.SPK}, x AS (SELECT a.cluster_id, b.t - a.t AS d FROM spk a JOIN spk b ON a.cluster_id = b.cluster_id AND b.t - a.t >= -{24 * H} AND b.t - a.t < {24 * H}),
      h AS (SELECT cluster_id, (d + {24 * H}) // {H // 2} AS bin, count(*) AS n FROM x WHERE d <> 0 GROUP BY 1, 2),
      z AS (SELECT cluster_id, k, sqrt(sum(n * cos(2 * pi() * k * bin / 96)) ** 2 + sum(n * sin(2 * pi() * k * bin / 96)) ** 2) AS m FROM h CROSS JOIN range(4, 29) r(k) GROUP BY 1, 2)
      SELECT cluster_id, max(m) FILTER (k IN (5, 6)) >= max(m) * (1 - 1e-9) AS narrow_band FROM z GROUP BY 1""",
)
def _(spark, sf):
    from spikeloom.operators import pairs as pr

    h = pr.lag_histogram(S.spikes(spark, sf), 24 * H, H // 2, auto=True)
    return un.narrow_band(h, ["cluster_id"], 96, 1000.0)


@query("longest_burst_interval")
def _(spark, sf):
    from spikeloom.operators import lfp

    d = _iv(spark, sf).where("isi is not null").withColumn("h", F.col("isi") / float(H))
    kde = lfp.density(lfp.grid_counts(d, ["cluster_id"], "h", 0.0, 512), ["cluster_id"], 512)
    return un.longest_burst_interval(kde, ["cluster_id"])


@query("unit_properties_merged")
def _(spark, sf):
    from spikeloom.operators import bursts as bu
    from spikeloom.operators import clean as cl
    from spikeloom.operators import waveforms as wf
    from spikeloom.plans.q_bursts import RULE

    s = S.spikes(spark, sf)
    unit = un.unit_table(s, length=SEG, stop=T, nperseg=BIN, threshold=THR, refractory=REF, per_second=1e6)
    props = bu.burst_unit_means(bu.burst_properties(s, RULE, REF, SEG), SEG)
    tpl = wf.template_properties(S.templates(spark, sf).withColumnRenamed("template_id", "cluster_id"), ["cluster_id"], 32)
    names = [c for c in props.columns if c in unit.columns and c not in sp.UNIT]
    merged = cl.outer_merge([unit, cl.rename_clashing(props, names, "burst_")], sp.UNIT)
    return cl.outer_merge([merged, tpl], ["cluster_id"])
