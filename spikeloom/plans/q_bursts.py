"""Max-interval bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import bursts as bu
from spikeloom.operators import spikes as sp
from spikeloom.plans.registry import query

H = S.HOUR_US
SEG = S.SEGMENT_US
REF = 0.5 * H
RULE = bu.BurstRule(min_count=3, min_dur=1_000_000, max_start=2 * H, max_end=4 * H, max_int=8 * H)
ALL = bu.BurstRule(**{**RULE.__dict__, "drop_lone_last": False})
MEAN = bu.BurstRule(min_count=3, min_dur=0)


def raw_sql(start, end, gap, cnt=3):
    """Bursts from positions: runs by interval, first opening spike of each run."""
    return f"""o AS (SELECT *, lag(t) OVER w AS pt, lead(t) OVER w AS nt, row_number() OVER w - 1 AS pos,
      count(*) OVER (PARTITION BY cluster_id) AS n,
      (max(t) OVER (PARTITION BY cluster_id) - min(t) OVER (PARTITION BY cluster_id))
        / (count(*) OVER (PARTITION BY cluster_id) - 1) AS mean_isi
    FROM spk WINDOW w AS (PARTITION BY cluster_id ORDER BY t, spike_id)),
  r AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {end} THEN 1 ELSE 0 END)
          OVER (PARTITION BY cluster_id ORDER BY t, spike_id ROWS UNBOUNDED PRECEDING) AS run FROM o WHERE n >= {cnt}),
  f AS (SELECT *, min(CASE WHEN nt - t <= {start} AND pos < n - {cnt} THEN pos END)
          OVER (PARTITION BY cluster_id, run) AS first_pos FROM r),
  raw AS (SELECT cluster_id, run, min(t) AS start_t, max(t) AS end_t, count(*) AS n_spikes, any_value({gap}) AS gap
          FROM f WHERE pos >= first_pos GROUP BY 1, 2),
  rg AS (SELECT *, sum(CASE WHEN start_t - pe < gap THEN 0 ELSE 1 END)
           OVER (PARTITION BY cluster_id ORDER BY start_t ROWS UNBOUNDED PRECEDING) AS burst
         FROM (SELECT *, lag(end_t) OVER (PARTITION BY cluster_id ORDER BY start_t) AS pe FROM raw)),
  m AS (SELECT cluster_id, burst, min(start_t) AS start_t, max(end_t) AS end_t,
          CAST(sum(n_spikes) AS BIGINT) AS n_spikes, count(*) AS n_raw FROM rg GROUP BY 1, 2)"""


def kept_sql(min_dur, cnt=3, drop=True):
    lone = """WHERE NOT (burst = last AND n_raw = 1 AND tot > 1)""" if drop else ""
    return f"""kept AS (SELECT cluster_id, burst, start_t, end_t, n_spikes FROM (
      SELECT *, max(burst) OVER (PARTITION BY cluster_id) AS last, sum(n_raw) OVER (PARTITION BY cluster_id) AS tot FROM m)
      {lone} QUALIFY end_t - start_t >= {min_dur} AND n_spikes >= {cnt}
        AND row_number() OVER () > 0)"""


R3 = raw_sql(2 * H, 4 * H, 8 * H)
K3 = kept_sql(1_000_000)
OUT = ["cluster_id", "start_t", "end_t", "n_spikes"]
SEL = "cluster_id, start_t, end_t, n_spikes"


@query("bursts_raw", f"WITH {S.SPK}, {R3} SELECT {SEL} FROM raw")
def _(spark, sf):
    return bu.raw_bursts(S.spikes(spark, sf), RULE, SEG).select(*OUT)


@query("bursts_cleaned_compat", f"WITH {S.SPK}, {R3}, {K3} SELECT {SEL} FROM kept")
def _(spark, sf):
    return bu.bursts(S.spikes(spark, sf), RULE, SEG).select(*OUT)


@query("bursts_cleaned", f"WITH {S.SPK}, {R3}, {kept_sql(1_000_000, drop=False)} SELECT {SEL} FROM kept")
def _(spark, sf):
    return bu.bursts(S.spikes(spark, sf), ALL, SEG).select(*OUT)


@query(
    "bursts_mean_interval",
    f"WITH {S.SPK}, {raw_sql('mean_isi / 2', 'mean_isi', 'mean_isi')}, {kept_sql(0)} SELECT {SEL} FROM kept",
)
def _(spark, sf):
    return bu.bursts(S.spikes(spark, sf), MEAN, SEG).select(*OUT)


PROPS = f"""bs AS (SELECT f.cluster_id, g.burst, f.t, f.spike_id FROM f
      JOIN rg g ON g.cluster_id = f.cluster_id AND g.run = f.run AND f.pos >= f.first_pos
      JOIN kept k ON k.cluster_id = g.cluster_id AND k.burst = g.burst),
  bi AS (SELECT *, t - lag(t) OVER w AS isi, lag(t) OVER w - lag(t, 2) OVER w AS isi_prev
         FROM bs WINDOW w AS (PARTITION BY cluster_id, burst ORDER BY t, spike_id)),
  props AS (SELECT cluster_id, burst, avg(isi) AS intra_burst_iei, count(*) AS spikes_per_burst,
    avg(CAST(3 AS DOUBLE) * (CAST(isi_prev AS DOUBLE) - isi) * (CAST(isi_prev AS DOUBLE) - isi) / (CAST(isi_prev + isi AS DOUBLE) * (isi_prev + isi))) AS local_sfa,
    CASE WHEN count(isi_prev) > 2 THEN avg(3 * (1 - 4 * CAST(isi_prev AS DOUBLE) * isi / (CAST(isi_prev + isi AS DOUBLE) * (isi_prev + isi))) * (1 + CAST({4 * REF} AS DOUBLE) / (isi_prev + isi))) END AS rlocal_sfa,
    arg_min(isi, t) FILTER (isi IS NOT NULL) / CAST(arg_max(isi, t) AS DOUBLE) AS divisor_sfa,
    avg(CAST(isi - isi_prev AS DOUBLE) / (isi + isi_prev)) AS abi_sfa,
    max(t) - min(t) AS burst_len, min(t) AS start_t, max(t) AS end_t FROM bi GROUP BY 1, 2)"""
FULL = f"WITH {S.SPK}, {R3}, {K3}, {PROPS}"
SF = ["local_sfa", "rlocal_sfa", "divisor_sfa", "abi_sfa"]


def _props(spark, sf):
    return bu.burst_properties(S.spikes(spark, sf), RULE, REF, SEG)


@query(
    "burst_props",
    f"""{FULL} SELECT cluster_id, start_t, spikes_per_burst, burst_len, round(intra_burst_iei, 3) AS intra_burst_iei,
      {', '.join(f'round({c}, 6) AS {c}' for c in SF)} FROM props""",
)
def _(spark, sf):
    return _props(spark, sf).select(
        "cluster_id", "start_t", "spikes_per_burst", "burst_len", F.round("intra_burst_iei", 3).alias("intra_burst_iei"),
        *[F.round(c, 6).alias(c) for c in SF],
    )


@query(
    "inter_burst_iei",
    f"""WITH {S.SPK}, {R3}, {K3} SELECT cluster_id, start_t,
      lead(start_t) OVER (PARTITION BY cluster_id ORDER BY start_t) - end_t AS inter_burst_iei FROM kept""",
)
def _(spark, sf):
    b = bu.bursts(S.spikes(spark, sf), RULE, SEG)
    return bu.inter_burst_intervals(b, SEG).select("cluster_id", "start_t", "inter_burst_iei")


def _peak(c):
    return f"""pk_{c} AS (
      SELECT cluster_id, CASE WHEN any_value(nb) > 4 THEN arg_min(lo + b * w, (-k, b)) ELSE any_value(mean) END AS peak_{c}
      FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id, b) AS k FROM (
        SELECT cluster_id, nb, mean, lo, (hi - lo) / nb AS w,
          CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / nb)), nb - 1) ELSE 0 END AS b
        FROM (SELECT cluster_id, {c} AS v, min({c}) OVER p AS lo, max({c}) OVER p AS hi, avg({c}) OVER p AS mean,
          CASE WHEN count({c}) OVER p > 4 THEN count({c}) OVER p // 4 ELSE count({c}) OVER p END AS nb
          FROM props WINDOW p AS (PARTITION BY cluster_id)) WHERE v IS NOT NULL)) GROUP BY 1)"""


MEANS = ["total_burst_time", "inter_burst_iei", "intra_burst_iei", "spikes_per_burst", "burst_len", *SF]
PEAKS = [f"peak_{c}" for c in SF]


@query(
    "burst_unit_means",
    f"""{FULL}, {', '.join(_peak(c) for c in SF)},
      x AS (SELECT *, lead(start_t) OVER (PARTITION BY cluster_id ORDER BY start_t) - end_t AS ibi FROM props),
      y AS (SELECT cluster_id, count(*) AS num_bursts, sum(burst_len) AS total_burst_time, avg(ibi) AS inter_burst_iei,
              avg(intra_burst_iei) AS intra_burst_iei, avg(spikes_per_burst) AS spikes_per_burst, avg(burst_len) AS burst_len,
              {', '.join(f'avg({c}) AS {c}' for c in SF)} FROM x GROUP BY 1)
      SELECT cluster_id, num_bursts, {', '.join(f'round(CAST({c} AS DOUBLE), 4) AS {c}' for c in MEANS + PEAKS)}
      FROM y {' '.join(f'LEFT JOIN pk_{c} USING (cluster_id)' for c in SF)}""",
)
def _(spark, sf):
    d = bu.burst_unit_means(_props(spark, sf), SEG)
    return d.select("cluster_id", "num_bursts", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in MEANS + PEAKS])


@query(
    "burst_binary_vector",
    f"""WITH {S.SPK}, {R3}, {K3} SELECT DISTINCT cluster_id, r.i AS bin FROM kept
      JOIN range(720) r(i) ON r.i BETWEEN start_t // {H} - 1 AND end_t // {H} + 1""",
)
def _(spark, sf):
    b = bu.bursts(S.spikes(spark, sf), RULE, SEG)
    return sp.binary_bursts(b, H, 720, dt=1).drop("recording_id")
