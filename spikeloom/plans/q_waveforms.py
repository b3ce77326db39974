"""Template and waveform queries: a label is a template, its embeddings are the channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import chunks as ch
from spikeloom.operators import waveforms as wf
from spikeloom.plans.registry import query

H = S.HOUR_US
V = f"WITH {S.SIG}"
R = lambda c, n=6: F.round(c, n).alias(c)


def multi(spark, sf):
    return S.templates(spark, sf).select(
        F.col("unit_class").alias("template_id"), F.col("template_id").alias("channel"), "waveform"
    )


BEST = """bc AS (SELECT label AS template_id, channel, sum(abs(v)) AS s, min(v) AS low FROM sig GROUP BY 1, 2),
  best AS (SELECT template_id, arg_max(channel, (s, -channel)) AS channel, arg_max(low, (s, -channel)) AS peak FROM bc GROUP BY 1)"""


@query("best_channel", f"{V}, {BEST} SELECT template_id, channel, peak FROM best")
def _(spark, sf):
    return wf.best_channel(multi(spark, sf), ["template_id"])


@query(
    "best_channel_center",
    f"""{V}, m AS (SELECT label AS template_id, channel, min(v) AS lo FROM sig WHERE idx BETWEEN 30 AND 33 GROUP BY 1, 2)
      SELECT template_id, arg_min(channel, (lo, channel)) AS channel FROM m GROUP BY 1""",
)
def _(spark, sf):
    return wf.best_channel(multi(spark, sf), ["template_id"], 32).select("template_id", "channel")


@query(
    "template_channel_window",
    f"""{V}, {BEST}, x AS (SELECT template_id, channel, greatest(channel - 8, 0) AS s0, channel + 8 + greatest(8 - channel, 0) AS e0 FROM best)
      SELECT template_id, channel, s0 - greatest(e0 - 500, 0) AS start_channel, e0 - greatest(e0 - 500, 0) AS end_channel FROM x""",
)
def _(spark, sf):
    a, b = wf.channel_window("channel", 8, 500)
    return wf.best_channel(multi(spark, sf), ["template_id"]).select("template_id", "channel", a.alias("start_channel"), b.alias("end_channel"))


@query(
    "channel_clusters",
    f"{V}, {BEST} SELECT channel, count(*) AS n, string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY template_id) AS clusters FROM best GROUP BY 1",
)
def _(spark, sf):
    b = wf.best_channel(multi(spark, sf), ["template_id"])
    return b.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("template_id")), ",").alias("clusters")
    )


@query(
    "rescale_minmax",
    f"""{V} SELECT channel, idx, round(2 * (v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c) - 1, 6) AS v FROM sig WINDOW c AS (PARTITION BY channel)""",
)
def _(spark, sf):
    d = S.templates(spark, sf).select(F.col("template_id").alias("channel"), F.posexplode(wf.rescale("waveform", 1.0)).alias("idx", "v"))
    return d.select("channel", F.col("idx").cast("bigint").alias("idx"), R("v"))


@query(
    "center_on_trough",
    f"""{V}, t AS (SELECT channel, arg_min(idx, (v, idx)) AS t FROM sig GROUP BY 1),
      l AS (SELECT min(t) AS lo, max(t) AS hi FROM t),
      s AS (SELECT channel, greatest(hi - 32 + t - 32, 0) AS s, 64 - (hi - lo) AS n FROM t CROSS JOIN l)
      SELECT channel, count(*) AS n, round(coalesce(sum(v * (idx - s + 1)), 0), 6) AS moment FROM s LEFT JOIN sig USING (channel)
      WHERE idx >= s AND idx < s + n GROUP BY 1""",
)
def _(spark, sf):
    d = wf.centred(S.templates(spark, sf), 32).where(F.size("waveform") > 0)
    d = d.select(F.col("template_id").alias("channel"), F.posexplode("waveform").alias("p", "v"))
    return d.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v") * (F.col("p") + 1)), 6).alias("moment"))


@query("mean_waveform_per_class", f"{V} SELECT label, idx, round(avg(v), 6) AS v FROM sig GROUP BY 1, 2")
def _(spark, sf):
    d = wf.mean_waveforms(S.templates(spark, sf).withColumnRenamed("unit_class", "label"), ["label"])
    return d.select("label", F.posexplode("waveform").alias("idx", "v")).select("label", F.col("idx").cast("bigint").alias("idx"), R("v"))


@query(
    "waveform_sd",
    f"{V}, s AS (SELECT label, idx, stddev_pop(v) AS sd FROM sig GROUP BY 1, 2) SELECT label, round(avg(sd), 6) AS stdev FROM s GROUP BY 1",
)
def _(spark, sf):
    return wf.mean_waveforms(S.templates(spark, sf).withColumnRenamed("unit_class", "label"), ["label"]).select("label", R("stdev"))


@query(
    "minmax_exponent",
    f"{V} SELECT CAST(floor(log10(min(abs(v)))) AS BIGINT) AS min_exponent, CAST(floor(log10(max(abs(v)))) AS BIGINT) AS max_exponent FROM sig WHERE v <> 0",
)
def _(spark, sf):
    return wf.exponents(S.templates(spark, sf))


@query(
    "template_parts",
    f"""{V}, t AS (SELECT channel, arg_min(idx, (v, idx)) AS p FROM sig GROUP BY 1),
      s AS (SELECT a.channel, max(b.idx) AS m FROM t a JOIN sig b ON a.channel = b.channel AND b.idx BETWEEN 1 AND p
        JOIN sig c ON c.channel = b.channel AND c.idx = b.idx - 1 AND c.v <= b.v GROUP BY 1),
      e AS (SELECT a.channel, min(b.idx) AS m FROM t a JOIN sig b ON a.channel = b.channel AND b.idx BETWEEN p AND 62
        JOIN sig c ON c.channel = b.channel AND c.idx = b.idx + 1 AND c.v <= b.v GROUP BY 1)
      SELECT t.channel, CASE WHEN p > 0 THEN greatest(coalesce(s.m, 1), 1) ELSE 1 END AS start, p AS trough,
        CASE WHEN p < 63 THEN least(coalesce(e.m, 62), 62) ELSE 62 END AS "end" FROM t LEFT JOIN s USING (channel) LEFT JOIN e USING (channel)""",
)
def _(spark, sf):
    d = S.templates(spark, sf).select(F.col("template_id").alias("channel"), wf.parts("waveform").alias("p"))
    return d.select("channel", *[F.col(f"p.{c}").cast("bigint").alias(c) for c in ("start", "trough", "end")])


@query("template_properties")
def _(spark, sf):
    return wf.template_properties(S.templates(spark, sf), ["template_id", "unit_class"], 32)


def _hour_spikes(spark, sf):
    return S.spikes(spark, sf).select(
        "recording_id", F.col("probe").alias("channel"), "spike_id", "cluster_id", F.expr(f"t div {H}").alias("t")
    )


@query(
    "extract_waveforms",
    f"""WITH {S.SPK}, {S.HRS}, s AS (SELECT spike_id, cluster_id, probe, t // {H} AS h, greatest(t // {H} - 4, 0) AS lo FROM spk)
      SELECT spike_id, cluster_id, r.i AS pos, CASE WHEN lo + r.i < least(h + 5, 720) THEN coalesce(v, 0) ELSE 0 END AS v
      FROM s CROSS JOIN range(9) r(i) LEFT JOIN hrs ON hrs.channel = s.probe AND hrs.idx = lo + r.i""",
)
def _(spark, sf):
    c = ch.to_chunks(S.hourly(spark, sf), 120)
    d = wf.extract(_hour_spikes(spark, sf), c, 120, 4)
    return d.select("spike_id", "cluster_id", F.posexplode("waveform").alias("pos", "v")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "spike_templates_mean",
    f"""WITH {S.SPK}, {S.HRS}, s AS (SELECT spike_id, cluster_id, probe, t // {H} AS h, greatest(t // {H} - 4, 0) AS lo FROM spk),
      x AS (SELECT cluster_id, r.i AS pos, CASE WHEN lo + r.i < least(h + 5, 720) THEN coalesce(v, 0) ELSE 0 END AS v
        FROM s CROSS JOIN range(9) r(i) LEFT JOIN hrs ON hrs.channel = s.probe AND hrs.idx = lo + r.i)
      SELECT cluster_id, pos, round(avg(v), 6) AS v FROM x GROUP BY 1, 2""",
)
def _(spark, sf):
    c = ch.to_chunks(S.hourly(spark, sf), 120)
    d = wf.mean_waveforms(wf.extract(_hour_spikes(spark, sf), c, 120, 4), ["cluster_id"])
    return d.select("cluster_id", F.posexplode("waveform").alias("pos", "v")).select("cluster_id", F.col("pos").cast("bigint").alias("pos"), R("v"))


CENTRE = f"""WITH {S.SPK}, {S.HRS}, s AS (SELECT spike_id, cluster_id, probe, t // {H} AS h, greatest(t // {H} - 6, 0) AS lo FROM spk),
  w AS (SELECT spike_id, cluster_id, h, idx, v, lead(v) OVER (PARTITION BY spike_id ORDER BY idx) - v AS dv
    FROM s JOIN hrs ON hrs.channel = s.probe AND idx >= lo AND idx <= h + 6),
  m AS (SELECT spike_id, arg_min(idx, (dv, idx)) FILTER (dv IS NOT NULL) AS mv FROM w GROUP BY 1),
  c AS (SELECT w.spike_id, any_value(cluster_id) AS cluster_id,
      CASE WHEN any_value(h) + 7 < 720 THEN arg_min(idx, (v, idx)) FILTER (idx >= mv AND idx < mv + 10) ELSE any_value(h) END AS centred_t
    FROM w JOIN m USING (spike_id) GROUP BY 1)"""


@query("center_spikes", f"{CENTRE} SELECT spike_id, cluster_id, centred_t FROM c")
def _(spark, sf):
    c = ch.to_chunks(S.hourly(spark, sf), 120)
    return wf.recentred(_hour_spikes(spark, sf), c, 120, 6, 720).select("spike_id", "cluster_id", "centred_t")


@query(
    "duplicate_spikes",
    f"{CENTRE} SELECT cluster_id, count(*) > count(DISTINCT centred_t) AS has_duplicates, count(DISTINCT centred_t) AS n_distinct FROM c GROUP BY 1",
)
def _(spark, sf):
    c = ch.to_chunks(S.hourly(spark, sf), 120)
    return wf.duplicates(wf.recentred(_hour_spikes(spark, sf), c, 120, 6, 720), ["cluster_id"])


@query(
    "reconstruct_cluster",
    f"""WITH {S.SIG}, {S.SPK}, t AS (SELECT channel AS cluster_id, arg_min(idx, (v, idx)) AS p, max(CASE WHEN idx = 0 THEN v END) AS z FROM sig GROUP BY 1),
      s AS (SELECT DISTINCT cluster_id, t // {H} AS h FROM spk)
      SELECT s.cluster_id, h - p + idx AS idx, round(arg_max(v - z, h), 6) AS v FROM s JOIN t USING (cluster_id) JOIN sig ON channel = s.cluster_id
      WHERE h - p + idx BETWEEN 0 AND 719 GROUP BY 1, 2""",
)
def _(spark, sf):
    s = _hour_spikes(spark, sf).select("cluster_id", "t").distinct()
    t = S.templates(spark, sf).withColumnRenamed("template_id", "cluster_id")
    return wf.reconstruct(s, t, 720).select("cluster_id", "idx", R("v"))


def _small_templates(spark, sf):
    """Nine-sample templates on the five hourly channels, cut from the embeddings."""
    t = S.table(spark, sf, "embeddings")
    w = F.transform(F.slice("embedding", F.col("c") * 9 + 1, F.lit(9)), lambda v: v.cast("double"))
    return t.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        F.col("vec_id").alias("template_id"), F.col("c").cast("bigint").alias("channel"), w.alias("waveform")
    )


def _numbered(spark, sf):
    h = S.hourly(spark, sf)
    names = F.array_sort(F.collect_set("channel"))
    order = h.groupBy("recording_id").agg(names.alias("names"))
    return h.join(order, "recording_id").withColumn("channel", (F.array_position("names", F.col("channel")) - 1).cast("bigint")).drop("names")


def _extracted(spark, sf, subtract):
    s = S.spikes(spark, sf).select("recording_id", "spike_id", (F.col("cluster_id") % S.vectors(spark, sf)).alias("template_id"), F.expr(f"t div {H}").alias("t"))
    return wf.extract_channels(s, ch.to_chunks(_numbered(spark, sf), 120), _small_templates(spark, sf), 120, 9, 4, 1, 5, subtract)


@query("extract_waveforms_subtracted")
def _(spark, sf):
    return _extracted(spark, sf, True)


@query(
    "extract_waveforms_channels",
    f"""WITH {S.SPK}, {S.HRS}, nm AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS c FROM (SELECT DISTINCT channel FROM hrs)),
      tp AS (SELECT vec_id AS template_id, c.i AS c, sum(abs(CAST(embedding[CAST(c.i * 9 + k.i + 1 AS INTEGER)] AS DOUBLE))) AS s
        FROM embeddings CROSS JOIN range(5) c(i) CROSS JOIN range(9) k(i) GROUP BY 1, 2),
      b AS (SELECT template_id, arg_max(c, (s, -c)) AS best FROM tp GROUP BY 1),
      w AS (SELECT template_id, greatest(best - 1, 0) AS s0, best + 1 + greatest(1 - best, 0) AS e0 FROM b),
      w2 AS (SELECT template_id, s0 - greatest(e0 - 5, 0) AS s0, e0 - greatest(e0 - 5, 0) AS e0 FROM w),
      sp AS (SELECT spike_id, cluster_id % (SELECT count(*) FROM embeddings) AS template_id, t // {H} AS h FROM spk)
      SELECT spike_id, nm.c AS channel, CAST(9 AS BIGINT) AS n,
        CASE WHEN count(*) = 9 THEN sum(v * (idx - h + 5)) ELSE 0 END AS moment FROM sp JOIN w2 USING (template_id)
      JOIN nm ON nm.c >= s0 AND nm.c < e0 JOIN hrs ON hrs.channel = nm.channel AND idx BETWEEN h - 4 AND h + 4 GROUP BY 1, 2""",
)
def _(spark, sf):
    d = _extracted(spark, sf, False).select("spike_id", "channel", F.posexplode("waveform").alias("p", "v"))
    return d.groupBy("spike_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * (F.col("p") + 1)).alias("moment"))
