"""Compile-and-clean queries over per-customer tables standing in for unit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import clean as cl
from spikeloom.operators import pairs as pr
from spikeloom.plans.q_pairs import sttc_sql
from spikeloom.plans.registry import query

H, T, SEG = S.HOUR_US, S.STOP_US, S.SEGMENT_US

# Unit tables: every customer is a unit, the nation its recording. Customers without orders
# are the keys that outer merges have on one side only.
A = """ta AS (SELECT c_nationkey AS id, c_custkey AS cluster_id, count(*) AS n_spikes,
      count(*) FILTER (o_orderstatus = 'F') AS num_violations, min(o_totalprice) AS start_y, max(o_totalprice) AS end_y
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
B = """tb AS (SELECT c_nationkey AS id, c_custkey AS cluster_id,
      count(*) FILTER (o_totalprice > 250000) AS num_bursts, avg(o_totalprice) FILTER (o_totalprice > 250000) AS intra_burst_iei,
      stddev_pop(o_totalprice) AS inter_burst_iei
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
C = """tc AS (SELECT c_nationkey AS id, c_custkey AS cluster_id, c_acctbal AS min_y, c_acctbal / 2 AS center_y,
      CAST(c_custkey % 60 AS DOUBLE) AS min_x, CAST(c_custkey % 20 AS DOUBLE) AS start, CAST(41 AS DOUBLE) AS center,
      CAST(60 + c_custkey % 7 AS DOUBLE) AS "end" FROM customer)"""
MERGED = f"WITH {A}, {B}, {C}, mg AS (SELECT * FROM ta FULL JOIN tb USING (id, cluster_id) FULL JOIN tc USING (id, cluster_id))"


def unit_tables(spark, sf):
    o = S.table(spark, sf, "orders").join(
        S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).withColumnsRenamed({"c_nationkey": "id", "c_custkey": "cluster_id"})
    a = o.groupBy(*cl.KEY).agg(
        F.count(F.lit(1)).alias("n_spikes"), F.count_if(F.col("o_orderstatus") == "F").alias("num_violations"),
        F.min("o_totalprice").alias("start_y"), F.max("o_totalprice").alias("end_y"),
    )
    big = F.col("o_totalprice") > 250000
    b = o.groupBy(*cl.KEY).agg(
        F.count_if(big).alias("num_bursts"), F.avg(F.when(big, F.col("o_totalprice"))).alias("intra_burst_iei"),
        F.stddev_pop("o_totalprice").alias("inter_burst_iei"),
    )
    c = S.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("cluster_id"), F.col("c_acctbal").alias("min_y"),
        (F.col("c_acctbal") / 2).alias("center_y"), (F.col("c_custkey") % 60).cast("double").alias("min_x"),
        (F.col("c_custkey") % 20).cast("double").alias("start"), F.lit(41.0).alias("center"),
        (60 + F.col("c_custkey") % 7).cast("double").alias("end"),
    )
    return a, b, c


def merged(spark, sf):
    return cl.outer_merge(unit_tables(spark, sf))


IDS = ["id", "cluster_id"]


@query(
    "outer_merge_three",
    f"""{MERGED} SELECT id, cluster_id, n_spikes, num_violations, start_y, end_y, num_bursts,
      round(intra_burst_iei, 6) AS intra_burst_iei, round(inter_burst_iei, 4) AS inter_burst_iei, min_y, min_x FROM mg""",
)
def _(spark, sf):
    return merged(spark, sf).select(
        *IDS, "n_spikes", "num_violations", "start_y", "end_y", "num_bursts",
        F.round("intra_burst_iei", 6).alias("intra_burst_iei"), F.round("inter_burst_iei", 4).alias("inter_burst_iei"),
        "min_y", "min_x",
    )


DER = [
    "intra_burst_hz", "inter_burst_hz", "ce_ratio", "ce_time", "cs_time", "me_time", "me_ratio", "ms_time", "ms_ratio",
    "amplitude_l", "amplitude_r", "violation_rate",
]
DERIVED = """dv AS (SELECT *, CASE WHEN intra_burst_iei = 0 THEN 0.0 ELSE 1 / nullif(intra_burst_iei, 0) END AS intra_burst_hz,
    CASE WHEN inter_burst_iei = 0 THEN 0.0 ELSE 1 / nullif(inter_burst_iei, 0) END AS inter_burst_hz,
    CAST(CASE WHEN num_bursts = 0 THEN 0 ELSE 1 END AS INTEGER) AS bursting_cell, center_y / nullif(end_y, 0) AS ce_ratio,
    "end" - center AS ce_time, center - start AS cs_time, "end" - min_x AS me_time, min_y / nullif(end_y, 0) AS me_ratio,
    min_x - start AS ms_time, min_y / nullif(start_y, 0) AS ms_ratio, abs(min_y - end_y) AS amplitude_l,
    abs(min_y - start_y) AS amplitude_r, num_violations / CAST(n_spikes AS DOUBLE) AS violation_rate FROM mg)"""


@query(
    "derived_columns_null_safe",
    f"{MERGED}, {DERIVED} SELECT id, cluster_id, bursting_cell, {', '.join(f'round({c}, 8) AS {c}' for c in DER)} FROM dv",
)
def _(spark, sf):
    d = cl.derived_columns(merged(spark, sf))
    return d.select(*IDS, "bursting_cell", *[F.round(c, 8).alias(c) for c in DER])


def cleaned(spark, sf):
    d = cl.derived_columns(merged(spark, sf))
    return cl.drop_rows(
        d, F.col("min_x") < 30, F.col("min_x") > 50, F.col("intra_burst_iei") > 300000, F.col("n_spikes") < 5,
        F.col("ms_time") < 0, F.col("violation_rate") > 0.6,
    )


QC = """qc AS (SELECT * FROM dv WHERE coalesce(NOT (min_x < 30), true) AND coalesce(NOT (min_x > 50), true)
    AND coalesce(NOT (intra_burst_iei > 300000), true) AND coalesce(NOT (n_spikes < 5), true)
    AND coalesce(NOT (ms_time < 0), true) AND coalesce(NOT (violation_rate > 0.6), true))"""
CLEAN = f"{MERGED}, {DERIVED}, {QC}"


@query("qc_drop_keep_null", f"{CLEAN} SELECT id, cluster_id, n_spikes, min_x FROM qc")
def _(spark, sf):
    return cleaned(spark, sf).select(*IDS, "n_spikes", "min_x")


@query("anti_removed_units", f"{CLEAN} SELECT id, cluster_id FROM dv ANTI JOIN qc USING (id, cluster_id)")
def _(spark, sf):
    return cl.derived_columns(merged(spark, sf)).join(cleaned(spark, sf), IDS, "left_anti").select(*IDS)


@query(
    "inner_merge_templates",
    f"{CLEAN} SELECT id, cluster_id, label AS unit_class, n_spikes FROM qc JOIN embeddings ON vec_id = cluster_id",
)
def _(spark, sf):
    t = S.templates(spark, sf).withColumnRenamed("template_id", "cluster_id")
    return cleaned(spark, sf).join(t, "cluster_id").select(*IDS, "unit_class", "n_spikes")


@query(
    "template_noise_filter",
    """SELECT vec_id AS template_id FROM embeddings WHERE len(list_filter(list_slice(embedding, 1, 6), lambda x: x < -0.2)) = 0
       AND len(list_filter(list_slice(embedding, 61, 64), lambda x: x < -0.2)) = 0""",
)
def _(spark, sf):
    return S.templates(spark, sf).where(cl.quiet_flanks("waveform", -0.2, 6, 60)).select("template_id")


@query(
    "intersect_keep",
    """SELECT vec_id AS template_id FROM embeddings WHERE len(list_filter(list_slice(embedding, 1, 20), lambda x: x < -0.4)) = 0
       INTERSECT SELECT vec_id FROM embeddings WHERE len(list_filter(list_slice(embedding, 51, 64), lambda x: x < -0.4)) = 0""",
)
def _(spark, sf):
    t = S.templates(spark, sf)
    left = t.where(~F.exists(F.slice("waveform", 1, 20), lambda x: x < -0.4)).select("template_id")
    right = t.where(~F.exists(F.slice("waveform", 51, 14), lambda x: x < -0.4)).select("template_id")
    return left.intersect(right)


def _windows(spark, sf):
    p = pr.sttc_windows(S.spikes(spark, sf), [4 * H, H], 0, T, SEG, counts=["n1_dt_2_1"]).withColumnRenamed("recording_id", "id")
    return cl.window_merge(p, {"wide": ("sttc_0", F.lit(True)), "narrow": ("sttc_1", F.col("n1_dt_2_1") > 0)})


def _good(spark, sf):
    """Units with an amplitude mean above 50, and their cell types."""
    s = S.spikes(spark, sf).groupBy(F.col("recording_id").alias("id"), "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg("amplitude").alias("m"))
    return s.where("n > 64").withColumn("cell_type", F.when(F.col("n") % 2 == 0, "pyr").otherwise("int"))


PAIRS = f"""wide AS (SELECT * FROM (WITH {sttc_sql(4 * H)} SELECT * FROM st) WHERE sttc <> 1.0),
  narrow AS (SELECT * FROM (WITH {sttc_sql(H)} SELECT * FROM st) WHERE sttc <> 1.0 AND n1_dt_2 > 0),
  wm AS (SELECT cluster1_id, cluster2_id, w.sttc AS sttc_wide, n.sttc AS sttc_narrow
    FROM wide w FULL JOIN narrow n USING (cluster1_id, cluster2_id)),
  good AS (SELECT cluster_id, CASE WHEN count(*) % 2 = 0 THEN 'pyr' ELSE 'int' END AS cell_type FROM spk GROUP BY 1 HAVING count(*) > 64)"""
PW = f"WITH {S.SPK}, {PAIRS}"


@query(
    "multi_window_outer",
    f"""{PW} SELECT 'events_' || cluster1_id AS uid1, 'events_' || cluster2_id AS uid2, round(sttc_wide, 6) AS sttc_wide,
      round(sttc_narrow, 6) AS sttc_narrow FROM wm""",
)
def _(spark, sf):
    return _windows(spark, sf).select("uid1", "uid2", F.round("sttc_wide", 6).alias("sttc_wide"), F.round("sttc_narrow", 6).alias("sttc_narrow"))


@query(
    "semi_both_endpoints",
    f"""{PW} SELECT cluster1_id, cluster2_id, round(sttc_wide, 6) AS sttc_wide FROM wm
      WHERE cluster1_id IN (SELECT cluster_id FROM good) AND cluster2_id IN (SELECT cluster_id FROM good)""",
)
def _(spark, sf):
    d = cl.both_ends_good(_windows(spark, sf), _good(spark, sf))
    return d.select("cluster1_id", "cluster2_id", F.round("sttc_wide", 6).alias("sttc_wide"))


@query(
    "stack_pairs_mean_per_cell",
    f"""{PW} SELECT cluster_id, round(avg(sttc_wide), 6) AS sttc_wide, round(avg(sttc_narrow), 6) AS sttc_narrow FROM (
      SELECT cluster1_id AS cluster_id, sttc_wide, sttc_narrow FROM wm UNION ALL SELECT cluster2_id, sttc_wide, sttc_narrow FROM wm)
      JOIN good USING (cluster_id) GROUP BY 1""",
)
def _(spark, sf):
    d = cl.mean_per_unit(_windows(spark, sf), _good(spark, sf), ["sttc_wide", "sttc_narrow"])
    return d.select("cluster_id", F.round("sttc_wide", 6).alias("sttc_wide"), F.round("sttc_narrow", 6).alias("sttc_narrow"))


@query(
    "cell_type_lookup",
    f"""{PW} SELECT cluster1_id, cluster2_id, a.cell_type AS cell_type1, b.cell_type AS cell_type2 FROM wm
      LEFT JOIN good a ON a.cluster_id = cluster1_id LEFT JOIN good b ON b.cluster_id = cluster2_id""",
)
def _(spark, sf):
    d = cl.assign_cell_types(_windows(spark, sf), _good(spark, sf))
    return d.select("cluster1_id", "cluster2_id", "cell_type1", "cell_type2")


@query(
    "final_unit_table",
    f"""{PW}, mc AS (SELECT cluster_id, avg(sttc_wide) AS sttc_wide FROM (
      SELECT cluster1_id AS cluster_id, sttc_wide FROM wm UNION ALL SELECT cluster2_id, sttc_wide FROM wm)
      JOIN good USING (cluster_id) GROUP BY 1),
      u AS (SELECT c_custkey AS cluster_id, c_acctbal FROM customer)
      SELECT cluster_id, c_acctbal, round(sttc_wide, 6) AS sttc_wide FROM u FULL JOIN mc USING (cluster_id)""",
)
def _(spark, sf):
    d = cl.mean_per_unit(_windows(spark, sf), _good(spark, sf), ["sttc_wide"])
    u = S.table(spark, sf, "customer").select(
        F.lit("events").alias("id"), F.col("c_custkey").alias("cluster_id"), "c_acctbal"
    )
    return cl.outer_merge([u, d]).select("cluster_id", "c_acctbal", F.round("sttc_wide", 6).alias("sttc_wide"))


@query(
    "union_all_tagged",
    """SELECT c_custkey AS unit, c_acctbal AS v, 'customer' AS id FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""",
)
def _(spark, sf):
    return cl.union_tagged(
        {
            "customer": S.table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("v")),
            "supplier": S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("v")),
        }
    )


@query(
    "recording_pair_match",
    """SELECT p_partkey AS recording, l_orderkey AS sorting, stem FROM
      (SELECT p_partkey, p_brand || '_' || p_size AS stem FROM part) JOIN
      (SELECT DISTINCT l_orderkey, p_brand || '_' || l_linenumber AS stem FROM lineitem JOIN part ON p_partkey = l_partkey
       ) USING (stem) WHERE list_contains(string_split(stem, '_'), '5')""",
)
def _(spark, sf):
    p = S.table(spark, sf, "part")
    rec = p.select(F.col("p_partkey").alias("recording"), F.concat_ws("_", "p_brand", "p_size").alias("stem"))
    srt = (
        S.table(spark, sf, "lineitem")
        .join(p, F.col("p_partkey") == F.col("l_partkey"))
        .select(F.col("l_orderkey").alias("sorting"), F.concat_ws("_", "p_brand", "l_linenumber").alias("stem")).distinct()
    )
    return cl.matched_stems(rec, srt, "5")


@query(
    "round_sig4",
    """SELECT o_orderkey, CASE WHEN x = 0 THEN 0.0 ELSE round(x * pow(10, 3 - floor(log10(abs(x))))) / pow(10, 3 - floor(log10(abs(x)))) END AS r
       FROM (SELECT o_orderkey, o_totalprice / 7 AS x FROM orders)""",
)
def _(spark, sf):
    return S.table(spark, sf, "orders").select("o_orderkey", cl.round_sig(F.col("o_totalprice") / 7).alias("r"))
