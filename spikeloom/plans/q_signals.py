"""Dense-signal queries over embeddings (64-sample channels) and hourly counts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.operators import chunks as ch
from spikeloom.operators import signals as sg
from spikeloom.plans.registry import query

V = f"WITH {S.SIG}"
HW = f"WITH {S.HRS}"
SEG = 240  # samples per stretch of the hourly signals
ESEG = 32  # samples per stretch of the 64-sample channels
OUT = ["channel", "idx"]
R6 = lambda c: F.round(c, 6).alias(c)

CHAN_SQL = "ch AS (SELECT vec_id AS channel, 0.5 + label / 10.0 AS coeff FROM embeddings)"


def channels(spark, sf):
    return S.table(spark, sf, "embeddings").select(
        F.lit("embeddings").alias("recording_id"), F.col("vec_id").alias("channel"), (0.5 + F.col("label") / 10.0).alias("coeff")
    )


def _centred(spark, sf):
    s, c = S.signal(spark, sf), channels(spark, sf)
    return sg.scaled(s, sg.channel_means(s, c).join(c, sg.CHAN))


CEN = f"""{CHAN_SQL}, cen AS (SELECT s.channel, s.label, s.idx, s.v * c.coeff - avg(s.v) OVER (PARTITION BY s.channel) * c.coeff AS v
    FROM sig s JOIN ch c USING (channel))"""


@query("scaled_centered", f"{V}, {CEN} SELECT channel, idx, round(v, 6) AS v FROM cen")
def _(spark, sf):
    return _centred(spark, sf).select(*OUT, R6("v"))


@query("channel_means", f"{V}, {CHAN_SQL} SELECT channel, round(avg(v) * any_value(coeff), 6) AS mean FROM sig JOIN ch USING (channel) GROUP BY 1")
def _(spark, sf):
    return sg.channel_means(S.signal(spark, sf), channels(spark, sf)).select("channel", R6("mean"))


@query("signal_hyperslab", f"{V} SELECT channel, idx, v FROM sig WHERE channel BETWEEN 100 AND 199 AND idx >= 16 AND idx < 48")
def _(spark, sf):
    return S.signal(spark, sf).where("channel between 100 and 199 and idx >= 16 and idx < 48").select(*OUT, "v")


@query(
    "mapped_channel",
    f"""{V}, m AS (SELECT label AS probe, channel, row_number() OVER (PARTITION BY label ORDER BY channel DESC) AS mapped,
        min(channel) OVER (PARTITION BY label) AS lo FROM (SELECT DISTINCT label, channel FROM sig))
      SELECT probe, channel, mapped + lo AS physical FROM m""",
)
def _(spark, sf):
    from spikeloom.operators.ordered import in_order

    e = S.table(spark, sf, "embeddings").select(F.col("label").alias("probe"), F.col("vec_id").alias("channel"))
    rank = in_order(e.withColumn("neg", -F.col("channel")), ["probe"], "neg", 100, index="k")
    cmap = rank.select("probe", "channel", (F.col("k") + 1).alias("mapped"))
    probe = e.groupBy("probe").agg(F.min("channel").alias("lo"))
    return sg.mapped_channel(e, cmap, probe).select("probe", "channel", "physical")


for _kind, _fn in (("cmr", "median"), ("car", "avg")):

    @query(f"virtual_ref_{_kind}", f"{V}, {CEN} SELECT label, idx, round({_fn}(v), 6) AS ref FROM cen GROUP BY 1, 2")
    def _(spark, sf, kind=_kind):
        return sg.virtual_reference(_centred(spark, sf), kind, ["label"]).select("label", "idx", R6("ref"))


@query(
    "referenced_signal",
    f"{V}, {CEN} SELECT channel, idx, round(v - median(v) OVER (PARTITION BY label, idx), 6) AS v FROM cen",
)
def _(spark, sf):
    from spikeloom.session import checkpoint

    c = checkpoint(_centred(spark, sf))
    return sg.referenced(c, sg.virtual_reference(c, "cmr", ["label"]), ["label"]).select(*OUT, R6("v"))


@query("avg_acq", f"{V} SELECT idx, round(avg(v), 6) AS v FROM sig GROUP BY 1")
def _(spark, sf):
    return sg.virtual_reference(S.signal(spark, sf), "car").select("idx", F.round("ref", 6).alias("v"))


@query(
    "mad_per_channel",
    f"""{V}, m AS (SELECT channel, abs(v - median(v) OVER (PARTITION BY channel)) AS d FROM sig)
      SELECT channel, round(median(d) / 0.6744897501960817, 6) AS mad FROM m GROUP BY 1""",
)
def _(spark, sf):
    return sg.mad(S.signal(spark, sf)).select("channel", R6("mad"))


def _labelled_chunks(spark, sf):
    lab = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("channel"), "label")
    return S.signal_chunks(spark, sf).join(lab, "channel")


@query(
    "corr_matrix",
    f"{V} SELECT a.channel AS i, b.channel AS j, round(corr(a.v, b.v), 6) AS r FROM sig a JOIN sig b ON a.label = b.label AND a.idx = b.idx AND a.channel < b.channel GROUP BY 1, 2",
)
def _(spark, sf):
    return sg.correlation_matrix(_labelled_chunks(spark, sf), ["label"]).select("i", "j", R6("r"))


@query(
    "gram_matrix",
    f"{V} SELECT a.channel AS i, b.channel AS j, round(sum(a.v * b.v), 6) AS sxy FROM sig a JOIN sig b ON a.label = b.label AND a.idx = b.idx AND a.channel <= b.channel GROUP BY 1, 2",
)
def _(spark, sf):
    return sg.channel_products(_labelled_chunks(spark, sf), ["label"], ["sxy"]).select("i", "j", R6("sxy"))


@query("whitened_signal")
def _(spark, sf):
    from spikeloom.session import checkpoint

    probe = F.expr("channel div 16").alias("probe")
    m = checkpoint(sg.whitening(S.signal_chunks(spark, sf).select("*", probe), ["probe"], 16))
    return sg.whiten(S.signal(spark, sf).select("*", probe), m, ["probe"]).select(*OUT, R6("v"))


# Pairs of hourly channels in alphabetical order.
PAIR = """pr AS (SELECT a.channel AS c1, b.channel AS c2, a.idx, a.v AS x, b.v AS y
    FROM hrs a JOIN hrs b ON a.idx = b.idx AND a.channel < b.channel)"""


def _pairs(spark, sf):
    h = S.hourly(spark, sf)
    a = h.select("recording_id", F.col("channel").alias("c1"), "idx", F.col("v").alias("x"))
    b = h.select("recording_id", F.col("channel").alias("c2"), "idx", F.col("v").alias("y"))
    return a.join(b, ["recording_id", "idx"]).where("c1 < c2").select("c1", "c2", "idx", "x", "y")


LAGS = 24
PKEY = ["c1", "c2"]


def _sides(spark, sf):
    p = _pairs(spark, sf)
    return p.select(*PKEY, "idx", F.col("x").alias("v")), p.select(*PKEY, "idx", F.col("y").alias("v"))


LAGGED = f"""{HW}, {PAIR}, lg AS (SELECT a.c1, a.c2, r.i AS lag, a.x, b.y FROM pr a CROSS JOIN range(-{LAGS}, {LAGS + 1}) r(i)
    JOIN pr b ON a.c1 = b.c1 AND a.c2 = b.c2 AND b.idx = a.idx + r.i)"""


@query(
    "xcorr_lag",
    f"""{LAGGED}, n AS (SELECT c1, c2, sqrt(sum(x * x)) * sqrt(sum(y * y)) AS n FROM pr GROUP BY 1, 2)
      SELECT c1, c2, lag, round(sum(x * y) / any_value(n), 6) AS xcorr FROM lg JOIN n USING (c1, c2) WHERE lag < {LAGS} GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    d = sg.cross_correlation(*_sides(spark, sf), LAGS, PKEY)
    return d.select(*PKEY, F.col("lag").cast("bigint").alias("lag"), R6("xcorr"))


@query("cross_corr_pearson", f"{LAGGED} SELECT c1, c2, lag, round(corr(x, y), 6) AS r FROM lg GROUP BY 1, 2, 3")
def _(spark, sf):
    p = sg.lagged_products(*_sides(spark, sf), LAGS, PKEY)
    return p.select(*PKEY, F.col("lag").cast("bigint").alias("lag"), F.round(sg.pearson_of(p), 6).alias("r"))


@query(
    "sliding_corr",
    f"""{HW}, {PAIR} SELECT c1, c2, idx, round(coalesce(r, 0), 5) AS r FROM (SELECT *,
        CASE WHEN var_pop(x) OVER w > 0 AND var_pop(y) OVER w > 0 THEN corr(x, y) OVER w ELSE 0 END AS r FROM pr
        WINDOW w AS (PARTITION BY c1, c2 ORDER BY idx ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)) WHERE idx + 25 <= {S.HOURS - 1}""",
)
def _(spark, sf):
    return sg.sliding_correlation(_pairs(spark, sf), PKEY, 25, SEG).select(*PKEY, "idx", F.round("r", 5).alias("r"))


@query(
    "rolling_mean",
    f"{HW} SELECT channel, idx, round(avg(v) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS m FROM hrs",
)
def _(spark, sf):
    return sg.moving(S.hourly(spark, sf), "m", F.avg, 12, 12, SEG).select(*OUT, R6("m"))


@query(
    "median_filter",
    f"""{V}, p AS (SELECT a.channel, a.idx, b.v FROM sig a JOIN sig b ON a.channel = b.channel AND abs(a.idx - b.idx) <= 2
        UNION ALL SELECT channel, idx, 0.0 FROM sig CROSS JOIN range(-2, 3) r(i) WHERE idx + r.i < 0 OR idx + r.i > 63)
      SELECT channel, idx, median(v) AS filtered FROM p GROUP BY 1, 2""",
)
def _(spark, sf):
    return sg.median_filter(S.signal(spark, sf), 5, ESEG, S.SAMPLES).select(*OUT, "filtered")


HAM = [0.54 - 0.46 * math.cos(2 * math.pi * i / 8) for i in range(8)]
HAM = [x / sum(HAM) for x in HAM]


def _conv_sql(src, w, shift, value="v", hi=64):
    vals = ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w))
    return f""", w(m, w) AS (VALUES {vals}) SELECT channel, idx + m - {shift} AS idx, round(sum({value} * w), 6) AS v
      FROM {src} CROSS JOIN w WHERE idx + m - {shift} BETWEEN 0 AND {hi - 1} GROUP BY 1, 2"""


@query("ste_hamming", V + _conv_sql("sig", HAM, 4, "v * v"))
def _(spark, sf):
    c = S.signal_chunks(spark, sf).withColumn("samples", F.transform("samples", lambda v: v * v))
    return ch.to_long(ch.fir(c, 16, HAM, 4), 16).select(*OUT, R6("v"))


@query(
    "ste_boxcar",
    f"{HW} SELECT channel, idx, round(avg(v * v) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS ste FROM hrs",
)
def _(spark, sf):
    return sg.moving(S.hourly(spark, sf), "ste", lambda v: F.avg(v * v), 3, 3, SEG).select(*OUT, R6("ste"))


FIR = [-0.05, 0.1, 0.25, 0.4, 0.25, 0.1, -0.05]


@query("fir_offset_join", V + _conv_sql("sig", FIR, 3))
def _(spark, sf):
    return ch.to_long(ch.fir(S.signal_chunks(spark, sf), 16, FIR, 3), 16).select(*OUT, R6("v"))


@query("convolve_full", V + _conv_sql("sig", FIR, 0, hi=70))
def _(spark, sf):
    return sg.convolve(S.signal(spark, sf), FIR, 0).select(*OUT, R6("v"))


EXT = """ex AS (SELECT channel, idx, v, CASE WHEN sign(n - v) > sign(v - p) THEN 'min' WHEN sign(n - v) < sign(v - p) THEN 'max' END AS kind
    FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM sig WINDOW w AS (PARTITION BY channel ORDER BY idx)))"""


@query("local_extrema", f"{V}, {EXT} SELECT channel, idx, kind FROM ex WHERE kind IS NOT NULL")
def _(spark, sf):
    return sg.extrema(S.signal(spark, sf), ESEG).select(*OUT, "kind")


@query(
    "envelope_index",
    f"""{V}, {EXT}, k AS (SELECT *, (row_number() OVER (PARTITION BY channel, kind ORDER BY idx) - 1) // 3 AS g FROM ex WHERE kind IS NOT NULL)
      SELECT channel, kind, CASE WHEN kind = 'min' THEN arg_min(idx, (v, idx)) ELSE arg_min(idx, (-v, idx)) END AS idx FROM k GROUP BY channel, kind, g""",
)
def _(spark, sf):
    d = sg.chunked_extrema(sg.extrema(S.signal(spark, sf), ESEG), 3, 3, ESEG)
    return d.select("channel", "kind", "idx")


@query(
    "local_minimum_order",
    f"""{V} SELECT a.channel, a.idx FROM sig a JOIN sig b ON a.channel = b.channel AND b.idx <> a.idx AND abs(a.idx - b.idx) <= 5
      WHERE a.idx BETWEEN 5 AND 58 GROUP BY 1, 2, a.v HAVING a.v < min(b.v)""",
)
def _(spark, sf):
    return sg.local_minimum(S.signal(spark, sf), 5, ESEG).select(*OUT)


@query(
    "mutual_info",
    f"""{HW}, {PAIR}, l AS (SELECT c1, c2, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(*) AS n FROM pr GROUP BY 1, 2),
      b AS (SELECT c1, c2, n, CASE WHEN hx > lx THEN least(floor((x - lx) / ((hx - lx) / 20)), 19) ELSE 0 END AS bx,
          CASE WHEN hy > ly THEN least(floor((y - ly) / ((hy - ly) / 20)), 19) ELSE 0 END AS by_ FROM pr JOIN l USING (c1, c2)),
      j AS (SELECT c1, c2, n, bx, by_, count(*) AS c FROM b GROUP BY ALL),
      t AS (SELECT *, sum(c) OVER (PARTITION BY c1, c2, bx) AS mx, sum(c) OVER (PARTITION BY c1, c2, by_) AS my FROM j)
      SELECT c1, c2, round(sum(c / CAST(n AS DOUBLE) * log2(c * CAST(n AS DOUBLE) / (mx * my))), 6) AS mi FROM t GROUP BY 1, 2""",
)
def _(spark, sf):
    return sg.mutual_information(_pairs(spark, sf), PKEY).select(*PKEY, R6("mi"))



@query(
    "bin_by_phase",
    f"""{HW}, p AS (SELECT channel, v, CAST(floor((2 * pi() * (idx % 24) / 24.0) / (2 * pi() / 18)) AS INTEGER) AS bin FROM hrs),
      g AS (SELECT channel, bin, avg(v) AS a FROM p GROUP BY 1, 2)
      SELECT c.channel, r.i AS bin, round(coalesce(a, 0), 6) AS value FROM (SELECT DISTINCT channel FROM hrs) c
      CROSS JOIN range(18) r(i) LEFT JOIN g ON g.channel = c.channel AND g.bin = r.i""",
)
def _(spark, sf):
    phase = F.lit(2 * math.pi) * (F.col("idx") % 24) / 24.0
    d = sg.bin_by(S.hourly(spark, sf), ["channel"], phase, F.col("v"), 18, 0.0, 2 * math.pi)
    return d.select("channel", F.col("bin").cast("bigint").alias("bin"), R6("value"))


@query("bin_counts_true_hist", f"{V} SELECT label, CAST(least(floor((v - -1.0) / 0.1), 19) AS BIGINT) AS bin, count(*) AS n FROM sig WHERE v BETWEEN -1 AND 1 GROUP BY 1, 2")
def _(spark, sf):
    b = F.least(F.floor((F.col("v") - -1.0) / 0.1), F.lit(19)).cast("bigint")
    return S.signal(spark, sf).where("v between -1 and 1").groupBy("label", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("rms_segments", f"{V} SELECT channel, idx // 16 AS seg, round(sqrt(avg(v * v)), 6) AS rms FROM sig GROUP BY 1, 2")
def _(spark, sf):
    d = S.signal(spark, sf).groupBy("channel", F.expr("idx div 16").alias("seg"))
    return d.agg(F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 6).alias("rms"))


@query("where_count", "SELECT user_id, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY 1")
def _(spark, sf):
    return S.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))


@query(
    "autocov",
    f"""{HW}, c AS (SELECT channel, idx, v - avg(v) OVER (PARTITION BY channel) AS v FROM hrs)
      SELECT a.channel, r.i AS lag, round(sum(a.v * b.v) / {S.HOURS}, 6) AS cov FROM c a CROSS JOIN range(49) r(i)
      JOIN c b ON a.channel = b.channel AND b.idx = a.idx + r.i GROUP BY 1, 2""",
)
def _(spark, sf):
    d = sg.autocovariance(S.hourly(spark, sf), 48, ["channel"])
    return d.select("channel", F.col("lag").cast("bigint").alias("lag"), R6("cov"))


@query(
    "instantaneous_frequency",
    f"""{V}, p AS (SELECT channel, idx, atan2(v, 0.05) AS v FROM sig),
      d AS (SELECT *, v - lag(v) OVER w AS b0, lead(v) OVER w - v AS a0 FROM p WINDOW w AS (PARTITION BY channel ORDER BY idx)),
      u AS (SELECT *, b0 - floor((b0 + pi()) / (2 * pi())) * 2 * pi() AS b, a0 - floor((a0 + pi()) / (2 * pi())) * 2 * pi() AS a FROM d)
      SELECT channel, idx, round(1000 / (2 * pi()) * coalesce((a + b) / 2, a, b), 5) AS freq FROM u""",
)
def _(spark, sf):
    p = S.signal(spark, sf).withColumn("v", F.atan2("v", F.lit(0.05)))
    return sg.instantaneous_frequency(p, 1000.0, ESEG).select(*OUT, F.round("freq", 5).alias("freq"))
