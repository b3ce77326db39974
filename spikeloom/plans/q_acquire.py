"""Composed reads over embeddings as recordings: probes of 64 neighbouring channels, 64 samples at 64 Hz."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.functions import design
from spikeloom.operators import acquisition as aq
from spikeloom.operators import chunks as ch
from spikeloom.plans.q_spectral import CH, FS, R, _vals
from spikeloom.plans.registry import query
from spikeloom.sources.recording import FilterSettings

WIDTH, START, END = 64, 5, 59
BAND = FilterSettings("fir_zero_2", 21, 4.0, 1.0, 12.0, 1.0, sample_rate=32.0)


def channels(spark, sf):
    """Coefficient and mean of every channel."""
    raw = S.signal_chunks(spark, sf, CH).groupBy(*ch.CHAN).agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("s"), F.sum(F.size("samples")).alias("n"))
    lab = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("channel"), (0.5 + F.col("label") / 10.0).alias("coeff"))
    return raw.join(lab, "channel").select(*ch.CHAN, "coeff", (F.col("s") / F.col("n") * F.col("coeff")).alias("mean"))


def probes(spark, sf):
    """Probes of WIDTH channels."""
    lo = F.col("vec_id") - F.pmod("vec_id", F.lit(WIDTH))
    return S.table(spark, sf, "embeddings").select(F.lit("embeddings").alias("recording_id"), lo.alias("lo")).distinct().select("recording_id", F.expr(f"lo div {WIDTH}").alias("probe"), "lo", (F.col("lo") + WIDTH).alias("hi"))


def reversed_map(spark, sf):
    """A permutation within every probe: the last channel first."""
    k = F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1)).cast("array<bigint>"))
    return probes(spark, sf).select("probe", k.alias("channel")).withColumn("mapped", F.lit(WIDTH - 1) - F.col("channel"))


def recordings(spark, sf):
    """The samples of the recording that analyses use: all but the first two and last three of the widest channel."""
    return S.table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("n")).select(F.lit("embeddings").alias("recording_id"), F.lit(2).cast("bigint").alias("start"), (F.col("n") - 3).cast("bigint").alias("stop"))


# Scaled samples of the window, numbered anew, less the median of their probe.
WINDOW = f"""{S.SIG}, chn AS (SELECT vec_id AS channel, 0.5 + label / 10.0 AS coeff FROM embeddings),
  sc AS (SELECT s.channel, s.channel // {WIDTH} AS probe, s.idx, s.v * c.coeff - avg(s.v) OVER (PARTITION BY s.channel) * c.coeff AS v FROM sig s JOIN chn c USING (channel))"""
REFERENCED = f"""{WINDOW}, rf AS (SELECT channel, probe, idx - {START} AS idx, v - median(v) OVER (PARTITION BY probe, idx) AS v FROM sc WHERE idx >= {START} AND idx < {END})"""


def _fir(name, source, w, shift, n, step=1):
    vals = _vals(f"{name}_w", "m, w", [(i, float(x)) for i, x in enumerate(w)])
    return f"""{vals}, {name} AS (SELECT channel, (idx + m - {shift}) // {step} AS idx, sum(v * w) AS v FROM {source} CROSS JOIN {name}_w
      WHERE idx + m - {shift} BETWEEN 0 AND {n - 1} AND (idx + m - {shift}) % {step} = 0 GROUP BY 1, 2)"""


TAPS = design.firwin_shape(21, [0.0, 3.0, 4.0, 12.0, 13.0, 32.0], [0.0, 0.0, 1.0, 1.0, 0.0, 0.0], FS, design.window("hann", 21, periodic=False))
HALVE = design.firwin_lowpass(41, 0.5)


@query(
    "acq_composed",
    f"""WITH {REFERENCED}, nm AS (SELECT probe * {WIDTH} + {WIDTH - 1} - (channel - probe * {WIDTH}) AS channel, idx, v FROM rf),
      {_fir("band", "nm", TAPS, 10, END - START)}, {_fir("half", "band", HALVE, 20, END - START, 2)}
      SELECT channel, idx, round(v, 6) AS v FROM half""",
)
def _(spark, sf):
    d = aq.acquired(S.signal_chunks(spark, sf, CH), CH, channels(spark, sf), probes(spark, sf), FS, start=START, end=END, mapped=reversed_map(spark, sf), filtering=BAND)
    return ch.to_long(d, CH // 2).select("channel", "idx", R("v"))


@query("acq_referenced", f"WITH {REFERENCED} SELECT channel, idx, round(v, 6) AS v FROM rf")
def _(spark, sf):
    d = aq.acquired(S.signal_chunks(spark, sf, CH), CH, channels(spark, sf), probes(spark, sf), FS, start=START, end=END)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query(
    "acq_probe_average",
    f"""WITH {WINDOW}, n AS (SELECT max(len(embedding)) AS n FROM embeddings)
      SELECT probe * {WIDTH} AS channel, idx - 2 AS idx, round(avg(v), 6) AS v FROM sc, n WHERE idx >= 2 AND idx < n.n - 3 GROUP BY 1, 2""",
)
def _(spark, sf):
    d = aq.acquired(S.signal_chunks(spark, sf, CH), CH, channels(spark, sf), probes(spark, sf), FS, recordings=recordings(spark, sf), reference="none", average="mean")
    return ch.to_long(d, CH).select("channel", "idx", R("v"))


@query(
    "acq_probe_gram",
    f"""WITH {REFERENCED} SELECT a.probe, a.channel AS i, b.channel AS j, count(*) AS n, round(sum(a.v * b.v), 6) AS sxy
      FROM rf a JOIN rf b ON a.probe = b.probe AND a.idx = b.idx GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    d = aq.acquired(S.signal_chunks(spark, sf, CH), CH, channels(spark, sf), probes(spark, sf), FS, start=START, end=END)
    d = d.join(aq.probe_channels(probes(spark, sf)).select(*ch.CHAN, "probe"), ch.CHAN)
    return aq.probe_gram(d, ["probe"]).select("probe", "i", "j", "n", R("sxy"))


# Small inverse roots are no SQL: a test compares with plain matrix algebra.
@query("acq_whitened_local")
def _(spark, sf):
    d = aq.acquired(S.signal_chunks(spark, sf, CH), CH, channels(spark, sf), probes(spark, sf), FS, reference="car", whiten=True, neighbours=4)
    return ch.to_long(d, CH).select("channel", "idx", R("v"))
