"""Whole-channel transforms over embeddings (64 samples at 64 Hz): analytic signals, bands, surrogates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.functions import design
from spikeloom.operators import acquisition as aq
from spikeloom.operators import chunks as ch
from spikeloom.operators import fourier as fo
from spikeloom.plans import q_acquire as qa
from spikeloom.plans.q_spectral import CH, FS, R, _iir_tables
from spikeloom.plans.registry import query
from spikeloom.session import checkpoint

BANDS = {"theta": (4.0, 8.0), "beta": (12.0, 20.0)}
SEED = 42


def _kernel(name, n, lo=0.0, hi=1e9):
    """Impulse response of the analytic signal of n samples, optionally of a band, from its gains."""
    gain = f"CASE WHEN least(k, {n} - k) * {FS} / {n} < {lo} OR least(k, {n} - k) * {FS} / {n} > {hi} THEN 0 WHEN k = 0 OR 2 * k = {n} THEN 1 WHEN 2 * k < {n} THEN 2 ELSE 0 END"
    return f"""{name} AS (SELECT d, sum(g * cos(2 * pi() * k * d / {n})) / {n} AS re, sum(g * sin(2 * pi() * k * d / {n})) / {n} AS im
      FROM (SELECT k, {gain} AS g FROM range({n}) a(k)) CROSS JOIN range({n}) b(d) GROUP BY d)"""


def _analytic(name, source, kernel, n):
    return f"""{name} AS (SELECT s.channel, r.i AS idx, sum(s.v * k.re) AS re, sum(s.v * k.im) AS im FROM {source} s CROSS JOIN range({n}) r(i)
      JOIN {kernel} k ON k.d = (r.i - s.idx + {n}) % {n} GROUP BY 1, 2)"""


def _long(z, size, *columns):
    d = z.select("channel", "chunk", F.posexplode(F.arrays_zip(*columns)).alias("_p", "_z"))
    return d.select("channel", (F.col("chunk") * size + F.col("_p")).alias("idx"), "_z.*")


@query("hilbert_phase", f"WITH {S.SIG}, {_kernel('kn', 64, 4.0, 16.0)}, {_analytic('z', 'sig', 'kn', 64)} SELECT channel, idx, round(atan2(im, re), 5) AS phase FROM z")
def _(spark, sf):
    z = fo.analytic_signal(S.signal_chunks(spark, sf, CH), CH, 4.0, 16.0, FS)
    return _long(z, CH, "re", "im").select("channel", "idx", F.round(F.atan2("im", "re"), 5).alias("phase"))


N_SHORT = (qa.END - qa.START) // 2


@query(
    "hilbert_composed",
    f"""WITH {qa.REFERENCED}, {qa._fir("band", "rf", qa.TAPS, 10, qa.END - qa.START)}, {qa._fir("half", "band", qa.HALVE, 20, qa.END - qa.START, 2)},
      {_kernel("kn", N_SHORT)}, {_analytic("z", "half", "kn", N_SHORT)} SELECT channel, idx, round(re, 6) AS re, round(im, 6) AS im FROM z""",
)
def _(spark, sf):
    d = aq.acquired(S.signal_chunks(spark, sf, CH), CH, qa.channels(spark, sf), qa.probes(spark, sf), FS, start=qa.START, end=qa.END, filtering=qa.BAND)
    return _long(fo.analytic_signal(checkpoint(d), CH // 2), CH // 2, "re", "im").select("channel", "idx", R("re"), R("im"))


def _bands_sql():
    parts, out = [S.SIG, _kernel("kn", 64)], []
    for name, (lo, hi) in BANDS.items():
        text, last = _iir_tables(f"{name}_", design.butterworth(4, FS, lo, hi), True)
        parts += [text, _analytic(f"z_{name}", last, "kn", 64)]
        out.append(f"SELECT channel, '{name}' AS band, idx, round(sqrt(re * re + im * im), 6) AS v FROM z_{name}")
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(out)}"


@query("hilbert_band_power", _bands_sql())
def _(spark, sf):
    return ch.to_long(fo.band_signals(S.signal_chunks(spark, sf, CH), CH, FS, BANDS, "power"), CH).select("channel", "band", "idx", R("v"))


def _draw(x):
    for c in fo.STEPS:
        x = f"SELECT channel, k, (x * x + 3 * x + {c}) % {fo.PRIME} AS x FROM ({x})"
    return x


@query(
    "phase_surrogate",
    f"""WITH {S.SIG}, a AS (SELECT channel, k, sqrt(sum(v * cos(2 * pi() * k * idx / 64)) ** 2 + sum(v * sin(2 * pi() * k * idx / 64)) ** 2) AS amp
        FROM sig CROSS JOIN range(1, 32) r(k) GROUP BY 1, 2),
      c AS (SELECT channel, CAST('0x' || left(md5('{SEED}/embeddings/' || channel), 7) AS BIGINT) AS own FROM (SELECT DISTINCT channel FROM sig)),
      u AS ({_draw(f"SELECT channel, k, (k + own) % {fo.PRIME} AS x FROM c CROSS JOIN range(1, 32) r(k)")})
      SELECT channel, t AS idx, round(sum(amp * cos(2 * pi() * k * t / 64 + 2 * pi() * x / {float(fo.PRIME)})) / 32, 6) AS v
      FROM a JOIN u USING (channel, k) CROSS JOIN range(64) r(t) GROUP BY 1, 2""",
)
def _(spark, sf):
    return ch.to_long(fo.surrogate_channels(S.signal_chunks(spark, sf, CH), CH, SEED), CH).select("channel", "idx", R("v"))
