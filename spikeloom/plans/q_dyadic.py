"""Wavelet filters and envelopes over embeddings (64 samples)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikeloom import schema as S
from spikeloom.functions import design
from spikeloom.operators import chunks as ch
from spikeloom.operators import dyadic, splines
from spikeloom.plans.q_spectral import CH, R, _vals
from spikeloom.plans.registry import query

N, TAPS = 64, design.daubechies(4)


def _sql(drop, kind):
    """Analysis and synthesis of three levels, with parts left out, from sums over taps."""
    low, high, up, over = design.quadrature(TAPS)
    parts = [S.SIG, _vals("w", "j, lo, hi, up, ov", [(j, float(low[j]), float(high[j]), float(up[j]), float(over[j])) for j in range(8)]), "a0 AS (SELECT channel, idx, v AS a FROM sig)"]
    size = [N]
    levels = dyadic.most_levels(N, 8)
    zero = set(range(drop)) if kind == "highpass" else set(range(levels + 1 - drop, levels + 1))
    for level in range(1, levels + 1):
        n = size[-1]
        size.append((n + 7) // 2)
        turned = f"((2 * k + 1 - j) % {2 * n} + {2 * n}) % {2 * n}"
        parts.append(f"""a{level} AS (SELECT s.channel, k AS idx, sum(lo * s.a) AS a, sum(hi * s.a) AS d FROM range({size[-1]}) r(k) CROSS JOIN w
          JOIN a{level - 1} s ON s.idx = CASE WHEN {turned} < {n} THEN {turned} ELSE {2 * n - 1} - {turned} END GROUP BY 1, 2)""")
    parts.append(f"y{levels} AS (SELECT channel, idx, {'0.0' if 0 in zero else 'a'} AS a FROM a{levels})")
    for part, level in enumerate(range(levels, 0, -1), 1):
        detail = "0.0" if part in zero else "c.d"
        parts.append(f"""y{level - 1} AS (SELECT y.channel, t AS idx, sum(up * y.a + ov * {detail}) AS a FROM range({size[level - 1]}) r(t) CROSS JOIN w
          JOIN y{level} y ON 2 * y.idx = t + 6 - j JOIN a{level} c ON c.channel = y.channel AND c.idx = y.idx GROUP BY 1, 2)""")
    return f"WITH {', '.join(parts)} SELECT channel, idx, round(a, 6) AS v FROM y0"


for _kind, _drop in (("highpass", 1), ("lowpass", 2)):

    @query(f"wavelet_{_kind}", _sql(_drop, _kind))
    def _(spark, sf, kind=_kind, drop=_drop):
        n = S.table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("n")).first()["n"] or N
        return ch.to_long(dyadic.wavelet_filter(S.signal_chunks(spark, sf, CH), CH, drop, kind, n), CH).select("channel", "idx", R("v"))


# A spline is the solution of a tridiagonal system: a test solves the whole system of every channel.
@query("envelope_spline")
def _(spark, sf):
    return splines.envelope(S.signal(spark, sf), 32, 2, 2).select("channel", "kind", "idx", R("v"))
