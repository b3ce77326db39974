"""Cubic splines over irregular knots of a channel, solved block by block.

The slopes of a spline come from a tridiagonal system in which every knot outweighs its neighbours at least
two to one, so what happens HALO knots away changes a slope by less than 2**-HALO of itself.  A block
of knots with a halo on either side is therefore solved alone, to rounding as the whole system.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spikeloom.operators import signals as sg
from spikeloom.operators.ordered import in_order
from spikeloom.operators.skew import attach

CHAN = ["recording_id", "channel"]
KNOTS, HALO, BATCH = 128, 56, 1 << 16


def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the spline through the knots whose third derivative does not jump at the second and last but one."""
    n = len(x)
    if n == 1:
        return np.zeros(1)
    h = np.diff(x)
    rise = np.diff(y) / h
    if n == 2:
        return np.full(2, rise[0])
    if n == 3:  # a parabola
        bend = (rise[1] - rise[0]) / (x[2] - x[0])
        return np.array([rise[0] - bend * h[0], rise[0] + bend * h[0], rise[1] + bend * h[1]])
    a, b = np.zeros((n, n)), np.zeros(n)
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    b[1:-1] = 3 * (h[1:] * rise[:-1] + h[:-1] * rise[1:])
    for row, near, h0, h1, r0, r1 in ((0, 1, h[0], h[1], rise[0], rise[1]), (n - 1, n - 2, h[-1], h[-2], rise[-1], rise[-2])):
        a[row, row], a[row, near] = h1, h0 + h1
        b[row] = ((h0 + 2 * (h0 + h1)) * h1 * r0 + h0 * h0 * r1) / (h0 + h1)
    return np.linalg.solve(a, b)


def between(x: np.ndarray, y: np.ndarray, s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of the spline at places within its knots."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (at - x[i]) / h
    u = 1 - t
    return y[i] * u * u * (1 + 2 * t) + y[i + 1] * t * t * (3 - 2 * t) + h * t * u * (s[i] * u - s[i + 1] * t)


def spline_samples(knots: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """(keys, idx, v): the spline through ``knots(keys, idx, v)`` at every whole number from the first knot to the last.

    Knots of a key differ in idx.  They are numbered in stretches of ``length``; a block of KNOTS and its halo is
    what a task holds, and a wide gap between two knots comes out in batches.  One knot: its value; two: a line;
    three: a parabola.
    """
    d = in_order(knots.select(*keys, "idx", F.col("v").cast("double").alias("v")), list(keys), "idx", length, index="k", total="n")
    first, last = F.expr(f"greatest(k - {HALO} - 1, 0) div {KNOTS}"), F.expr(f"(k + {HALO}) div {KNOTS}")
    d = d.withColumn("block", F.explode(F.sequence(first, last)))
    g = d.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("k", "idx", "v"))).alias("_p"), F.first("n").alias("n"))
    g = g.where(F.col("block") * KNOTS < F.col("n"))
    kind = dict(g.dtypes)
    schema = ", ".join([*[f"{k} {kind[k]}" for k in keys], "idx bigint", "v double"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = zip(*[b.column(k).to_pylist() for k in keys])
            for head, block, n, p in zip(heads, b.column("block").to_pylist(), b.column("n").to_pylist(), b.column("_p")):
                k, x, y = (p.values.field(i).to_numpy() for i in range(3))
                s = slopes(x.astype(float), y)
                # Samples from the block's first knot up to the next block's, or to the channel's last knot.
                own = np.flatnonzero((k >= block * KNOTS) & (k <= (block + 1) * KNOTS))
                ended = k[own[-1]] == n - 1 and k[own[-1]] < (block + 1) * KNOTS
                start, stop = int(x[own[0]]), int(x[own[-1]]) + ended
                near = np.arange(max(0, own[0] - 1), own[-1] + 1)
                for a in range(start, stop, BATCH):
                    at = np.arange(a, min(a + BATCH, stop))
                    made = between(x[near].astype(float), y[near], s[near], at.astype(float))
                    yield pa.RecordBatch.from_arrays([*[pa.array([h] * len(at), f.type) for h, f in zip(head, arrow)], pa.array(at), pa.array(made)], schema=arrow)

    return g.mapInArrow(task, schema)


def envelope(sig: DataFrame, length: int, dmin: int = 1, dmax: int = 1, split: bool = False) -> DataFrame:
    """(recording_id, channel, kind, idx, v): lower (min) and upper (max) envelope of every channel at every sample.

    Knots are the smallest of every ``dmin`` local minima and the largest of every ``dmax`` local maxima, with the channel's
    first and last sample; ``split`` keeps minima below and maxima above the mean of the channel only.
    """
    d = sig.select(*CHAN, "idx", "v")
    ext = sg.extrema(d, length)
    if split:
        mean = d.groupBy(*CHAN).agg(F.avg("v").alias("_m"))
        ext = attach(ext, mean, CHAN, F.col("idx")).where(F.when(F.col("kind") == "min", F.col("v") < F.col("_m")).otherwise(F.col("v") > F.col("_m"))).drop("_m")
    ext = sg.chunked_extrema(ext.select(*CHAN, "idx", "v", "kind"), dmin, dmax, length).select(*CHAN, "kind", "idx", "v")
    ends = d.groupBy(*CHAN).agg(F.min(F.struct("idx", "v")).alias("a"), F.max(F.struct("idx", "v")).alias("z"))
    ends = ends.select(*CHAN, F.explode(F.array_distinct(F.array("a", "z"))).alias("_e")).withColumn("kind", F.explode(F.array(F.lit("min"), F.lit("max"))))
    return spline_samples(ext.union(ends.select(*CHAN, "kind", F.col("_e.idx").alias("idx"), F.col("_e.v").alias("v"))), [*CHAN, "kind"], length)
