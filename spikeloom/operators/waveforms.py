"""Templates and spike waveforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from spikeloom.operators.lfp import cut
from spikeloom.operators.skew import attach


#: Spikes of one task that cuts windows out of a signal it leaves as it is.
PART = 4096


def best_channel(templates: DataFrame, keys: Sequence[str], center: int | None = None) -> DataFrame:
    """Channel of largest summed magnitude, or of lowest value around the centre; its trough too."""
    w = F.col("waveform")
    low = F.array_min(w)
    if center is None:
        score = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.abs(x))
    else:
        score = -F.array_min(F.slice(w, center - 1, 4))
    d = templates.select(*keys, "channel", score.alias("_s"), low.alias("_low"))
    rank = F.struct(F.col("_s"), -F.col("channel"))
    return d.groupBy(*keys).agg(F.max_by("channel", rank).alias("channel"), F.max_by("_low", rank).alias("peak"))


def channel_window(best: str | Column, nchans: int, total: int) -> tuple[Column, Column]:
    """First and last (exclusive) channel of +-nchans around the best, moved inside [0, total)."""
    b = F.col(best) if isinstance(best, str) else best
    start, end = b - nchans, b + nchans
    end = F.when(start < 0, end - start).otherwise(end)
    start = F.greatest(start, F.lit(0))
    over = F.greatest(end - total, F.lit(0))
    return start - over, end - over


def rescale(waveform: str | Column, multiplier: float = 1e6) -> Column:
    """Each row to [-1, 1] by its own extremes."""
    w = F.transform(waveform, lambda x: x * multiplier)
    lo, hi = F.array_min(w), F.array_max(w)
    return F.transform(w, lambda x: 2 * F.try_divide(x - lo, hi - lo) - 1)


def trough(waveform: str | Column) -> Column:
    w = F.col(waveform) if isinstance(waveform, str) else waveform
    return (F.array_position(w, F.array_min(w)) - 1).cast("int")


def centred(templates: DataFrame, center: int, waveform: str = "waveform") -> DataFrame:
    """Shift rows so that troughs align on ``center`` and crop all rows to their common length."""
    d = templates.withColumn("_t", trough(waveform))
    lim = d.agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.first(F.size(waveform)).alias("_n"))
    span = lim.select("_hi", (F.col("_n") - (F.col("_hi") - F.col("_lo"))).alias("_len"))
    hi, length = span.select("_hi").scalar(), span.select("_len").scalar()
    start = F.greatest(hi - center + F.col("_t") - center, F.lit(0))
    return d.withColumn(waveform, F.slice(waveform, (start + 1).cast("int"), length.cast("int"))).drop("_t")


def parts(waveform: str | Column) -> Column:
    """Start, trough and end: walk from the trough as long as the signal rises."""
    w = F.col(waveform) if isinstance(waveform, str) else waveform
    n, p = F.size(w), trough(w)
    rises = F.filter(F.sequence(F.lit(1), n - 1), lambda i: (i <= p) & (F.get(w, i - 1) <= F.get(w, i)))
    start = F.when(p > 0, F.greatest(F.coalesce(F.array_max(rises), F.lit(1)), F.lit(1))).otherwise(1)
    falls = F.filter(F.sequence(F.lit(0), n - 2), lambda i: (i >= p) & (F.get(w, i + 1) <= F.get(w, i)))
    end = F.when(p < n - 1, F.least(F.coalesce(F.array_min(falls), n - 2), n - 2)).otherwise(n - 2)
    return F.struct(start.alias("start"), p.alias("trough"), end.alias("end"))


def exponents(waveforms: DataFrame, waveform: str = "waveform") -> DataFrame:
    """Floor of the smallest and largest log10 magnitude of non-zero samples."""
    mag = F.transform(F.filter(waveform, lambda x: x != 0), lambda x: F.abs(x))
    d = waveforms.select(F.array_min(mag).alias("lo"), F.array_max(mag).alias("hi"))
    return d.agg(F.floor(F.log10(F.min("lo"))).alias("min_exponent"), F.floor(F.log10(F.max("hi"))).alias("max_exponent"))


def mean_waveforms(waveforms: DataFrame, keys: Sequence[str], waveform: str = "waveform") -> DataFrame:
    """Mean and population deviation of the waveforms of each key, sample by sample."""
    long = waveforms.select(*keys, F.posexplode(waveform).alias("pos", "v"))
    s = long.groupBy(*keys, "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    return s.groupBy(*keys).agg(ordered("m").alias("waveform"), F.avg("sd").alias("stdev"))


def extract(spikes: DataFrame, chunks: DataFrame, size: int, reach: int) -> DataFrame:
    """Samples t - reach .. t + reach of the channel of each spike.

    At the start of a channel the cut begins at sample zero; missing samples at the end are zero.
    """
    width = 2 * reach + 1
    c = cut(spikes, chunks, size, F.col("t") - reach, F.col("t") + reach + 1, "waveform", ["spike_id", "cluster_id", "t"])
    pad = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("waveform"))
    return c.withColumn("waveform", F.concat("waveform", pad)).drop("waveform_lo")


def recentred(spikes: DataFrame, chunks: DataFrame, size: int, reach: int, n: int) -> DataFrame:
    """Spike times moved to the trough within ten samples of the steepest descent."""
    c = cut(spikes, chunks, size, F.col("t") - reach, F.col("t") + reach + 1, "w", ["spike_id", "cluster_id", "t"])
    step = F.zip_with(F.slice("w", F.lit(2), F.size("w") - 1), F.slice("w", F.lit(1), F.size("w") - 1), lambda b, a: b - a)
    c = c.withColumn("_v", (F.array_position(step, F.array_min(step)) - 1).cast("int"))
    near = F.slice("w", F.col("_v") + 1, F.lit(10))
    moved = F.col("w_lo") + F.col("_v") + F.array_position(near, F.array_min(near)) - 1
    inside = F.col("t") + reach + 1 < n
    return c.select(*[x for x in c.columns if x not in ("w", "w_lo", "_v")], F.when(inside, moved).otherwise(F.col("t")).alias("centred_t"))


def duplicates(centred_spikes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether spikes of a unit fall together after centring, and how many distinct times remain."""
    d = centred_spikes.groupBy(*keys, "centred_t").agg(F.count(F.lit(1)).alias("_c"))
    return d.groupBy(*keys).agg((F.sum("_c") > F.count(F.lit(1))).alias("has_duplicates"), F.count(F.lit(1)).alias("n_distinct"))


def reconstruct(spikes: DataFrame, templates: DataFrame, n: int) -> DataFrame:
    """Signal of a unit rebuilt by pasting its template at every spike, first template sample at zero."""
    t = templates.withColumn("_peak", trough("waveform")).withColumn("_zero", F.get("waveform", F.lit(0)))
    d = attach(spikes, t, ["cluster_id"], F.col("t")).select(
        "cluster_id", "t", "_peak", "_zero", F.posexplode("waveform").alias("pos", "v")
    ).withColumn("idx", F.col("t") - F.col("_peak") + F.col("pos")).where(F.col("idx").between(0, n - 1))
    return d.groupBy("cluster_id", "idx").agg(F.max_by(F.col("v") - F.col("_zero"), "t").alias("v"))


def spline_matrix(n: int, factor: int):
    """Linear map from n samples to n * factor values of their not-a-knot cubic spline."""
    x = np.linspace(0, n, n)
    h = x[1] - x[0]
    a, r = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = (1, 4, 1)
        r[i, i - 1 : i + 2] = np.array([1, -2, 1]) * 6 / h**2
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    m = np.linalg.solve(a, r)
    q = np.linspace(0, n, n * factor)
    j = np.minimum((q / h).astype(int), n - 2)
    t = q - x[j]
    e = np.eye(n)
    slope = (e[j + 1] - e[j]) / h - h / 6 * (2 * m[j] + m[j + 1])
    return e[j] + t[:, None] * slope + t[:, None] ** 2 / 2 * m[j] + t[:, None] ** 3 / (6 * h) * (m[j + 1] - m[j])


FIELDS = [
    "hwL", "hwL_len", "hwR", "hwR_len", "full_width", "start", "end", "center", "center_y", "start_y", "end_y", "center_diff",
    "min_x", "min_y", "rslope", "hslope",
]


def level_crossings(y: np.ndarray, level: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``y``: distance between its outermost crossings of a level, and whether any sample of ``inside`` is below it.

    A crossing lies between a sample and the one before it, by linear interpolation; a row's first
    sample has its last one before it.
    """
    before = np.roll(y, 1, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.abs(before - level[:, None]) / np.abs(y - before)
    place = np.arange(y.shape[1]) - 1 + np.where(share < 1, share, 0.0)
    below = inside & (y < level[:, None])
    row, end = np.arange(len(y)), y.shape[1] - 1
    beyond = np.minimum(end - below[:, ::-1].argmax(axis=1) + 1, end)
    return place[row, beyond] - place[row, below.argmax(axis=1)], below.any(axis=1)


def slopes(y: np.ndarray, start: np.ndarray, span: int) -> np.ndarray:
    """Least-squares slope of the ``span`` samples from ``start`` on, per row; NaN for fewer than two."""
    at = np.arange(y.shape[1])
    size = np.minimum(span, y.shape[1] - start)[:, None]
    t = np.where((at >= start[:, None]) & (at < start[:, None] + size), at - start[:, None] - (size - 1) / 2, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size[:, 0] > 1, (t * y).sum(axis=1) / (t * t).sum(axis=1), np.nan)


def template_shapes(w: np.ndarray, center: int, factor: int, upsample: np.ndarray, polarisation: int = 20) -> dict[str, np.ndarray]:
    """Widths, extremes and slopes of templates of one length (a row each) on their upsampled splines; NaN is undefined.

    Fixed values: the waveform starts at its last local maximum more than five factors ahead of the
    centre and ends at its maximum more than five factors behind it, else at the ends of the spline;
    half widths need more than five factors between the two.
    """
    y = w @ upsample.T
    row, at, c, far = np.arange(len(y)), np.arange(y.shape[1]), center * factor, 5 * factor
    top = np.zeros(w.shape, bool)
    top[:, 1:-1] = (w[:, 1:-1] > w[:, :-2]) & (w[:, 1:-1] > w[:, 2:])
    left = np.max(np.where(top, np.arange(w.shape[1]), 0)[:, : c - far], axis=1, initial=0)
    right = y[:, c:].argmax(axis=1) + c
    right = np.where(right > c + far, right, y.shape[1] - 1)
    low = y.argmin(axis=1)
    out = {
        "full_width": (right - left) / factor, "start": left / factor, "end": right / factor, "center": np.full(len(y), c / factor),
        "center_y": y[:, c], "start_y": y[row, left], "end_y": y[row, right], "center_diff": np.diff(y, axis=1).argmin(axis=1) - low,
        "min_x": low / factor, "min_y": y[row, low], "rslope": slopes(y, low, polarisation * factor),
        "hslope": slopes(y, right, polarisation * factor),
    }
    inside = (at >= left[:, None]) & (at < right[:, None]) & (out["full_width"] > far)[:, None]
    for name, bound in (("hwL", "start_y"), ("hwR", "end_y")):
        level = (y[:, c] + out[bound]) / 2
        width, found = level_crossings(y, level, inside)
        out[name], out[f"{name}_len"] = np.where(found, level, np.nan), np.where(found, width / factor, np.nan)
    return out


def template_properties(templates: DataFrame, keys: Sequence[str], center: int, factor: int = 2) -> DataFrame:
    out = StructType([StructField(c, DoubleType()) for c in FIELDS])

    @F.pandas_udf(out)
    def run(w: pd.Series) -> pd.DataFrame:
        parts = []
        for n, same in w.groupby(w.map(len)):
            shapes = template_shapes(np.stack(same.to_numpy()).astype(float), center, factor, spline_matrix(n, factor))
            parts.append(pd.DataFrame(shapes, index=same.index).astype(float))
        made = pd.concat(parts).reindex(w.index)[FIELDS]
        return made.astype(object).where(made.notna(), None)

    return templates.select(*keys, run("waveform").alias("_p")).select(*keys, "_p.*")


def extract_channels(spikes: DataFrame, chunks: DataFrame, templates: DataFrame, size: int, length: int, center: int, nchans: int,
                     total: int, subtract: bool = True) -> DataFrame:
    """Windows of the channels around each spike's best channel, larger troughs first.

    With ``subtract`` the scaled template of every taken spike is removed before the next one is
    cut, which makes the order matter; it does so inside one chunk of time and its halo of one
    window, the unit of work of a task.  A spike whose window leaves the signal has windows of zeros
    and subtracts nothing.  ``spikes`` carry recording_id, spike_id, template_id, t.
    """
    from spikeloom.operators.chunks import halo

    first, last = channel_window("best", nchans, total)
    best = best_channel(templates, ["template_id"]).withColumnRenamed("channel", "best")
    shape = templates.join(best, "template_id").where((F.col("channel") >= first) & (F.col("channel") < last))
    shape = shape.groupBy("template_id").agg(
        F.first("best").alias("best"), F.first("peak").alias("peak"),
        F.array_sort(F.collect_list(F.struct("channel", "waveform"))).alias("shape"),
    )
    mine = spikes.select("recording_id", "spike_id", "template_id", "t", F.expr(f"t div {size}").alias("chunk"))
    mine = attach(mine, shape, ["template_id"], F.col("spike_id"))
    # Spikes that leave the signal as it is go to parts of a chunk, a task each, that read the same samples.
    where = mine.groupBy("recording_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    parts = F.lit(1) if subtract else where.agg(F.greatest(F.ceil(F.max("n") / PART), F.lit(1)).cast("int")).scalar()
    mine = mine.select("recording_id", "chunk", "spike_id", "t", "peak", "best", "shape", F.pmod(F.xxhash64("spike_id"), parts).cast("int").alias("_part"))
    block = halo(chunks, size, length, length).select("recording_id", "chunk", "channel", "lead", "samples").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    out = "recording_id string, spike_id long, channel long, waveform array<double>"

    # A template is divided by its peak over the sample at the spike, each with 1e-10 added.
    def windows(signal, lead, line_of, spikes, begin):
        for q in spikes:
            lines = [line_of[x["channel"]] for x in q["shape"]]
            at = q["t"] - begin + lead
            span = slice(at - center, at - center + length)
            whole = span.start >= 0 and span.stop <= signal.shape[1] and not np.isnan(signal[lines, span]).any()
            seen = signal[lines, span].copy() if whole else np.zeros((len(lines), length))
            for x, waveform in zip(q["shape"], seen):
                yield {"spike_id": q["spike_id"], "channel": x["channel"], "waveform": waveform}
            if subtract and whole:
                gain = q["peak"] / (signal[line_of[q["best"]], at] + 1e-10) + 1e-10
                signal[lines, span] -= np.array([x["waveform"] for x in q["shape"]], float) / gain

    def laid(rows):
        """The samples of a chunk, a line per channel, the most that a line holds before it, and the line of each channel."""
        lead = max(x["lead"] for x in rows)
        signal = np.full((len(rows), max(lead - x["lead"] + len(x["samples"]) for x in rows)), np.nan)
        for line, x in zip(signal, rows):
            line[lead - x["lead"] : lead - x["lead"] + len(x["samples"])] = np.array(x["samples"], float)
        return signal, lead, {x["channel"]: i for i, x in enumerate(rows)}

    kinds = pa.schema([("recording_id", pa.string()), ("spike_id", pa.int64()), ("channel", pa.int64()), ("waveform", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, chunk = None, [], None
        for batch in batches:
            made = []
            for (*at, spike), some in groupby(batch.to_pylist(), lambda x: (x["recording_id"], x["chunk"], x["_part"], x["_spike"])):
                if at != key:
                    key, rows, chunk = at, [], None
                if not spike:
                    rows += some
                elif rows:
                    chunk = chunk or laid(rows)
                    made += [{"recording_id": key[0], **x} for x in windows(*chunk, some, key[1] * size)]
            if made:
                yield pa.RecordBatch.from_pylist(made, kinds)

    # The samples of a chunk, then its spikes in their order, stream through a task: it holds one chunk's samples and one batch.
    on = ["recording_id", "chunk", "_part"]
    mine = mine.withColumns({"peak": F.coalesce("peak", F.lit(float("nan"))), "_spike": F.lit(True)})
    rows = block.withColumn("_spike", F.lit(False)).unionByName(mine, allowMissingColumns=True).repartition(*on)
    return rows.sortWithinPartitions(*on, "_spike", "peak", F.asc_nulls_last("spike_id"), "t").mapInArrow(run, out)
