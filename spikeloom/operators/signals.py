"""Dense signals: referencing, statistics, correlation, convolution.

Long form has one row per sample (recording_id, channel, idx, v); chunk form has fixed-size
arrays (recording_id, channel, chunk, samples).  No operator brings a whole channel into one
task: frames run inside stretches, and chunks see a bounded halo of their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.operators.blocks import block_tables
from spikeloom.operators.ordered import in_order, rolling
from spikeloom.operators.skew import attach, hot_keys, salted_join

REC = "recording_id"
CHAN = ["recording_id", "channel"]


def scaled(raw: DataFrame, channels: DataFrame) -> DataFrame:
    """Raw samples times the channel coefficient, minus the channel mean."""
    d = attach(raw, channels.select(*CHAN, "coeff", "mean"), CHAN, F.col("idx"))
    return d.withColumn("v", F.col("v") * F.col("coeff") - F.col("mean")).drop("coeff", "mean")


def channel_means(raw: DataFrame, channels: DataFrame) -> DataFrame:
    d = raw.groupBy(*CHAN).agg(F.avg("v").alias("m")).join(channels.select(*CHAN, "coeff"), CHAN)
    return d.select(*CHAN, (F.col("m") * F.col("coeff")).alias("mean"))


def mapped_channel(spikes: DataFrame, channel_map: DataFrame, probe: DataFrame) -> DataFrame:
    """Logical to physical channels: the map of the probe plus the probe's first channel."""
    return spikes.join(channel_map, ["probe", "channel"]).join(probe, "probe").withColumn(
        "physical", F.col("mapped") + F.col("lo")
    )


def virtual_reference(sig: DataFrame, kind: str, probe: Sequence[str] = ()) -> DataFrame:
    """Per-sample median (cmr) or mean (car) over the channels of a probe."""
    agg = F.median("v") if kind == "cmr" else F.avg("v")
    return sig.groupBy(REC, *probe, "idx").agg(agg.alias("ref"))


def referenced(sig: DataFrame, ref: DataFrame, probe: Sequence[str] = ()) -> DataFrame:
    d = sig.join(ref, [REC, *probe, "idx"])
    return d.withColumn("v", F.col("v") - F.col("ref")).drop("ref")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10000, hot: DataFrame | None = None
) -> DataFrame:
    """Median without sorting a group in one task.

    A mergeable sketch brackets the middle ranks to within 2/accuracy of the group; only rows
    inside the bracket, counted per value, are ranked.
    """
    eps = 2.0 / accuracy
    br = F.percentile_approx(value, [0.5 - eps, 0.5 + eps], accuracy)
    lim = df.groupBy(*keys).agg(br.alias("_b"), F.count(value).alias("_n")).select(
        *keys, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi")
    )
    j = attach(df, lim, list(keys), hot=hot)
    below = j.groupBy(*keys).agg(F.count_if(F.col(value) < F.col("_lo")).alias("_below"))
    mid = j.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_n", F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    cum = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    r = mid.withColumn("_cum", cum).join(below, list(keys)).withColumn("_cum", F.col("_cum") + F.col("_below"))
    at = lambda k: F.min(F.when(F.col("_cum") > k, F.col("_v")))
    return r.groupBy(*keys).agg(((at(F.expr("(_n - 1) div 2")) + at(F.expr("_n div 2"))) / 2).alias("median"))


def mad(sig: DataFrame) -> DataFrame:
    """Median absolute deviation scaled to a standard deviation."""
    hot = hot_keys(sig, CHAN)
    med = exact_median(sig, CHAN, "v", hot=hot)
    d = attach(sig, med, CHAN, F.col("idx"), hot).select(*CHAN, F.abs(F.col("v") - F.col("median")).alias("dev"))
    return exact_median(d, CHAN, "dev", hot=hot).select(*CHAN, (F.col("median") / F.lit(0.6744897501960817)).alias("mad"))


SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")
#: The sums that change places with the channels.
OTHER = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}


def channel_products(
    chunks: DataFrame, group: Sequence[str] = (), sums: Sequence[str] = ("n", "sx", "sy", "sxy"), span: int = 256, block: int = 2048
) -> DataFrame:
    """Sums of products of every channel pair (i <= j) of a group, over the samples that both channels have.

    Channels are dealt to blocks; a task multiplies the samples of two blocks over a stretch of ``span`` chunks, so
    no pair of chunks is a row.  Only channels longer than a stretch have sums left to add.
    """
    keys = [REC, *group]
    types = dict(chunks.select(*keys, "channel").dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"i {types['channel']}", f"j {types['channel']}"] + [f"{c} {'long' if c == 'n' else 'double'}" for c in sums])

    def side(rows: pa.Table, ids: np.ndarray, chunk: int, size: int) -> tuple[np.ndarray, ...]:
        """Samples, squares, whether a sample is there and whether the chunk is, a row per channel; equal channels are added."""
        rows = rows.filter(pc.equal(rows.column("chunk"), chunk))
        at = np.searchsorted(ids, rows.column("channel").to_numpy())
        lists = rows.column("samples").combine_chunks()
        values, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        there = values.is_valid().to_numpy(zero_copy_only=False)
        v = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
        out = [np.zeros((len(ids), size)) for _ in range(3)] + [np.zeros((len(ids), 1))]
        for full, x in zip(out, (v, v * v, there.astype(float))):
            np.add.at(full, (np.repeat(at, n), place), x)
        np.add.at(out[3], (at, 0), 1.0)
        return tuple(out)

    def task(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        ids = [np.unique(t.column("channel").to_numpy()) for t in (a, b)]
        total = {c: np.zeros((len(ids[0]), len(ids[1]))) for c in {*sums, *(OTHER.get(c, c) for c in sums), "n", "_both"}}
        size = max(1, *(pc.max(pc.list_value_length(t.column("samples"))).as_py() or 1 for t in (a, b)))
        chunks = np.intersect1d(*(t.column("chunk").to_numpy() for t in (a, b)))
        for chunk in chunks:
            x, xx, mx, px = side(a, ids[0], chunk, size)
            y, yy, my, py = (x, xx, mx, px) if same else side(b, ids[1], chunk, size)
            parts = {"n": (mx, my), "sx": (x, my), "sy": (mx, y), "sxy": (x, y), "sxx": (xx, my), "syy": (mx, yy), "_both": (px, py)}
            for c, whole in total.items():
                whole += parts[c][0] @ parts[c][1].T
        head = [a.column(k)[0] for k in keys]
        none = total["n"] == 0
        # A strip of rows of the matrices at a time; the smaller channel comes first.
        for first in range(0, len(ids[0]), max(1, (1 << 18) // len(ids[1]))):
            strip = slice(first, first + max(1, (1 << 18) // len(ids[1])))
            there = total["_both"][strip] > 0
            i, j = np.nonzero(there & (ids[0][strip, None] <= ids[1][None]) if same else there)
            swap = ids[0][strip][i] > ids[1][j]
            cols = [pa.repeat(h, len(i)) for h in head] + [pa.array(np.where(swap, ids[1][j], ids[0][strip][i])), pa.array(np.where(swap, ids[0][strip][i], ids[1][j]))]
            for c in sums:
                v = total[c][strip][i, j]
                v = np.where(swap, total[OTHER[c]][strip][i, j], v) if c in OTHER else v
                # Channels without a common sample have no sums.
                cols.append(pa.array(v.astype(np.int64)) if c == "n" else pa.array(v, mask=none[strip][i, j]))
            yield pa.RecordBatch.from_arrays(cols, [*keys, "i", "j", *sums])

    stretch = F.expr(f"chunk div {span}")
    rows = chunks.select(*keys, "channel", "chunk", F.col("samples").cast("array<double>").alias("samples"), stretch.alias("_stretch"))
    ends = rows.agg(F.min("_stretch"), F.max("_stretch")).first()
    made = block_tables(rows, [*keys, "_stretch"], "channel", task, schema, block)
    return made if ends[0] == ends[1] else made.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in sums])


def correlation_matrix(chunks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every channel pair; zero where a channel is constant."""
    p = channel_products(chunks, group, SUMS).where("i < j")
    return p.select(REC, *group, "i", "j", pearson_of(p).alias("r"))


def whitening(chunks: DataFrame, group: Sequence[str], n_channels: int, over: str = "samples") -> DataFrame:
    """Whitening matrix U diag(1/sqrt(s + 1e-8)) U' of the channel Gram matrix of each group.

    The Gram matrix is a distributed sum; only its at most n_channels**2 entries per group
    reach the eigen-decomposition.
    """
    p = channel_products(chunks, group)
    keys = [REC, *group]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf.i.to_numpy(), pdf.j.to_numpy()]))
        if len(ids) > n_channels:
            raise ValueError("more channels in a group than declared")
        a, b = np.searchsorted(ids, pdf.i), np.searchsorted(ids, pdf.j)
        g = np.zeros((len(ids), len(ids)))
        g[a, b] = g[b, a] = pdf.sxy.to_numpy() / (pdf.n.to_numpy() if over == "samples" else len(ids))
        s, u = np.linalg.eigh(g)
        w = (u / np.sqrt(np.maximum(s, 0) + 1e-8)) @ u.T
        ii, jj = np.meshgrid(ids, ids, indexing="ij")
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**head, "i": ii.ravel(), "j": jj.ravel(), "w": w.ravel()})

    types = dict(p.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"i {types['i']}", f"j {types['j']}", "w double"])
    return p.groupBy(*keys).applyInPandas(solve, schema)


def whiten(sig: DataFrame, matrix: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Apply a whitening matrix: new channel i is the weighted sum of channels j at each sample."""
    m = matrix.select(REC, *group, "i", F.col("j").alias("channel"), "w")
    return salted_join(sig, m, [REC, *group, "channel"], F.col("idx")).groupBy(REC, *group, F.col("i").alias("channel"), "idx").agg(
        F.sum(F.col("v") * F.col("w")).alias("v")
    )


def lagged_products(a: DataFrame, b: DataFrame, lags: int, keys: Sequence[str], value: str = "v", length: int = 1024) -> DataFrame:
    """Sums over samples of a[idx] * b[idx + lag] for |lag| <= lags, with the sums Pearson needs.

    Samples are gathered by stretches of ``length``; b's stretch sees ``lags`` samples beyond its borders.  All lags of
    a stretch are one correlation of two arrays, so rows grow with stretches, not with samples times lags.
    Samples that are missing or null on either side do not count.
    """
    seg = F.expr(f"(idx - pmod(idx, {length})) div {length}")
    sample = lambda n: F.collect_list(F.struct((F.col("idx") - F.col("_seg") * length).cast("int").alias("i"), F.col(value).cast("double").alias("v"))).alias(n)
    x = a.where(F.col(value).isNotNull()).withColumn("_seg", seg).groupBy(*keys, "_seg").agg(sample("_x"))
    near = F.sequence(F.floor((F.col("idx") - lags) / length), F.floor((F.col("idx") + lags) / length))
    y = b.where(F.col(value).isNotNull()).withColumn("_seg", F.explode(near)).groupBy(*keys, "_seg").agg(sample("_y"))
    names = ("n", "sxy", "sx", "sy", "sxx", "syy")

    @F.pandas_udf("array<struct<lag:int,n:bigint,sxy:double,sx:double,sy:double,sxx:double,syy:double>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for left, right in zip(xs, ys):
            u, mu, w, mw = np.zeros(length), np.zeros(length), np.zeros(length + 2 * lags), np.zeros(length + 2 * lags)
            for values, full, at in ((left, (u, mu), 0), (right, (w, mw), lags)):
                i = np.array([s["i"] for s in values]) + at
                full[0][i], full[1][i] = [s["v"] for s in values], 1.0
            sums = [np.correlate(q, p, "valid") for q, p in ((mw, mu), (w, u), (mw, u), (w, mu), (mw, u * u), (w * w, mu))]
            out.append([{"lag": k - lags, **dict(zip(names, (int(round(r[0])), *r[1:])))} for k, r in enumerate(zip(*sums))])
        return pd.Series(out)

    each = x.join(y, [*keys, "_seg"]).select(*keys, F.explode(run("_x", "_y")).alias("_z")).select(*keys, "_z.*").where("n > 0")
    return each.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in names])


def pearson_of(p: DataFrame) -> Column:
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))), F.lit(0.0))


def cross_correlation(a: DataFrame, b: DataFrame, lags: int, keys: Sequence[str], remove_mean: bool = False, norm: bool = True) -> DataFrame:
    """Cross-correlation at lags -lags..lags - 1, optionally of centred signals of unit norm."""
    if remove_mean:
        centre = lambda d: attach(d, d.groupBy(*keys).agg(F.avg("v").alias("_m")), list(keys), F.col("idx")).withColumn("v", F.col("v") - F.col("_m")).drop("_m")
        a, b = centre(a), centre(b)
    p = lagged_products(a, b, lags, keys).where(F.col("lag") < lags)
    if norm:
        size = lambda d, n: d.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(n))
        p = p.join(size(a, "_na"), list(keys)).join(size(b, "_nb"), list(keys))
        return p.select(*keys, "lag", F.try_divide("sxy", F.col("_na") * F.col("_nb")).alias("xcorr"))
    return p.select(*keys, "lag", F.col("sxy").alias("xcorr"))


def sliding_correlation(pairs: DataFrame, keys: Sequence[str], window: int, length: int) -> DataFrame:
    """Pearson correlation of x and y over rows idx .. idx + window - 1, for all full windows but the last."""
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.lit(1), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x, "syy": y * y}
    frames = {k: (lambda f, e=e: F.sum(e).over(f)) for k, e in sums.items()}
    d = rolling(pairs, keys, "idx", length, 0, window - 1, frames)
    stop = pairs.groupBy(*keys).agg(F.max("idx").alias("_last"))
    d = attach(d, stop, list(keys), F.col("idx"), hot_keys(pairs, list(keys))).where(F.col("idx") + window <= F.col("_last"))
    return d.select(*keys, "idx", pearson_of(d).alias("r"))


def moving(sig: DataFrame, name: str, fn, before: int, after: int, length: int) -> DataFrame:
    """A moving aggregate of v over idx - before .. idx + after, shorter at the edges."""
    return rolling(sig, CHAN, "idx", length, before, after, {name: lambda f: fn(F.col("v")).over(f)})


def median_filter(sig: DataFrame, order: int, length: int, n: int) -> DataFrame:
    """Running median of odd length; samples beyond the ends count as zero."""
    k = order // 2
    d = rolling(sig, CHAN, "idx", length, k, k, {"_w": lambda f: F.collect_list("v").over(f)})
    padded = F.concat(F.col("_w"), F.array_repeat(F.lit(0.0), F.lit(order) - F.size("_w")))
    return d.withColumn("filtered", F.get(F.array_sort(padded), F.lit(k))).drop("_w")


def convolve(sig: DataFrame, weights: Sequence[float], shift: int, value: Column | None = None, lo: int = 0, hi: int | None = None) -> DataFrame:
    """out[i] = sum_m w[m] v[i + shift - m]; short kernels only, as every sample meets every weight."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    v = F.col("v") if value is None else value
    d = sig.select(*CHAN, "idx", v.alias("v"), F.posexplode(w).alias("m", "w")).select(
        *CHAN, (F.col("idx") + F.col("m") - shift).alias("idx"), (F.col("v") * F.col("w")).alias("p")
    )
    d = d.where(F.col("idx") >= lo)
    if hi is not None:
        d = d.where(F.col("idx") < hi)
    return d.groupBy(*CHAN, "idx").agg(F.sum("p").alias("v"))


def extrema(sig: DataFrame, length: int) -> DataFrame:
    """Local minima and maxima: the sign of the step changes at the sample."""
    d = in_order(sig, CHAN, "idx", length, lag={"_p": "v"}, lead={"_n": "v"})
    s1, s2 = F.signum(F.col("v") - F.col("_p")), F.signum(F.col("_n") - F.col("v"))
    return d.withColumn("kind", F.when(s2 > s1, "min").when(s2 < s1, "max")).where("kind is not null").drop("_p", "_n")


def chunked_extrema(ext: DataFrame, dmin: int, dmax: int, length: int) -> DataFrame:
    """Smallest of every dmin minima and largest of every dmax maxima, in order (envelopes)."""
    d = in_order(ext, [*CHAN, "kind"], "idx", length, index="k")
    g = F.when(F.col("kind") == "min", F.expr(f"k div {dmin}")).otherwise(F.expr(f"k div {dmax}"))
    key = F.struct(F.when(F.col("kind") == "min", F.col("v")).otherwise(-F.col("v")), F.col("idx"))
    return d.groupBy(*CHAN, "kind", g.alias("g")).agg(F.min_by("idx", key).alias("idx"), F.min_by("v", key).alias("v"))


def local_minimum(sig: DataFrame, order: int, length: int) -> DataFrame:
    """Samples strictly below all samples within ``order`` positions on both sides."""
    d = rolling(
        sig, CHAN, "idx", length, order, order,
        {"_lo": lambda f: F.min("v").over(f), "_c": lambda f: F.collect_list("v").over(f), "_k": lambda f: F.count(F.lit(1)).over(f)},
    )
    ties = F.size(F.filter("_c", lambda x: x == F.col("v")))
    return d.where((F.col("v") == F.col("_lo")) & (ties == 1) & (F.col("_k") == 2 * order + 1)).drop("_lo", "_c", "_k")


def equal_bins(x: str, lo: str, hi: str, bins: int) -> Column:
    """Equal-width bin number with a closed last bin."""
    w = (F.col(hi) - F.col(lo)) / bins
    return F.when(w > 0, F.least(F.floor((F.col(x) - F.col(lo)) / w), F.lit(bins - 1))).otherwise(0).cast("int")


def mutual_information(pairs: DataFrame, keys: Sequence[str], bins: int = 20) -> DataFrame:
    """Mutual information in bits of binned x and y."""
    lim = pairs.groupBy(*keys).agg(
        F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"), F.count(F.lit(1)).alias("n")
    )
    joint = (
        attach(pairs, lim, list(keys))
        .groupBy(*keys, "n", equal_bins("x", "lx", "hx", bins).alias("bx"), equal_bins("y", "ly", "hy", bins).alias("by"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    mx = F.sum("c").over(Window.partitionBy(*keys, "bx"))
    my = F.sum("c").over(Window.partitionBy(*keys, "by"))
    n = F.col("n").cast("double")
    term = F.col("c") / n * F.log2(F.col("c") * n / (F.col("mx") * F.col("my")))
    return joint.select("*", mx.alias("mx"), my.alias("my")).groupBy(*keys).agg(F.sum(term).alias("mi"))


def bin_by(df: DataFrame, keys: Sequence[str], phase: Column, amp: Column, steps: int, lo: float, hi: float, agg=F.avg) -> DataFrame:
    """Aggregate of amp in half-open equal-width phase bins; empty bins give zero."""
    width = (hi - lo) / steps
    b = F.floor((phase - F.lit(lo)) / F.lit(width)).cast("int")
    d = df.select(*keys, b.alias("bin"), amp.alias("_a")).where(F.col("bin").between(0, steps - 1))
    vals = d.groupBy(*keys, "bin").agg(agg("_a").alias("value"))
    spine = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return spine.join(vals, [*keys, "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def unwrap_step(now: Column, before: Column) -> Column:
    """Multiple of 2 pi that removes the jump between neighbouring phases."""
    two_pi = 6.283185307179586
    d = now - before
    return -F.floor((d + two_pi / 2) / two_pi) * two_pi


def instantaneous_frequency(phase: DataFrame, fs: float, length: int) -> DataFrame:
    """Gradient of the unwrapped phase in cycles per second.

    Unwrapped neighbour differences suffice, so no running sum is needed.
    """
    d = in_order(phase, CHAN, "idx", length, lag={"_p": "v"}, lead={"_n": "v"})
    back = F.col("v") - F.col("_p") + unwrap_step(F.col("v"), F.col("_p"))
    ahead = F.col("_n") - F.col("v") + unwrap_step(F.col("_n"), F.col("v"))
    grad = F.coalesce((back + ahead) / 2, back, ahead)
    return d.select(*CHAN, "idx", (F.lit(fs / 6.283185307179586) * grad).alias("freq"))


def autocovariance(sig: DataFrame, lags: int, keys: Sequence[str], debias: bool = True, normalize: bool = True) -> DataFrame:
    """Autocovariance at lags 0..lags of the (optionally centred) signal, over n if normalised."""
    d = sig
    if debias:
        d = attach(d, d.groupBy(*keys).agg(F.avg("v").alias("_m")), list(keys), F.col("idx")).withColumn("v", F.col("v") - F.col("_m")).drop("_m")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    p = lagged_products(d, d, lags, keys).where("lag >= 0").join(n, list(keys))
    return p.select(*keys, "lag", (F.col("sxy") / (F.col("_n") if normalize else F.lit(1))).alias("cov"))

