"""Pairwise unit operators: tiling coefficient, correlograms, coincidence counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.operators.blocks import Block, block_pairs, counted, equal_times, matched, near, of_pairs, strips, unordered
from spikeloom.operators.ordered import in_order, run_number
from spikeloom.operators.skew import salted_join
from spikeloom.operators.spikes import UNIT

TIE = ["spike_id"]
#: Spikes of a block of units whose stretches are tasks.
LAG_SPIKES = 1 << 20


def match_zones(trains: DataFrame, keys: Sequence[str], dt: int, length: int) -> DataFrame:
    """Intervals of positions that meet a spike of the train within dt.

    Spike b answers for the positions whose first spike at or after ``position - dt`` is b:
    from one past the reach of the spike before it, or b - dt, up to b + dt.  Zones of one
    train are disjoint, so a position joins at most one of them.  Positions before ``mid``
    precede their spike.  Zones that touch with no position before their spike are fused per
    stretch, which bounds the zones of a dense train by the stretch, not by its spikes.
    """
    width = 2 * dt + 1
    breaks = F.col("_p").isNull() | (F.col("t") - F.col("_p") > dt + 1)
    p = in_order(
        trains.select(*keys, "spike_id", "t"), keys, "t", length, tie=TIE,
        lag={"_p": "t"}, running={"_chain": run_number(breaks)},
    )
    lo = F.greatest(F.coalesce(F.col("_p") + dt + 1, F.col("t") - dt), F.col("t") - dt)
    p = p.withColumn("lo", lo).where(F.col("lo") <= F.col("t") + dt)
    zones = p.groupBy(*keys, "_chain", F.expr(f"floor(t / {width})").alias("_cell")).agg(
        F.min("lo").alias("lo"), F.min(F.greatest("t", "lo")).alias("mid"), (F.max("t") + dt).alias("hi")
    )
    cells = F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))
    return zones.drop("_chain", "_cell").withColumn("cell", F.explode(cells))


def directed_matches(
    a: DataFrame, b: DataFrame, on: Sequence[str], a_ids: Sequence[str], b_ids: Sequence[str], dt: int, length: int,
    keep: Column | None = None,
) -> DataFrame:
    """Spikes of each a-train that have a b-spike within dt (``n``), and those before it (``k``)."""
    zones = match_zones(b, [*on, *b_ids], dt, length)
    left = a.select(*on, *a_ids, "spike_id", "t").withColumn("cell", F.floor(F.col("t") / (2 * dt + 1)))
    j = salted_join(left, zones, [*on, "cell"], F.col("spike_id"))
    hit = F.col("t").between(F.col("lo"), F.col("hi"))
    j = j.where(hit if keep is None else hit & keep)
    return j.groupBy(*on, *a_ids, *b_ids).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") < F.col("mid")).alias("k")
    )


def tiled_time(trains: DataFrame, keys: Sequence[str], dt: int, start: Column | int, stop: Column | int, length: int) -> DataFrame:
    """Time within dt of any spike of a train, cut at the recording edges.

    A train of one spike is cut at one edge only, the start first.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    d = in_order(trains, list(keys), "t", length, tie=TIE, lag={"_p": "t"})
    overlap = F.coalesce(F.sum(F.least(F.col("t") - F.col("_p") - 2 * dt, F.lit(0))), F.lit(0))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_spikes"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        overlap.alias("_overlap"), F.max(lit(start)).alias("_start"), F.max(lit(stop)).alias("_stop"),
    )
    head = F.least(F.col("first_t") - F.col("_start") - dt, F.lit(0))
    tail = F.least(F.col("_stop") - F.col("last_t") - dt, F.lit(0))
    edges = F.when((F.col("n_spikes") == 1) & (head < 0), head).otherwise(head + tail)
    return g.select(
        *keys, "n_spikes",
        ((2 * dt * F.col("n_spikes") + F.col("_overlap") + edges) / (F.col("_stop") - F.col("_start"))).alias("tiled"),
    )


def coefficient(pa: Column, ta: Column, pb: Column, tb: Column, guarded: bool = True) -> Column:
    """Tiling coefficient from matched shares and tiled shares."""
    half_a = F.try_divide(pa - tb, 1 - pa * tb) * 0.5
    half_b = F.try_divide(pb - ta, 1 - pb * ta) * 0.5
    if not guarded:
        return half_a + half_b
    one_a, one_b = pa * tb == 1, pb * ta == 1
    return (
        F.when(one_a & one_b, 1.0).when(one_a, 0.5 + half_b).when(one_b, 0.5 + half_a).otherwise(half_a + half_b)
    )


def coefficient_values(pa: np.ndarray, ta: np.ndarray, pb: np.ndarray, tb: np.ndarray, guarded: bool) -> np.ndarray:
    """``coefficient`` of arrays; NaN is undefined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        half = lambda p, t: np.where(1 - p * t == 0, np.nan, (p - t) / (1 - p * t)) * 0.5
        half_a, half_b, one_a, one_b = half(pa, tb), half(pb, ta), pa * tb == 1, pb * ta == 1
    value = half_a + half_b
    if guarded:
        value = np.where(one_a, np.where(one_b, 1.0, 0.5 + half_b), np.where(one_b, 0.5 + half_a, value))
    return value


def sttc_windows(
    spikes: DataFrame, dts: Sequence[int], start: int, stop: int, length: int, variant: str = "guarded", units: DataFrame | None = None,
    counts: Sequence[str] | None = None,
) -> DataFrame:
    """``sttc`` for several dt at once: one row per pair, columns of the d-th dt end in ``_d``.

    ``counts`` names the columns wanted beside the units and the coefficients, all if not given: a task's rows are costly to hand over.
    """
    t = None
    for d, dt in enumerate(dts):
        one = tiled_time(spikes, UNIT, dt, start, stop, length).withColumnRenamed("tiled", f"tiled_{d}")
        t = one if t is None else t.join(one.drop("n_spikes"), UNIT)
    if units is not None:
        t = units.select(*UNIT).distinct().join(t, UNIT, "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))
    names = ["n1_dt_2", "n1_before_2", "n2_dt_1", "n2_before_1"]
    wanted = lambda c: counts is None or c in counts
    schema = "recording_id string, cluster1_id long, cluster2_id long"
    schema += "".join(f", {c} long" for c in ("cluster1_size", "cluster2_size") if wanted(c))
    for d in range(len(dts)):
        schema += f", sttc_{d} double" + "".join(f", {c}_{d} long" for c in names if wanted(f"{c}_{d}"))
    split = [any(wanted(f"{c}_{d}") for c in ("n1_before_2", "n2_before_1")) for d in range(len(dts))]

    def task(a: Block, b: Block, same: bool) -> Iterator[dict]:
        i, j, swap = unordered(a, b, same)
        pick = lambda x, y: (np.where(swap, y, x), np.where(swap, x, y))
        both = lambda c: pick(a.column(c)[i], b.column(c)[j])
        size1, size2 = both("n_spikes")
        silent = (size1 == 0) | (size2 == 0)
        out = dict(zip(["cluster1_id", "cluster2_id"], pick(a.ids[i], b.ids[j]))) | {"cluster1_size": size1, "cluster2_size": size2}
        for d, dt in enumerate(dts):
            n_ab, k_ab = matched(a, b, dt, split[d])
            n_ba, k_ba = (n_ab, k_ab) if same else matched(b, a, dt, split[d])
            n1, n2 = out[f"n1_dt_2_{d}"], out[f"n2_dt_1_{d}"] = pick(of_pairs(n_ab, i, j, same), of_pairs(n_ba.T, i, j, same))
            if split[d]:
                out[f"n1_before_2_{d}"], out[f"n2_before_1_{d}"] = pick(of_pairs(k_ab, i, j, same), of_pairs(k_ba.T, i, j, same))
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = n1 / size1, n2 / size2
            t1, t2 = both(f"tiled_{d}")
            value = coefficient_values(shares[0], t1, shares[1], t2, variant != "plain")
            out[f"sttc_{d}"] = np.where(silent, 0.0 if variant == "guarded" else np.nan, value)
        yield out

    return block_pairs(spikes, t, task, schema)


def sttc(
    spikes: DataFrame, dt: int, start: int, stop: int, length: int, variant: str = "guarded", units: DataFrame | None = None
) -> DataFrame:
    """Tiling coefficient and match counts of every unordered unit pair of a recording.

    ``units`` may list units without spikes: their pairs get 0.0 and zero counts, or null
    with ``variant="null_empty"``.  ``variant="plain"`` leaves out the guards for P·T = 1.
    """
    names = ["sttc", "n1_dt_2", "n1_before_2", "n2_dt_1", "n2_before_1"]
    p = sttc_windows(spikes, [dt], start, stop, length, variant, units)
    return p.select(
        "recording_id", "cluster1_id", "cluster2_id", "cluster1_size", "cluster2_size", *[F.col(f"{c}_0").alias(c) for c in names]
    )


def replicate_sttc(trains: DataFrame, n: int, dt: int, start: int, stop: int, length: int) -> DataFrame:
    """Tiling coefficient of every unordered unit pair in each of ``n`` replicates (``replicate``, from 0): columns ``sttc_0`` on.

    Null where one of the units has no spike in the replicate.  All replicates of a pair are counted in one task.
    """
    per = tiled_time(trains, [*UNIT, "replicate"], dt, start, stop, length)
    at = lambda c, r: F.max(F.when(F.col("replicate") == r, F.col(c)))
    units = per.groupBy(*UNIT).agg(
        *[at("n_spikes", r).cast("double").alias(f"size_{r}") for r in range(n)], *[at("tiled", r).alias(f"tiled_{r}") for r in range(n)]
    )
    schema = "recording_id string, cluster1_id long, cluster2_id long"
    schema += "".join(f", sttc_{r} double" for r in range(n))

    def task(a: Block, b: Block, same: bool) -> Iterator[dict]:
        i, j, swap = unordered(a, b, same)
        pick = lambda x, y: (np.where(swap, y, x), np.where(swap, x, y))
        out = dict(zip(["cluster1_id", "cluster2_id"], pick(a.ids[i], b.ids[j])))
        for r in range(n):
            x = a.part(a.value("replicate") == r)
            y = x if same else b.part(b.value("replicate") == r)
            hits = matched(x, y, dt, False)[0]
            back = hits if same else matched(y, x, dt, False)[0]
            pa_, pb_ = pick(of_pairs(hits, i, j, same) / a.column(f"size_{r}")[i], of_pairs(back.T, i, j, same) / b.column(f"size_{r}")[j])
            ta_, tb_ = pick(a.column(f"tiled_{r}")[i], b.column(f"tiled_{r}")[j])
            out[f"sttc_{r}"] = coefficient_values(pa_, ta_, pb_, tb_, True)
        yield out

    p = block_pairs(trains, units, task, schema, per_spike=("replicate",))
    # The guarded coefficient is known where both shares are.
    return p.select("*", *[F.col(f"sttc_{r}").isNotNull().alias(f"has_{r}") for r in range(n)])


def lagged_sttc(spikes: DataFrame, dt: int, lags: Sequence[int], start: int, stop: int, length: int) -> DataFrame:
    """Tiling coefficient of each unit with itself shifted by each lag.

    A task takes a stretch of the trains of a block of units, and the spikes of the stretches beside it that a lag
    reaches.  It counts all lags, so a spike is copied once per stretch it reaches, never once per lag.
    """
    lags = [int(x) for x in lags]
    reach = max([dt, *map(abs, lags)]) + dt
    most = spikes.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // LAG_SPIKES))
    cell = lambda x: F.expr(f"({x} - pmod({x}, {length})) div {length}")
    near = F.sequence(cell(f"(t - {reach})"), cell(f"(t + {reach})"))
    rows = spikes.select(*UNIT, "t").dropna(subset=UNIT).withColumn("_block", F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)).cast("int"))
    # A unit without times is in one stretch, where it counts nothing.
    rows = rows.withColumn("_seg", F.explode(F.coalesce(near, F.array(F.lit(0).cast("bigint")))))
    sums, ends = ["n_a", "n_b", "m_a", "m_b", "o_a", "o_b"], ["first_a", "first_b", "last_a", "last_b"]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        known = rows.filter(pc.is_valid(rows.column("t")))
        c, t = known.column("cluster_id").to_numpy(), known.column("t").to_numpy()
        own = t // length == key[2].as_py()
        lost = rows.filter(pc.is_null(rows.column("t"))).column("cluster_id").to_numpy()
        ids = np.unique(np.concatenate([c[own], lost]))
        keep = np.isin(c, ids)
        c, t, own = np.searchsorted(ids, c[keep]), t[keep], own[keep]
        by = np.lexsort((t, c))
        u, t, own = c[by], t[by], own[by]
        # Trains one after the other on one axis, too far apart for any lag to reach the next one.
        low = int(t.min()) - reach - 1 if len(t) else 0
        wide = (int(t.max()) - low if len(t) else 0) + reach + 1
        at = u * wide + (t - low)
        gap = np.diff(t, prepend=0)
        follows = np.diff(u, prepend=-1) == 0
        made = {k: [] for k in ["lag", *sums, *ends]}
        for lag in lags:
            a, b = (t >= start + lag) & (t <= stop), (t >= start) & (t <= stop - lag)
            made["lag"].append(np.full(len(ids), lag))
            for x, mine, others, shift in (("a", a, b, lag), ("b", b, a, -lag)):
                count = lambda w: np.bincount(u[w], minlength=len(ids))
                moved, there = at - shift, at[others]
                met = np.searchsorted(there, moved + dt, "right") > np.searchsorted(there, moved - dt)
                made[f"n_{x}"].append(count(mine & own))
                made[f"m_{x}"].append(count(mine & own & met))
                pair = mine & own & follows & np.concatenate([[False], mine[:-1]])
                over = np.zeros(len(ids), np.int64)
                np.add.at(over, u[pair], np.minimum(gap[pair] - 2 * dt, 0))
                made[f"o_{x}"].append(over)
                zero = start + lag if x == "a" else start
                first, last = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.iinfo(np.int64).min)
                np.minimum.at(first, u[mine & own], t[mine & own] - zero)
                np.maximum.at(last, u[mine & own], t[mine & own] - zero)
                none = made[f"n_{x}"][-1] == 0
                made[f"first_{x}"].append(np.ma.array(first, mask=none))
                made[f"last_{x}"].append(np.ma.array(last, mask=none))
        cols = {k: np.ma.concatenate(v) if k in ends else np.concatenate(v) for k, v in made.items()}
        arrays = [pa.array(np.ma.getdata(v), pa.int64(), mask=np.ma.getmaskarray(v)) for v in cols.values()]
        n = len(ids) * len(lags)
        return pa.Table.from_arrays([pa.repeat(key[0], n), pa.array(np.tile(ids, len(lags)), pa.int64()), *arrays], ["recording_id", "cluster_id", *cols])

    schema = "recording_id string, cluster_id long, lag long, " + ", ".join(f"{c} long" for c in [*sums, *ends])
    d = rows.groupBy("recording_id", "_block", "_seg").applyInArrow(run, schema)
    total = lambda c: F.sum(c) if c in sums else F.min(c) if c.startswith("first") else F.max(c)
    d = d.groupBy(*UNIT, "lag").agg(*[total(c).alias(c) for c in [*sums, *ends]])
    end = F.lit(stop - start) - F.col("lag")

    def tiled(x: str) -> Column:
        """As ``tiled_time``."""
        n, head, tail = F.col(f"n_{x}"), F.least(F.col(f"first_{x}") - dt, F.lit(0)), F.least(end - F.col(f"last_{x}") - dt, F.lit(0))
        return (2 * dt * n + F.col(f"o_{x}") + F.when((n == 1) & (head < 0), head).otherwise(head + tail)) / end

    value = coefficient(F.try_divide("m_a", "n_a"), tiled("a"), F.try_divide("m_b", "n_b"), tiled("b"))
    empty = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    return d.select(*UNIT, "lag", "n_a", "n_b", "m_a", "m_b", F.when(empty, 0.0).otherwise(value).alias("sttc"))


def correlation_index(spikes: DataFrame, dt: int, start: int, stop: int) -> DataFrame:
    """Coincident pairs over the number expected for independent trains, all unit pairs."""
    sizes = spikes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))

    def task(a: Block, b: Block, same: bool) -> Iterator[dict]:
        i, j, swap = unordered(a, b, same)
        first, end = np.searchsorted(a.t, b.t - dt), np.searchsorted(a.t, b.t + dt, "right")
        hits = counted(first, end, b.u, a.u, (len(b.ids), len(a.ids)))
        pick = lambda x, y: (np.where(swap, y, x), np.where(swap, x, y))
        ids, n = pick(a.ids[i], b.ids[j]), pick(a.column("n")[i], b.column("n")[j])
        yield {"c1": ids[0], "c2": ids[1], "n1": n[0], "n2": n[1], "n_pairs": of_pairs(hits.T, i, j, same)}

    d = block_pairs(spikes, sizes, task, "recording_id string, c1 long, c2 long, n1 long, n2 long, n_pairs long")
    expect = F.col("n1").cast("double") * F.col("n2") * (2 * dt)
    return d.withColumn("corr_index", F.col("n_pairs") * F.lit(float(stop - start)) / expect)


def lag_histogram(spikes: DataFrame, width: int, bin_width: int, auto: bool = False) -> DataFrame:
    """Cross- or autocorrelogram counts: differences t2 - t1 in [-width, width) per bin."""
    return autocorrelogram(spikes, width, bin_width) if auto else crosscorrelogram(spikes, width, bin_width)


def crosscorrelogram(spikes: DataFrame, width: int, bin_width: int) -> DataFrame:
    """Counts of the differences of every two units (c1 < c2), made where both blocks of trains lie."""
    bins = -(-2 * width // bin_width)

    def task(a: Block, b: Block, same: bool) -> Iterator[dict]:
        for first, step, mine in strips(a, b, bins):
            shape = (step, len(b.ids), bins)
            n = np.zeros(step * len(b.ids) * bins, np.int64)
            for i, j, _, d in near(a, b, mine, width, width, same):
                ok = (d >= -width) & (d < width)
                at = ((a.u[i] - first) * shape[1] + b.u[j]) * bins + (d + width) // bin_width
                n += np.bincount(at[ok], minlength=len(n))
            yield histogram_rows(a, b, first, shape, np.flatnonzero(n)) | {"n": n[n > 0]}

    return block_pairs(spikes, spikes.select(*UNIT).distinct(), task, "recording_id string, c1 long, c2 long, bin long, n long")


def histogram_rows(a: Block, b: Block, first: int, shape: tuple[int, int, int], at: np.ndarray) -> dict:
    """Units and bins of the places ``at`` of a strip's matrix of units, units and bins."""
    i, j, k = np.unravel_index(at, shape)
    x, y = a.ids[i + first], b.ids[j]
    return {"c1": np.minimum(x, y), "c2": np.maximum(x, y), "bin": k}


def autocorrelogram(spikes: DataFrame, width: int, bin_width: int) -> DataFrame:
    """Counts of the differences within each unit, none between spikes at one position.

    Both sides are first counted per position so that the join carries counts.
    """
    pos = spikes.groupBy(*UNIT, "t").agg(F.count(F.lit(1)).alias("m"), F.min("spike_id").alias("spike_id"))
    cell = F.floor(F.col("t") / width)
    a = pos.withColumnsRenamed({"t": "t1", "m": "m1"}).withColumn("cell", F.floor(F.col("t1") / width))
    b = pos.select(*UNIT, F.col("t").alias("t2"), F.col("m").alias("m2"), F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"))
    d = F.col("t2") - F.col("t1")
    j = salted_join(a, b, [*UNIT, "cell"], F.col("spike_id")).where((d >= -width) & (d < width) & (d != 0))
    return j.groupBy(*UNIT, F.floor((d + width) / bin_width).alias("bin")).agg(F.sum(F.col("m1") * F.col("m2")).cast("bigint").alias("n"))


def jittered_histogram(spikes: DataFrame, width: int, bin_width: int, jitter: int) -> DataFrame:
    """Cross-correlogram counts (c1 < c2) beside what jittered surrogates of the first train expect.

    A surrogate moves every spike of the first train by its own whole offset, uniform in [-jitter, jitter).
    Its count in a bin is expected to be the sum over pairs of the share of offsets that lead there, so no
    surrogate is drawn and no spike is copied per draw.  ``variance`` takes the pairs as independent;
    ``z`` is the excess over its root, NULL where nothing can vary.  Rows: bins that the train or
    a surrogate can reach; ``bin_width`` divides ``2 * width`` and ``jitter`` is at least 1.
    """
    if 2 * width % bin_width or jitter < 1:
        raise ValueError("bins fill the window and the jitter is at least 1")
    bins, reach, every = 2 * width // bin_width, width + jitter, 2 * jitter

    def task(a: Block, b: Block, same: bool) -> Iterator[dict]:
        for first, step, mine in strips(a, b, bins):
            shape = (step, len(b.ids), bins)
            size = step * len(b.ids) * bins
            n, hits, spread = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            for i, j, _, d in near(a, b, mine, reach, reach, same):
                # Differences from the window's start; a surrogate's lie in [lo, hi).
                d = d + width
                ok = (d + jitter + 1 > 0) & (d - jitter + 1 < 2 * width)
                d, row = d[ok], (((a.u[i] - first) * shape[1] + b.u[j]) * bins)[ok]
                lo, hi = d - jitter + 1, d + jitter + 1
                own = (d >= 0) & (d < 2 * width)
                n += np.bincount(row[own] + d[own] // bin_width, minlength=size)
                low, top = np.maximum(lo // bin_width, 0), np.minimum((hi - 1) // bin_width, bins - 1)
                for k in range(int((top - low).max(initial=-1)) + 1):
                    on = low + k <= top
                    at = low[on] + k
                    share = np.minimum(hi[on], (at + 1) * bin_width) - np.maximum(lo[on], at * bin_width)
                    at += row[on]
                    hits += np.bincount(at, share.astype(float), size)
                    spread += np.bincount(at, share.astype(float) * (every - share), size)
            at = np.flatnonzero(hits)
            yield histogram_rows(a, b, first, shape, at) | {
                "n": n[at], "expected": hits[at] / every, "variance": spread[at] / (float(every) * every)
            }

    h = block_pairs(
        spikes, spikes.select(*UNIT).distinct(), task, "recording_id string, c1 long, c2 long, bin long, n long, expected double, variance double"
    )
    z = F.when(F.col("variance") > 0, (F.col("n") - F.col("expected")) / F.sqrt("variance"))
    return h.withColumn("z", z)


def differences(spikes: DataFrame, width: int) -> DataFrame:
    """Every difference t2 - t1 in [-width, width) between spikes of two units (c1 < c2)."""
    def task(a: Block, b: Block, same: bool) -> Iterator[dict]:
        s, r = a.value("spike_id"), b.value("spike_id")
        for i, j, swap, d in near(a, b, np.arange(len(a.t)), width, width, same):
            ok = (d >= -width) & (d < width)
            i, j, swap, d = i[ok], j[ok], swap[ok], d[ok]
            pick = lambda x, y: (np.where(swap, y, x), np.where(swap, x, y))  # noqa: E731,B023
            yield dict(zip(["c1", "c2", "s1", "s2"], [*pick(a.ids[a.u[i]], b.ids[b.u[j]]), *pick(s[i], r[j])])) | {"diff": d}

    schema = "recording_id string, c1 long, c2 long, s1 long, s2 long, diff long"
    return block_pairs(spikes, spikes.select(*UNIT).distinct(), task, schema, per_spike=("spike_id",))


def circular_coincidence(spikes: DataFrame, bin_width: int, stop: int, shifts: int) -> DataFrame:
    """Dot product of two binary trains at each circular shift 0..shifts-1 of the second."""
    n_bins = -(-stop // bin_width)
    b = spikes.select(*UNIT, F.expr(f"t div {bin_width}").alias("bin")).distinct()
    trains = b.select(*UNIT, F.col("bin").cast("bigint").alias("t"))

    def task(a: Block, b: Block, same: bool) -> Iterator[dict]:
        i, j, swap = unordered(a, b, same)
        pick = lambda x, y: (np.where(swap, y, x), np.where(swap, x, y))
        c1, c2 = pick(a.ids[i], b.ids[j])
        for s in range(shifts):
            ab = equal_times(a, b, s, n_bins)
            ba = ab if same else equal_times(b, a, s, n_bins)
            n = np.where(swap, of_pairs(ba.T, i, j, same), of_pairs(ab, i, j, same))
            some = np.flatnonzero(n)
            yield {"c1": c1[some], "c2": c2[some], "shift": np.full(len(some), s), "n": n[some]}

    return block_pairs(trains, trains.select(*UNIT).distinct(), task, "recording_id string, c1 long, c2 long, shift int, n long")


def graph_strength(edges: DataFrame, weight: str, keep: Column) -> DataFrame:
    """Degree and strength of every vertex of the graph of kept edges."""
    # Both ends of a row in one pass: a union would make the edges twice.
    ends = edges.where(keep).select("recording_id", F.explode(F.array("cluster1_id", "cluster2_id")).alias("cluster_id"), weight)
    return ends.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("degree"), F.sum(weight).alias("strength"))
