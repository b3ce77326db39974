"""Composed reads of recordings: window, scale, reference, map, average, filter, notch, whiten, decimate.

Everything stays in chunk form (recording_id, channel, chunk, samples).  Channel and time ranges are
predicates on the stored columns, so they reach the scan; what crosses channels is worked on per
(probe, chunk), which the width of a probe bounds.

A recording table ``recordings(recording_id, start, stop)`` holds the sample range of every recording that
analyses use; ``probes(recording_id, probe, lo, hi)`` the channels [lo, hi) of every probe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spikeloom.operators import chunks as ch
from spikeloom.operators.skew import attach
from spikeloom.session import checkpoint
from spikeloom.sources.recording import FilterSettings

REC = "recording_id"
CHAN = ch.CHAN
MOST_CHANNELS = 1024


def regular(rows: DataFrame, at: Column, size: int, stop: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Chunks of ``size`` samples from arrays that begin at position ``at``; what lies before 0 or from ``stop`` on is left out."""
    n = F.size("samples")
    d = rows.withColumn("_at", at.cast("bigint"))
    lo = F.greatest(-F.col("_at"), F.lit(0))
    hi = n if stop is None else F.least(n, stop - F.col("_at"))
    d = d.withColumns({"_lo": lo, "_n": hi - lo}).where("_n > 0")
    d = d.withColumns({"samples": F.slice("samples", (F.col("_lo") + 1).cast("int"), F.col("_n").cast("int")), "_at": F.col("_at") + F.col("_lo")})
    d = d.withColumn("_chunk", F.explode(F.sequence(F.expr(f"_at div {size}"), F.expr(f"(_at + _n - 1) div {size}"))))
    a = F.greatest(F.col("_chunk") * size - F.col("_at"), F.lit(0))
    b = F.least((F.col("_chunk") + 1) * size - F.col("_at"), F.col("_n"))
    piece = F.struct((F.col("_at") + a).alias("at"), F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("s"))
    g = d.groupBy(*CHAN, *keep, F.col("_chunk").alias("chunk")).agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    return g.select(*CHAN, *keep, "chunk", F.flatten(F.transform("_p", lambda p: p["s"])).alias("samples"))


def window(chunks: DataFrame, size: int, start: int = 0, end: int | None = None, recordings: DataFrame | None = None) -> DataFrame:
    """Samples [start, end) of every channel, numbered anew from 0; counted from each recording's own start where one is given."""
    if recordings is None:
        d = chunks.where(F.col("chunk") >= start // size)
        d = d if end is None else d.where(F.col("chunk") <= (end - 1) // size)
        return regular(d, F.col("chunk") * size - start, size, None if end is None else F.lit(end - start))
    stop = F.col("stop") if end is None else F.least(F.col("stop"), F.col("start") + end)
    d = chunks.join(recordings.select(REC, (F.col("start") + start).alias("_from"), stop.alias("_to")), REC)
    d = d.where(F.expr(f"chunk >= _from div {size} and chunk <= (_to - 1) div {size}")).withColumn("_len", F.col("_to") - F.col("_from"))
    return regular(d, F.col("chunk") * size - F.col("_from"), size, F.col("_len"))


def probe_channels(probes: DataFrame) -> DataFrame:
    """(recording_id, channel, probe, lo): a row a channel, so channels meet their probe by key, not by range."""
    return probes.select(REC, "probe", "lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("channel"))


def scaled_chunks(chunks: DataFrame, channels: DataFrame) -> DataFrame:
    """Samples times the channel's coefficient, minus its mean."""
    d = attach(chunks, channels.select(*CHAN, "coeff", "mean"), CHAN, F.col("chunk"))
    return d.withColumn("samples", F.transform("samples", lambda v: v * F.col("coeff") - F.col("mean"))).drop("coeff", "mean")


def across(chunks: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """(keys, chunk, samples): the median (cmr, median) or mean (car, mean) over the channels of each key, sample by sample.

    Channels may end at different samples; those that are there count.
    """
    fold = {"cmr": np.nanmedian, "median": np.nanmedian, "car": np.nanmean, "mean": np.nanmean}[kind]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for group in b.column("_x"):
                rows = [np.asarray(x.values) for x in group.values]
                full = np.full((len(rows), max(map(len, rows))), np.nan)
                for row, x in zip(full, rows):
                    row[: len(x)] = x
                made.append(fold(full, axis=0))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in (*keys, "chunk")], pa.array(made, pa.list_(pa.float64()))], [*keys, "chunk", "samples"])

    g = chunks.groupBy(*keys, "chunk").agg(F.collect_list("samples").alias("_x"))
    kind_of = dict(g.dtypes)
    return g.mapInArrow(task, ", ".join(f"{k} {kind_of[k]}" for k in (*keys, "chunk")) + ", samples array<double>")


def less(chunks: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples minus the reference of their key."""
    d = chunks.join(reference.select(*keys, "chunk", F.col("samples").alias("_r")), [*keys, "chunk"])
    return d.withColumn("samples", F.zip_with("samples", F.slice("_r", 1, F.size("samples")), lambda x, r: x - r)).drop("_r")


def grids(column: pa.Array) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(channels, lengths, channels x samples) of every gathered probe, by channel; zeros behind channels that end early."""
    for group in column:
        pieces = group.values
        channels, rows = pieces.field("channel").to_pylist(), pieces.field("samples")
        if len(channels) > MOST_CHANNELS:
            raise ValueError(f"{len(channels)} channels in one probe; a probe has {MOST_CHANNELS} at most")
        size = pc.list_value_length(rows).to_numpy()
        order = sorted(range(len(channels)), key=channels.__getitem__)
        grid = np.zeros((len(channels), size.max(initial=0)))
        for line, k in zip(grid, order):
            line[: size[k]] = rows[k].values.to_numpy()
        yield [channels[k] for k in order], size[order], grid


def matrices(column: pa.Array) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of every gathered list of (i, j, value); entries that are not there are zero."""
    for group in column:
        i, j, value = (group.values.field(k).to_pylist() for k in range(3))
        ids = sorted({*i, *j})
        place = {c: k for k, c in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)))
        m[[place[c] for c in i], [place[c] for c in j]] = value
        yield ids, m


def gathered(chunks: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """The channels of every (keys, chunk) in one row; the width of a probe and of a chunk bound it."""
    return chunks.groupBy(*keys, "chunk").agg(F.collect_list(F.struct("channel", "samples")).alias("_x"), *more)


def in_tasks(rows: DataFrame, keys: Sequence[str], columns: str, work: Callable) -> DataFrame:
    """``work(batch)`` yields, for every row of the batch, a list of tuples of ``columns``; the row's keys go before them."""
    kind = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kind[k]}" for k in keys], columns])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = zip(*[b.column(k).to_pylist() for k in keys])
            for head, made in zip(heads, work(b)):
                if made:
                    values = list(zip(*[(*head, *m) for m in made]))
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    return rows.mapInArrow(task, schema)


def probe_gram(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, n, sxy): sums of products of all channels i, j of a probe: a matrix product a chunk, summed by pair."""
    kind = dict(chunks.dtypes)["channel"]

    def work(b: pa.RecordBatch) -> Iterator[list]:
        for channels, size, grid in grids(b.column("_x")):
            gram = grid @ grid.T
            yield [(a, channels, np.minimum(size, size[i]), gram[i]) for i, a in enumerate(channels)]

    rows = in_tasks(gathered(chunks, keys), keys, f"i {kind}, js array<{kind}>, ns array<bigint>, gs array<double>", work)
    each = rows.select(*keys, "i", F.explode(F.arrays_zip("js", "ns", "gs")).alias("_z"))
    return each.groupBy(*keys, "i", F.col("_z.js").alias("j")).agg(F.sum("_z.ns").alias("n"), F.sum("_z.gs").alias("sxy"))


def inverse_root(gram: np.ndarray) -> np.ndarray:
    """U diag(1 / sqrt(s + 1e-8)) U' of a Gram matrix."""
    s, u = np.linalg.eigh(gram)
    return (u / np.sqrt(np.maximum(s, 0) + 1e-8)) @ u.T


def whitening_rows(gram: DataFrame, keys: Sequence[str], neighbours: int | None = None) -> DataFrame:
    """(keys, i, j, w): the whitening matrix of a probe, or its rows from the channels within ``neighbours`` of each.

    Products of channels that share no neighbourhood are left out before the shuffle; a centre gathers at most
    (2 * neighbours + 1) ** 2 of them, a whole probe MOST_CHANNELS ** 2.  Gram matrices are over their number of channels.
    """
    kind = dict(gram.dtypes)["i"]
    value = F.collect_list(F.struct("i", "j", "sxy")).alias("_p")
    if neighbours is None:
        rows, centre = gram.groupBy(*keys).agg(value), []
    else:
        lo, hi = F.greatest("i", "j") - neighbours, F.least("i", "j") + neighbours
        near = gram.where(F.abs(F.col("i") - F.col("j")) <= 2 * neighbours).withColumn("_c", F.explode(F.sequence(lo, hi)))
        rows, centre = near.groupBy(*keys, "_c").agg(value).where(F.exists("_p", lambda p: p["i"] == F.col("_c"))), ["_c"]

    def work(b: pa.RecordBatch) -> Iterator[list]:
        wanted = [[c] for c in b.column("_c").to_pylist()] if centre else [None] * b.num_rows
        for mine, (ids, m) in zip(wanted, matrices(b.column("_p"))):
            w = inverse_root(m / len(ids))
            yield [(a, c, float(w[x, y])) for x, a in enumerate(ids) if mine is None or a in mine for y, c in enumerate(ids)]

    return in_tasks(rows, keys, f"i {kind}, j {kind}, w double", work)


def whitened(chunks: DataFrame, matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whitening matrix times the channels of every (keys, chunk): a matrix product a chunk, no row a sample."""
    kind = dict(chunks.dtypes)
    rows = matrix.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "w")).alias("_w"))
    held = attach(gathered(chunks, keys), rows, list(keys), F.col("chunk"))

    def work(b: pa.RecordBatch) -> Iterator[list]:
        for (channels, size, grid), (ids, m) in zip(grids(b.column("_x")), matrices(b.column("_w"))):
            place = {c: k for k, c in enumerate(ids)}
            at = [place[c] for c in channels]
            made = m[np.ix_(at, at)] @ grid
            yield [(c, line[:n]) for c, line, n in zip(channels, made, size)]

    return in_tasks(held, [*keys, "chunk"], f"channel {kind['channel']}, samples array<double>", work)


def acquired(
    chunks: DataFrame,
    size: int,
    channels: DataFrame,
    probes: DataFrame,
    fs: float,
    *,
    only: tuple[int, int] | None = None,
    start: int = 0,
    end: int | None = None,
    recordings: DataFrame | None = None,
    reference: str = "cmr",
    mapped: DataFrame | None = None,
    average: str | None = None,
    filtering: FilterSettings | None = None,
    neighbours: int | None = None,
    whiten: bool = False,
) -> DataFrame:
    """The composed read: chunks (recording_id, channel, chunk, samples) of channels [only) and samples [start, end).

    ``channels(recording_id, channel, coeff, mean)`` scales raw samples; ``reference`` (cmr, car, none) is taken over the
    channel's own probe; ``mapped(probe, channel, mapped)`` renames channels, counted within their probe; ``average`` (mean, median) folds
    a probe into its first channel; ``filtering`` names the filter, a notch after it and the rate to decimate to; ``whiten`` multiplies with the
    whitening matrix of the probe, of the channels within ``neighbours`` where given.

    Ranges are predicates on channel and chunk, so a scan reads what is asked for: all channels of the asked probes
    where a reference or a matrix needs them, else the asked ones.  A window that begins within a chunk is cut
    anew.  Chunks of decimated signals are size * rate / fs samples, if that is whole, else of varying size.
    """
    wide = probe_channels(probes)
    if mapped is not None:
        wide = wide.withColumn("_k", F.col("channel") - F.col("lo")).join(mapped.select("probe", F.col("channel").alias("_k"), "mapped"), ["probe", "_k"])
        wide = wide.withColumn("physical", F.col("lo") + F.col("mapped")).drop("_k", "mapped")
    else:
        wide = wide.withColumn("physical", F.col("channel"))
    asked = lambda d, c="channel": d if only is None else d.where((F.col(c) >= only[0]) & (F.col(c) < only[1]))
    narrow = asked(wide)
    if reference != "none" or whiten or average:
        narrow = wide.join(narrow.select(REC, "probe").distinct(), [REC, "probe"])
    source = chunks.select(*CHAN, "chunk", "samples")
    if only is not None and mapped is None and not (reference != "none" or whiten or average):
        source = asked(source)
    names = narrow.select(REC, F.col("physical").alias("channel"), F.col("channel").alias("_name"), "probe", "lo")
    d = window(source.join(names.select(*CHAN), CHAN, "left_semi"), size, start, end, recordings)
    d = attach(scaled_chunks(d, channels), names, CHAN, F.col("chunk"))
    if reference != "none":
        d = less(d, across(d, [REC, "probe"], reference), [REC, "probe"])
    d = d.select(REC, F.col("_name").alias("channel"), "probe", "lo", "chunk", "samples")
    if average is None and not whiten:
        d = asked(d)
    if average is not None:
        d = across(d, [REC, "probe", "lo"], average).withColumn("channel", F.col("lo"))
    names = d.select(*CHAN, "probe").distinct() if whiten else None
    d = d.select(*CHAN, *(["probe"] if whiten and filtering is None else []), "chunk", "samples")
    rate = fs
    if filtering is not None:
        f = filtering
        if not f.filter_type.startswith(("fir", "remez")):
            d = checkpoint(d)  # a recursive filter reads its input several times
        d = ch.filtered(d, size, fs, f.filter_type, f.order, f.highpass, f.lowpass, f.high_width, f.low_width, f.window)
        if f.notch_freq:
            d = ch.notched(checkpoint(d), size, fs, f.notch_freq, f.notch_q)
        rate = f.sample_rate
    if whiten:
        d = checkpoint(d if "probe" in d.columns else attach(d, names, CHAN, F.col("chunk")))
        d = whitened(d, whitening_rows(probe_gram(d, [REC, "probe"]), [REC, "probe"], neighbours), [REC, "probe"])
        d = asked(d.select(*CHAN, "chunk", "samples"))
    return ch.downsample(d, size, fs, rate) if rate != fs else d
