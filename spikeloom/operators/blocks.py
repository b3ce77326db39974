"""Pairs of units by blocks: what two trains share is counted where both blocks of trains lie.

Units are dealt to blocks by a hash; a task gets the trains of two blocks, cuts them into small
ones, counts every pair of units of two small blocks in a matrix and returns finished rows.  Spikes
are copied once per block, so the shuffle grows with spikes times blocks and no match of two spikes
is ever a row.  Blocks are as large as their trains allow once there are enough for all tasks; what
a task counts at once is bounded by the small blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a small block, units and spikes that a block holds on average, and array elements that a task handles at once.
BLOCK_UNITS, WIDE_UNITS, BLOCK_SPIKES, SLICE = 512, 4096, 1 << 20, 1 << 21
#: Blocks that are enough for all tasks: 528 pairs of blocks.
BLOCKS = 32
#: Multiplications of a matrix product in the time that one listed place takes.
PRODUCTS = 400
REC, SPIKE = "recording_id", "_spike_"


class Block:
    """Sorted units of a block (``ids``), their table and their trains: times in order (``t``), unit (``u``) and ``weight`` of each."""

    def __init__(self, rows: pa.Table, side: int) -> None:
        rows = rows.filter(pc.equal(rows.column("_block"), side))
        flat = lambda c: pa.concat_arrays([x.flatten() for x in rows.column(c).chunks]) if rows.num_rows else None
        self.table = flat("_units")
        get = lambda a: np.zeros(0, np.int64) if a is None else a.to_numpy(zero_copy_only=False)
        ids = get(self.table if self.table is None else self.table.field("cluster_id"))
        self.order = np.argsort(ids)
        self.ids = ids[self.order]
        self.spikes = {c.removeprefix(SPIKE): get(flat(c)) for c in rows.column_names if c.startswith(SPIKE)}
        c, t = self.spikes["cluster_id"], self.spikes["t"]
        self.at = np.argsort(t, kind="stable")
        self.t, self.u = t[self.at], np.searchsorted(self.ids, c[self.at])

    def column(self, name: str) -> np.ndarray:
        """A column of the unit table, by sorted unit; floats with NaN for nulls."""
        return self.table.field(name).to_numpy(zero_copy_only=False)[self.order]

    def part(self, keep: np.ndarray) -> Block:
        """The same units with some of the spikes."""
        out = copy(self)
        out.t, out.u, out.at = self.t[keep], self.u[keep], self.at[keep]
        return out

    def value(self, name: str) -> np.ndarray:
        """A column of the spikes, in their order."""
        return self.spikes[name][self.at]

    def small(self) -> list[Block]:
        """The units in blocks of ``BLOCK_UNITS``, with their spikes."""
        out = []
        for first in range(0, len(self.ids), BLOCK_UNITS):
            end = min(first + BLOCK_UNITS, len(self.ids))
            one = self.part((self.u >= first) & (self.u < end))
            one.ids, one.order, one.u = self.ids[first:end], self.order[first:end], one.u - first
            out.append(one)
        return out


def block_pairs(
    spikes: DataFrame, units: DataFrame, task: Callable[[Block, Block, bool], Iterator[dict]], schema: str, per_spike: tuple[str, ...] = ()
) -> DataFrame:
    """Rows that ``task`` makes of every two blocks of a recording, each unordered pair of units being in one of them.

    ``units`` has a row per unit with the columns the task needs; ``spikes`` have recording_id,
    cluster_id, t and the columns of ``per_spike``.  The third argument says whether both are the same block.
    A task holds the trains of two blocks, at least those of two units, and is called for every two small blocks of them.
    """
    known = lambda d: d.where(F.col(REC).isNotNull() & F.col("cluster_id").isNotNull())
    spikes, units = known(spikes.where(F.col("t").isNotNull())), known(units)
    # Two numbers decide on the blocks: the units and the spikes of the largest recordings.
    most = lambda d: d.groupBy(REC).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n_units = most(units)
    up = lambda x, y: -(-x // y)
    n = max(1, up(n_units, WIDE_UNITS), min(up(n_units, BLOCK_UNITS), BLOCKS), min(n_units, up(most(spikes), BLOCK_SPIKES)))
    block = F.pmod(F.xxhash64("cluster_id"), F.lit(n)).cast("int").alias("_block")
    pack = lambda d, cols, part: d.groupBy(REC, block, part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_rows"))
    part = F.pmod(F.xxhash64("cluster_id", "t"), F.lit(16))
    # An array per column, sorted by unit: fewer bytes to shuffle than an array of rows.
    of_spike = ["cluster_id", *per_spike, "t"]
    trains = pack(spikes, of_spike, part).select(REC, "_block", *[F.col("_rows")[c].alias(SPIKE + c) for c in of_spike])
    table = pack(units, ["cluster_id", *[c for c in units.columns if c not in (REC, "cluster_id")]], F.lit(0)).select(REC, "_block", F.col("_rows").alias("_units"))
    rows = trains.unionByName(table, allowMissingColumns=True)
    packs = ["_units", *[SPIKE + c for c in of_spike]]
    rows = rows.withColumns({c: F.coalesce(c, F.array()) for c in packs})
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        REC, F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), "_block", *packs
    )
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = key[1].as_py(), key[2].as_py()
        rows = pa.Table.from_batches(rows)
        a = Block(rows, lo).small()
        b = a if lo == hi else Block(rows, hi).small()
        for i, j in product(range(len(a)), range(len(b))):
            for made in task(a[i], b[j], i == j and lo == hi) if lo < hi or i <= j else ():
                cols = [pa.array(made[c], kinds[c], from_pandas=True) for c in fields if c != REC]
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(cols[0])), *cols], fields)

    kinds = {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in schema.split(",") if f.split()[0] != REC}
    n_tasks = min(n * (n + 1) // 2, 4096) if n > 1 else None
    rows = rows.repartition(n_tasks, REC, "_lo", "_hi") if n_tasks else rows
    return rows.groupBy(REC, "_lo", "_hi").applyInArrow(run, schema)


def block_tables(
    rows: DataFrame, keys: list[str], ident: str, task: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, size: int = 2048
) -> DataFrame:
    """Rows that ``task`` makes of every two blocks of a group's rows, each unordered pair of blocks once.

    Blocks hold about ``size`` values of ``ident``, so a row is copied once per block of its group and no pair
    of rows passes a shuffle.  The third argument of ``task`` says whether both are the same block.
    """
    rows = rows.dropna(subset=[*keys, ident])
    # One number decides on the blocks: the values of the largest group.
    most = rows.select(*keys, ident).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n = max(1, -(-most // size))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.withColumns({"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")}).drop("_other")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, same = pa.Table.from_batches(batches), key[-2].as_py() == key[-1].as_py()
        side = lambda k: whole.filter(pc.equal(whole.column("_block"), k))
        a = whole if same else side(key[-2])
        b = a if same else side(key[-1])
        yield from task(a, b, same) if a.num_rows and b.num_rows else ()

    by = [*keys, "_lo", "_hi"]
    # Few bytes make many rows, so the number of tasks follows the blocks, not the bytes.
    return dealt.repartition(min(n * (n + 1) // 2 * 32, 4096), *by).groupBy(*by).applyInArrow(run, schema)


def counted(first: np.ndarray, end: np.ndarray, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Matrix of how often ``row[k]`` meets ``column[i]`` for first[k] <= i < end[k].

    Places are listed one by one, or cut into cells where that is less work: what rows hold of whole cells is
    multiplied with what columns have in them, and only places beside whole cells are listed.
    """
    end = np.maximum(end, first)
    edges = cells(first, end, len(column), shape)
    if edges is None:
        out = np.zeros(shape, np.int64)
    else:
        lo, hi = np.searchsorted(edges, first), np.searchsorted(edges, end, "right") - 1
        k = np.flatnonzero(hi > lo)
        whole = whole_cells(row[k], lo[k], hi[k], edges, column, shape)
        out = whole if whole is not None else np.zeros(shape, np.int64)
        if whole is not None:
            # A range's places before its first whole cell, and those behind its last one.
            head, tail = end.copy(), end.copy()
            head[k], tail[k] = edges[lo[k]], edges[hi[k]]
            first, end, row = np.concatenate([first, tail]), np.concatenate([head, end]), np.concatenate([row, row])
            rest = end > first
            first, end, row = first[rest], end[rest], row[rest]
    out, size = out.reshape(-1), end - first
    kind = np.int32 if max(len(out), len(column)) < 1 << 31 else np.int64
    base, place, column = (row * shape[1]).astype(kind), first.astype(kind), column.astype(kind)
    for lo, hi in sliced(size):
        n, ends = size[lo:hi], np.cumsum(size[lo:hi])
        i = np.repeat(place[lo:hi] - (ends - n).astype(kind), n)
        i += np.arange(len(i), dtype=kind)
        at = np.repeat(base[lo:hi], n)
        at += column[i]
        out += np.bincount(at, minlength=len(out))
    return out.reshape(shape)


def cells(first: np.ndarray, end: np.ndarray, n: int, shape: tuple[int, int]) -> np.ndarray | None:
    """Edges of cells of ``n`` places for ``counted``: all ends of ranges if these are few, else a grid; None where listing is less work."""
    listed = int((end - first).sum()) * PRODUCTS
    one = shape[0] * shape[1]
    if not n or listed <= one:
        return None
    ends = np.unique(np.concatenate([first, end]))
    if 2 * len(ends) * one < listed and len(ends) * sum(shape) <= SLICE:
        return ends
    width = max(1, round((one * n / (PRODUCTS * len(first))) ** 0.5), -(-n * sum(shape) // SLICE))
    if one * (n // width + 1) + PRODUCTS * width * len(first) < listed / 2:
        return np.arange(0, n + width, width)
    return None


def whole_cells(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, edges: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> np.ndarray | None:
    """Matrix of how often rows meet columns in the cells lo to hi - 1; None if a count may be too large to be exact."""
    n, wide = len(edges) - 1, len(edges)
    most = np.bincount(row, edges[hi] - edges[lo], 1).max(initial=0)
    if most >= 1 << 52:
        return None
    kind = np.float32 if most < 1 << 24 else np.float64
    steps = np.bincount(row * wide + lo, minlength=shape[0] * wide) - np.bincount(row * wide + hi, minlength=shape[0] * wide)
    holds = np.cumsum(steps.reshape(shape[0], wide), axis=1)[:, :n].astype(kind)
    at = np.searchsorted(edges, np.arange(len(column)), "right") - 1
    inside = (at >= 0) & (at < n)
    has = np.bincount(at[inside] * shape[1] + column[inside], minlength=n * shape[1]).reshape(n, shape[1]).astype(kind)
    return np.rint(holds @ has).astype(np.int64)


def sliced(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to at most ``SLICE``, or of one row."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        yield at, to
        at = to


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges ``first + 0..size-1`` and the range it is of."""
    k = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    return np.arange(len(k)) + np.repeat(first - (ends - size), size), k


def zones(t: np.ndarray, u: np.ndarray, dt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit, first, middle and last position of the intervals that meet a spike of the unit within dt.

    Spike b answers for the positions whose first spike at or after ``position - dt`` is b; positions
    before the middle precede it.  Intervals of one unit are disjoint.
    """
    by = np.lexsort((t, u))
    t, u = t[by], u[by]
    lo = t - dt
    same = u[1:] == u[:-1]
    lo[1:] = np.where(same, np.maximum(lo[1:], t[:-1] + dt + 1), lo[1:])
    keep = lo <= t + dt
    return u[keep], lo[keep], np.maximum(t, lo)[keep], (t + dt)[keep]


def matched(a: Block, b: Block, dt: int, split: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """For every unit of ``a`` (row) and of ``b``: spikes of a's with a spike of b's within dt, and those before it (``split``, or else none)."""
    u, lo, mid, hi = zones(b.t, b.u, dt)
    s, e = np.searchsorted(a.t, lo), np.searchsorted(a.t, hi, "right")
    shape = (len(b.ids), len(a.ids))
    if not split:
        return counted(s, e, u, a.u, shape).T, None
    m = np.searchsorted(a.t, mid)
    before = counted(s, m, u, a.u, shape)
    return (before + counted(m, e, u, a.u, shape)).T, before.T


def of_pairs(matrix: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> np.ndarray:
    """A matrix of two blocks' units at the pairs of ``unordered``."""
    return matrix[i, j] if same else matrix.ravel()


def unordered(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the pairs of two blocks, each once, and whether the column's unit is the smaller one."""
    if same:
        i, j = np.triu_indices(len(a.ids), 1)
    else:
        i, j = (x.ravel() for x in np.indices((len(a.ids), len(b.ids))))
    return i, j, b.ids[j] < a.ids[i]


def equal_times(a: Block, b: Block, shift: int = 0, period: int | None = None) -> np.ndarray:
    """For every unit of ``a`` (row) and of ``b``: pairs of spikes of equal time, b's moved by ``shift`` around ``period``."""
    t = b.t + shift if period is None else (b.t + shift) % period
    return counted(np.searchsorted(a.t, t), np.searchsorted(a.t, t, "right"), b.u, a.u, (len(b.ids), len(a.ids))).T


def strips(a: Block, b: Block, cells: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First unit, number of units and their spikes in ``a``, for strips of units whose matrix of ``cells`` per pair stays near ``SLICE``."""
    step = max(1, SLICE // max(1, len(b.ids) * cells))
    for first in range(0, len(a.ids), step):
        yield first, step, np.flatnonzero((a.u >= first) & (a.u < first + step))


def near(a: Block, b: Block, spikes: np.ndarray, back: int, ahead: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of spikes (places in ``a`` and in ``b``) of which b's lies in [-back, ahead] of a's, each unordered pair of units once:
    the places, whether b's unit is the smaller one, and the difference of the larger unit's time to the smaller one's.
    """
    t = a.t[spikes]
    first, size = np.searchsorted(b.t, t - back), np.searchsorted(b.t, t + ahead, "right")
    size = size - first
    for lo, hi in sliced(size):
        j, k = spread(first[lo:hi], size[lo:hi])
        i = spikes[lo:hi][k]
        swap = b.ids[b.u[j]] < a.ids[a.u[i]]
        keep = a.u[i] < b.u[j] if same else slice(None)
        i, j, swap = i[keep], j[keep], swap[keep]
        d = b.t[j] - a.t[i]
        yield i, j, swap, np.where(swap, -d, d)
