"""Exact top-k by inner product, with a pivot table that bounds distances from below.

For every vector the distances to a fixed number of pivots are computed once.  By the triangle
inequality the distance of a query and a candidate is at least the difference of their distances to
any pivot; the greatest of these bounds gives, with both lengths, an upper bound of the inner product.
Candidates are evaluated in the order of their bounds, until no bound reaches the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.llm.graph import settled

K, SCALE, EVERY = 10, 1024, 100
PIVOTS, SAMPLE = 32, 1024
CANDIDATES, QUERIES, STEP = 1 << 13, 1 << 10, 64
EXACT = 1 << 53


def padded(column: pa.Array, width: int) -> np.ndarray:
    """A row a vector, with zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


def _safe(*parts: np.ndarray) -> bool:
    """Whether all inner products of the rows are whole numbers that doubles hold exactly."""
    most = max((int(np.abs(x, dtype=np.float64).max(initial=0)) for x in parts), default=0)
    return most * most * max(1, parts[0].shape[1]) < EXACT


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b: doubles where exact, else Python integers."""
    if _safe(a, b):
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


def distances(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared length of every row, distance of every row to every pivot)."""
    x, p = vectors.astype(np.float64), pivots.astype(np.float64)
    length = (x * x).sum(axis=1)
    square = np.stack([((x - y) ** 2).sum(axis=1) for y in p], axis=1) if len(p) else np.zeros((len(x), 0))
    return length, np.sqrt(square)


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows of the sample, each the farthest from those before it, from the longest on."""
    x = sample.astype(np.float64)
    chosen: list[int] = []
    far = (x * x).sum(axis=1)
    while len(chosen) < n and len(x) and (far.max() > 0 or not chosen):
        chosen.append(int(far.argmax()))
        gap = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        far = gap if len(chosen) == 1 else np.minimum(far, gap)
    return sample[chosen]


def search(query: np.ndarray, query_table: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, table: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """(query number, candidate numbers, scores, evaluated) of the best k candidates of a block, for every query.

    ``query_table`` and ``table`` hold squared lengths in the first column, then distances to the pivots; ``own``
    is the row of each query, which is no candidate of its own; ``floor`` is a score that the k-th best reaches
    at least.  A bound is lowered by more than the rounding of the distances before it is used.
    """
    safe = _safe(query, vectors)
    plain = vectors.astype(np.float64) if safe else vectors.astype(object)
    for i in range(len(query)):
        q = query[i].astype(np.float64 if safe else object)
        least = np.abs(table[:, 1:] - query_table[i, 1:]).max(axis=1, initial=0)
        least = np.maximum(least * (1 - 1e-9) - 1e-9 * np.sqrt(query_table[i, 0]), 0)
        both = table[:, 0] + query_table[i, 0]
        bound = (both - least * least) / 2 + 1e-9 * both + 1e-6
        open_ = np.flatnonzero((bound >= floor[i]) & (rows != own[i]))
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        best, score, worst, done, step = np.zeros(0, np.int64), np.zeros(0, plain.dtype), floor[i], 0, STEP
        while done < len(open_) and bound[open_[done]] >= worst:
            part = open_[done : done + step]
            best, score = np.append(best, part), np.append(score, plain[part] @ q)
            order = np.lexsort((rows[best], ids[best], -score))[:k]
            best, score, done, step = best[order], score[order], done + len(part), 2 * step
            if len(best) == k:
                worst = max(floor[i], float(score[-1]))
        yield i, best, score, done


def valid(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows that are null or hold null or non-finite components go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("x").isNotNull())
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return rows.where(~bad).select("vec_id", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))


def top_scores(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score, n_bounded, n_evaluated): the k best other rows for each row whose vec_id is divisible by ``every``.

    Score: inner product of whole numbers, exact; ties to the smaller vec_id.  Fewer than k other rows: all.
    ``n_bounded`` and ``n_evaluated`` say for how many candidates a bound and a score was computed.
    Queries and candidates meet in blocks of QUERIES and CANDIDATES rows, which is all a task holds.
    The pivots come from a sample of SAMPLE rows at most and the k-th best score among them is where
    every search starts; which rows they are changes the work, never the result.

    Repeated rows are rows of their own, each a candidate of the other; a null vec_id is no query and comes last
    among ties; shorter vectors count as filled up with zeros.  Scores beyond 64 bits raise an error.  Empty table: no rows.
    """
    whole = valid(vectors, scale)
    width = whole.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    sample = whole.select("v").orderBy(F.xxhash64("vec_id", "v"), "v").limit(SAMPLE).toArrow()
    chosen = spread_out(padded(sample.column("v"), width.w), pivots)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CANDIDATES):
                part = b.slice(i, CANDIDATES)
                length, far = distances(padded(part.column("v"), width.w), chosen)
                held = np.concatenate([length[:, None], far], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(list(held), pa.list_(pa.float64()))], ["vec_id", "v", "held"])

    # The row number of a checkpointed row stays what it is, also when a later task is run again.
    held = settled(whole.mapInArrow(tabled, "vec_id long, v array<long>, held array<double>").withColumn("row", F.monotonically_increasing_id()))
    blocks, parts = -(-width.n // CANDIDATES) or 1, -(-width.q // QUERIES) or 1
    number = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = held.where(F.col("vec_id") % every == 0).withColumn("part", number(parts, 1)).withColumn("block", every_of(blocks))
    candidates = held.withColumn("block", number(blocks, 2)).withColumn("part", every_of(parts))
    candidates = candidates.select(*[F.col(c).alias(f"c_{c}") for c in ("part", "block", "row", "vec_id", "v", "held")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "row", "vec_id", "score", "n_bounded", "n_evaluated"]
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        query, vectors_ = padded(left.column("v"), width.w), padded(right.column("c_v"), width.w)
        of = lambda t, c: np.stack([np.asarray(x) for x in t.column(c).to_pylist()])
        row, own = right.column("c_row").to_numpy(), left.column("row").to_numpy()
        known = right.column("c_vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        # One pivot may be the query itself, so the (k + 1)-th best of the pivots is reached by k other rows.
        start = np.full(len(query), -np.inf)
        if len(chosen) > k:
            scores = products(query, chosen)
            start = np.array([float(sorted(s)[-k - 1]) for s in scores])
            start -= 1e-9 * np.abs(start)
        out: list[tuple] = [], [], [], [], []
        for i, best, score, done in search(query, of(left, "held"), own, start, vectors_, of(right, "c_held"), row, known, k):
            for held_, x in zip(out, (np.full(len(best), i), best, score, np.full(len(best), len(right)), np.full(len(best), done))):
                held_.append(x)
        i, best, score, bounded, done = (np.concatenate(x) for x in out)
        i, best = i.astype(np.int64), best.astype(np.int64)
        made = pa.array([int(s) for s in score], pa.int64())
        return pa.table([left.column("row").take(i), left.column("vec_id").take(i), right.column("c_row").take(best), right.column("c_vec_id").take(best), made, pa.array(bounded, pa.int64()), pa.array(done, pa.int64())], names)

    schema = "query_row long, query_id long, row long, vec_id long, score long, n_bounded long, n_evaluated long"
    near = queries.groupBy("part", "block").cogroup(candidates.groupBy("c_part", "c_block")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score", "n_bounded", "n_evaluated")
