"""Ordered-sequence operators that never put one whole sequence in one task.

A unit, channel or recording can hold a large share of all rows, so a plain
``lag() OVER (PARTITION BY unit ORDER BY t)`` would send that share to one task.
Here every sequence is cut into fixed stretches of its order key.  Rows are
windowed inside ``(keys, stretch)``; what crosses a stretch border (the last row,
the first row, running totals) travels through a summary with one row per
stretch, which is aggregated map-side before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG = "_seg"


def stretch(t: str | Column, length: int | float) -> Column:
    """Number of the stretch a position falls in."""
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(length)).cast("bigint")


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    length: int | float,
    *,
    tie: Sequence[str] = (),
    lag: Mapping[str, str | Column] | None = None,
    lag2: Mapping[str, str | Column] | None = None,
    lead: Mapping[str, str | Column] | None = None,
    index: str | None = None,
    running: Mapping[str, Column] | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add neighbour values, 0-based positions, running sums and counts in one pass.

    ``lag``/``lag2``/``lead`` map new columns to the value one row back, two rows back or
    one row ahead.  ``running`` maps new columns to a numeric expression summed up to and
    including the row; it may use the lag columns, so runs can be numbered without a second
    pass.  ``index`` names the position column and ``total`` the row count of the sequence.
    """
    lag, lag2, lead, running = dict(lag or {}), dict(lag2 or {}), dict(lead or {}), dict(running or {})
    rank = F.struct(t, *tie)
    row = lambda m: F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in m.items()])
    zero = lambda c: F.coalesce(c, F.lit(0))
    cell = [*keys, SEG]
    w = Window.partitionBy(*cell).orderBy(t, *tie)

    inner = [F.row_number().over(w).alias("_pos")]
    if lag:
        inner.append(F.lag(row(lag)).over(w).alias("_prev"))
    if lag2:
        inner += [F.lag(row(lag2)).over(w).alias("_prev1"), F.lag(row(lag2), 2).over(w).alias("_prev2")]
    if lead:
        inner.append(F.lead(row(lead)).over(w).alias("_next"))
    d = df.withColumn(SEG, stretch(t, length)).select("*", *inner)
    if running:
        # The first row of a stretch is settled below, where the row before it is known.
        seen = d.withColumns({**{k: F.col("_prev")[k] for k in lag}, **{k: F.col("_prev2")[k] for k in lag2}})
        seen = seen.withColumns({f"_x_{k}": F.when(F.col("_pos") == 1, 0).otherwise(v) for k, v in running.items()})
        d = seen.drop(*lag, *lag2).withColumns(
            {f"_r_{k}": zero(F.sum(f"_x_{k}").over(w.rowsBetween(Window.unboundedPreceding, 0))) for k in running}
        )

    aggs = [F.count(F.lit(1)).alias("_n")]
    if lag:
        aggs.append(F.max_by(row(lag), rank).alias("_tail"))
    if lag2:
        aggs += [F.max_by(row(lag2), rank).alias("_tail1"), F.max_by("_prev1", rank).alias("_tail2")]
    if lead:
        aggs.append(F.min_by(row(lead), rank).alias("_head"))
    if running:
        aggs.append(F.min_by(F.struct(*df.columns), rank).alias("_first"))
    aggs += [F.sum(f"_x_{k}").alias(f"_sum_{k}") for k in running]
    summary = d.groupBy(*cell).agg(*aggs)

    along = Window.partitionBy(*keys).orderBy(SEG)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried, first = [], {}
    if lag:
        carried.append(F.lag("_tail").over(along).alias("_before"))
    if lag2:
        carried += [
            F.lag("_tail1").over(along).alias("_before1"),
            F.coalesce(F.lag("_tail2").over(along), F.lag("_tail1", 2).over(along)).alias("_before2"),
        ]
    if lead:
        carried.append(F.lead("_head").over(along).alias("_after"))
    if index:
        carried.append(zero(F.sum("_n").over(before)).alias("_base"))
    if total:
        carried.append(F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    borders = summary.select("*", *carried)
    if running:
        head = borders.select(
            *[c for c in borders.columns if c not in df.columns],
            "_first.*",
            *[F.col("_before")[k].alias(k) for k in lag],
            *[F.col("_before2")[k].alias(k) for k in lag2],
        )
        head = head.withColumns({f"_f_{k}": zero(v) for k, v in running.items()})
        borders = head.withColumns(
            {f"_b_{k}": zero(F.sum(zero(F.col(f"_sum_{k}")) + F.col(f"_f_{k}")).over(before)) for k in running}
        )
    keep = ["_before", "_before1", "_before2", "_after", "_base", "_total"]
    keep += [f"_f_{k}" for k in running] + [f"_b_{k}" for k in running]
    borders = borders.select(*cell, *[c for c in keep if c in borders.columns])

    j = d.join(borders, cell)
    out = [F.col(c) for c in df.columns]
    out += [F.coalesce("_prev", "_before")[k].alias(k) for k in lag]
    two_back = F.coalesce(F.col("_prev2"), F.when(F.col("_pos") == 2, F.col("_before1")), F.col("_before2")) if lag2 else None
    out += [two_back[k].alias(k) for k in lag2]
    out += [F.coalesce("_next", "_after")[k].alias(k) for k in lead]
    if index:
        out.append((F.col("_base") + F.col("_pos") - 1).cast("bigint").alias(index))
    out += [(F.col(f"_b_{k}") + F.col(f"_f_{k}") + F.col(f"_r_{k}")).alias(k) for k in running]
    if total:
        out.append(F.col("_total").alias(total))
    return j.select(*out)


def with_reach(
    df: DataFrame, keys: Sequence[str], t: str, length: int | float, before: int | float, after: int | float
) -> DataFrame:
    """Copy each row into every stretch whose rows can see it.

    A row at ``p`` is visible from positions ``[p - after, p + before]``: ``before`` is
    how far a row looks back and ``after`` how far it looks ahead.  ``_own`` marks the
    one copy in the row's own stretch.
    """
    lo = stretch(F.col(t) - F.lit(after), length)
    hi = stretch(F.col(t) + F.lit(before), length)
    own = stretch(t, length)
    return df.withColumn(SEG, F.explode(F.sequence(lo, hi))).withColumn("_own", F.col(SEG) == own)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    length: int | float,
    before: int | float,
    after: int | float,
    exprs: Mapping[str, object],
    tie: Sequence[str] = (),
    by: str = "rows",
) -> DataFrame:
    """Moving aggregates over ``[t - before, t + after]``.

    ``exprs`` maps a new column to a function of the window spec.  With ``by="rows"``
    the order key must be a dense index (one row per position), which makes a row
    frame equal to a range frame.
    """
    d = with_reach(df, keys, t, length, before, after)
    w = Window.partitionBy(*keys, SEG).orderBy(t, *tie)
    frame = w.rowsBetween(-before, after) if by == "rows" else w.rangeBetween(-before, after)
    d = d.select("*", *[f(frame).alias(k) for k, f in exprs.items()])
    return d.where("_own").drop(SEG, "_own")


def run_number(starts: Column) -> Column:
    """Term whose running sum numbers maximal runs; ``starts`` is true on the first row of each."""
    return F.when(starts, 1).otherwise(0).cast("bigint")
