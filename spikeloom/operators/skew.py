"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 256


def hot_keys(df: DataFrame, on: Sequence[str], share: int = SHARE) -> DataFrame:
    """Keys holding more than 1/share of all rows, with the number of splits each needs.

    At most ``share`` keys can do so, whatever the size of the data, which is the size
    bound that makes broadcasting this table safe.
    """
    return hot_counts(df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on, share)


def hot_counts(counts: DataFrame, on: Sequence[str], share: int = SHARE) -> DataFrame:
    """The same from a table of rows per key (``_n``) that exists already."""
    total = counts.agg(F.sum("_n").alias("_rows")).scalar()
    share_of = counts.withColumn("_rows", total).where(F.col("_n") * F.lit(share) > F.col("_rows"))
    return share_of.select(*on, F.ceil(F.col("_n") * F.lit(share) / F.col("_rows")).cast("int").alias("_splits"))


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "inner",
    share: int = SHARE,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that splits hot keys of ``many`` and copies only the matching rows of ``few``.

    ``spread`` is any expression that varies among rows of one key.  ``hot`` may bring the hot
    keys of a table with the same rows per key when ``many`` is expensive to count.
    """
    hot = F.broadcast(hot_keys(many, on, share) if hot is None else hot)
    left = many.join(hot, list(on), "left").withColumn(
        "_salt", F.when(F.col("_splits").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), "_splits")).cast("int")
    )
    right = few.join(hot, list(on), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
    )
    return left.drop("_splits").join(right.drop("_splits"), [*on, "_salt"], how).drop("_salt")


def attach(
    many: DataFrame, per_key: DataFrame, on: Sequence[str], spread: Column | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """Add the columns of a one-row-per-key table to rows of which a few keys may own most.

    A plain join here would send a hot key to one task, and a later aggregate on the same key
    keeps adaptive execution from splitting it.
    """
    return salted_join(many, per_key, on, F.struct(*many.columns) if spread is None else spread, hot=hot)


def spread_out(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows dealt by key to as many tasks as a shuffle has partitions.

    For work that is long for few bytes, as fits of small curves are: adaptive execution joins partitions by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
