"""Prefix trie of conversations by whole-sequence collapse.

Identical rebuilt conversations become one weighted sequence with the list of those that end there.
Sequences that are proper prefixes of others go by an anti-join, which leaves the leaves.  Every
node is a prefix of weighted sequences: its members, leaves and savings are sums over the distinct
sequences through it, each of which comes once, however many copies it stands for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.graph import settled
from spikeloom.operators.ordered import in_order
from spikeloom.operators.skew import attach

GROUP, HEADS, STRETCH = 100, 6, 1 << 12
SUMS = ["s1", "s2", "s3", "s4"]
KEY = ["depth", *SUMS]


class Trie(NamedTuple):
    """``nodes`` and the conversations that end in each, ``ends(depth, s1..s4, conv_id)``."""

    nodes: DataFrame
    ends: DataFrame


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, index, role, text): turns by turn, null first, numbered from 0; ties by role, then text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("_at", F.coalesce("turn", F.lit(-(1 << 62)))).drop("turn")
    return in_order(rows, ["conv_id"], "_at", STRETCH, tie=["role", "text"], index="index").drop("_at")


def heads(conv: str | Column = "conv_id") -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    conv = F.col(conv) if isinstance(conv, str) else conv
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns(conv_id, depth, role, text), ids(conv_id)) of conversations that begin as the first of their hundred does.

    Conversation c takes the first h turns of conversation c - c % 100, all if it has fewer and none if there is
    no such one, then its own turns after its first h; h = crc32(decimal c) % 6 (% as in SQL, with the sign of c).  A head is shared by at
    most 100 conversations, so its copies are bounded.
    """
    turns = settled(turns_of(conversations))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    ids = settled(sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), heads().alias("h")))
    ids = settled(ids.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").withColumn("lent", F.least("h", F.coalesce("n", F.lit(0)))).drop("n"))
    first = turns.where(F.col("index") < HEADS - 1).select(F.col("conv_id").alias("base"), "index", "role", "text")
    head = ids.join(first, "base").where(F.col("index") < F.col("h")).select("conv_id", (F.col("index") + 1).alias("depth"), "role", "text")
    own = attach(turns, ids.select("conv_id", "h", "lent"), ["conv_id"], F.col("index")).where(F.col("index") >= F.col("h"))
    own = own.select("conv_id", (F.col("lent") + F.col("index") - F.col("h") + 1).alias("depth"), "role", "text")
    return head.union(own), ids.select("conv_id")


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, s1..s4, p1..p4, size): a row for every prefix of every conversation, from the empty one.

    ``s1`` to ``s4`` are sums of 32-bit parts of md5 digests of (depth, role, text) over the prefix: together
    they name it, and the parts ``p1`` to ``p4`` of its last turn lead back to its parent.
    """
    digest = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "text").cast("binary"))
    part = lambda i: F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"p{i + 1}")
    rows = turns.select("conv_id", F.col("depth").cast("long"), F.length("text").cast("long").alias("size"), digest.alias("_d"))
    rows = rows.select("conv_id", "depth", "size", *[part(i) for i in range(4)])
    rows = in_order(rows, ["conv_id"], "depth", STRETCH, running={s: F.col(s.replace("s", "p")) for s in SUMS})
    zero = [F.lit(0).cast("long").alias(c) for c in (*KEY, "p1", "p2", "p3", "p4", "size")]
    columns = ["conv_id", *KEY, "p1", "p2", "p3", "p4", "size"]
    return rows.select(columns).union(ids.select("conv_id", *zero))


def trie(turns: DataFrame, ids: DataFrame) -> Trie:
    """The trie of the sequences ``turns(conv_id, depth, role, text)``, depth from 1, of the conversations ``ids``.

    Nodes: key (depth, s1..s4), conv_id (the least member), parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens.  Conversations without a turn end in the root.  No conversations: no rows.
    """
    rows = settled(prefixes(turns, ids))
    # Whole sequences: identical ones become one, named by the least of its conversations.
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k")).select("conv_id", "k.*")
    ends = settled(last.select(*KEY, "conv_id"))
    sequences = settled(ends.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    kept = rows.withColumnRenamed("conv_id", "rep")
    paths = settled(attach(kept, sequences.select("rep", "weight", F.col("depth").alias("_end")), ["rep"], F.col("depth")))
    # What is a proper prefix of another sequence is no leaf.
    proper = paths.where(F.col("depth") < F.col("_end")).select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    weights = sequences.select("rep").join(leaves, "rep", "left").select("rep", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    paths = paths.drop("_end")
    spread = F.col("depth")
    marked = attach(paths, weights, ["rep"], spread)
    nodes = marked.groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), *[F.first(c).alias(c) for c in ("p1", "p2", "p3", "p4", "size")]
    )
    nodes = settled(nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("size")))
    # A sequence owns the nodes of which it is the least member: the tail of its path.  The nodes below a node
    # are all that the sequences through it own, but for what its own owner owns above it.
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.sum("saving").alias("owned"))
    through = attach(paths.select("rep", *KEY), owned, ["rep"], spread).groupBy(*KEY).agg(F.sum("owned").alias("owned"))
    above = in_order(nodes.select("conv_id", *KEY, "saving"), ["conv_id"], "depth", STRETCH, running={"upto": F.col("saving")})
    saved = through.join(above, KEY).select(*KEY, (F.col("owned") - F.col("upto") + F.col("saving")).alias("saved_tokens"))

    parent = [(F.col("depth") - 1).alias("u0"), *[(F.col(f"s{i}") - F.col(f"p{i}")).alias(f"u{i}") for i in range(1, 5)]]
    up = [f"u{i}" for i in range(5)]
    named = nodes.select("conv_id", *KEY, "n_convs", "n_leaves", *parent)
    children = named.where(F.col("depth") > 0).groupBy(*up).agg(F.count(F.lit(1)).alias("n_children")).toDF(*KEY, "n_children")
    whose = nodes.select(*[F.col(k).alias(u) for k, u in zip(KEY, up)], F.col("conv_id").alias("parent_conv_id"))
    below = attach(named.where(F.col("depth") > 0), whose, up, F.col("s1"))
    columns = ["conv_id", *KEY, "n_convs", "n_leaves", "parent_conv_id"]
    both = below.select(columns).union(named.where(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    full = both.join(children, KEY, "left").join(saved, KEY)
    return Trie(full.select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens"), ends)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, s1..s4, ends_sha256): SHA-256 of the ascending conv_ids of every end list, joined by commas.

    The ids of a node stream through its digest in order, so a list of any length takes no memory; the digest of
    one list is sequential by its nature and stays in one task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            keys, sums = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*keys)], pa.array(sums, pa.string())], [*KEY, "ends_sha256"])

        for b in batches:
            keys = zip(*[b.column(k).to_pylist() for k in KEY])
            for key, text in zip(keys, pc.cast(b.column("conv_id"), pa.string()).to_pylist()):
                if key == now:
                    digest.update(b"," + text.encode())
                    continue
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(text.encode())
            if len(done) >= 4096:
                yield out()
        if digest is not None:
            done.append((now, digest.hexdigest()))
        if done:
            yield out()

    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(task, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of ``conversations(conv_id, turn, role, text)`` after rebuilding; see ``rebuilt`` and ``trie``.

    Turns are ordered by turn, null first, ties by role and text; a repeated turn is a turn of its own.  Null role or
    text is empty; a null conv_id is no conversation.  Other columns are left out.  A conversation of any length is
    cut into stretches, never held in one row.
    """
    return trie(*rebuilt(conversations))
