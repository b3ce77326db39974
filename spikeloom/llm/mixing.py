"""Mixing of sources to target weights: blocks of words, multinomial counts per shard, index permutations.

Everything here is DataFrame functions.  Words are runs of signs other than ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.llm.graph import settled
from spikeloom.operators.skew import salted_join

#: The weights, by rank of the source, and the share of all words to be taken.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, SHARD, STRETCH, BIN_ROWS = 64, 4096, 1024, 65536
#: A word with the white space after it; white space before the first word is a part of its own.
PART = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
GAP = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words: the gaps cut the text, and an edge gap makes an empty piece."""
    pieces = F.size(F.split(text, GAP, -1))
    edges = F.when(text.rlike(f"^{GAP}"), 1).otherwise(0) + F.when(text.rlike(f"{GAP}$"), 1).otherwise(0)
    return F.when(F.length(text) > 0, F.greatest(pieces - edges, F.lit(0))).otherwise(0).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target) from one row per source.

    Sources by code point, null last, weigh 5, 2, 1 in turn.  A target is the least of twice the
    source's size and its weight times the one level at which all targets add up to 150% of all
    words: that is where resharing the excess by weight ends.  The table has one row per source.
    """
    ranked = Window.orderBy(F.col("src").asc_nulls_last())
    place = F.row_number().over(ranked) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("ratio", F.lit(MOST) * F.col("source_size") / F.col("w"))
    after = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    done = F.coalesce(F.sum(F.lit(MOST) * F.col("source_size")).over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(after.rowsBetween(0, Window.unboundedFollowing))
    every = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (F.lit(SHARE) * every - done) / left)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy()))
    return s.select("src", "source_size", F.least(F.lit(MOST) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def _bins(order: Column, rows: int) -> Column:
    """Stretches of a 64-bit hash, about ``BIN_ROWS`` rows each."""
    return F.floor(F.shiftrightunsigned(order, 33) * F.lit(max(1, rows // BIN_ROWS)) / F.lit(1 << 31)).cast("long")


def running(df: DataFrame, group: str, order: list[str], value: Column, name: str, bins: Column) -> DataFrame:
    """Add the sum of ``value`` over earlier rows of the group.

    ``bins`` cuts the order into stretches: rows are summed within (group, stretch) and the
    stretches' totals within the group, so a hot group is not summed in one task.
    """
    df = df.withColumn("_bin", bins).withColumn("_value", value)
    inner = Window.partitionBy(group, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(group, "_bin").agg(F.sum("_value").alias("_sum"))
    outer = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(group, "_bin", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    out = df.withColumn("_within", F.coalesce(F.sum("_value").over(inner), F.lit(0))).join(per, [group, "_bin"])
    return out.withColumn(name, F.col("_before") + F.col("_within")).drop("_bin", "_value", "_before", "_within")


def keyed(documents: DataFrame) -> DataFrame:
    """Documents with a row key: a hash of id, source and text."""
    return documents.withColumn("_mix_key", F.xxhash64("doc_id", "source", F.coalesce("text", F.lit(""))))


def sized(documents: DataFrame) -> DataFrame:
    """_key, _copy (number among equal rows), doc_id, src, sid (source key, never null) and size."""
    sid = F.coalesce(F.concat(F.lit("="), "src"), F.lit("null"))
    rows = keyed(documents).select("_mix_key", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("src"), n_words(F.col("text")).alias("size"))
    return rows.withColumn("sid", sid).withColumn("_mix_copy", F.row_number().over(Window.partitionBy("_mix_key").orderBy("_mix_key")))


def sources(rows: DataFrame) -> DataFrame:
    """One row per source: sid, src, source_size, target, n_blocks, expect (slots it should fill)."""
    per = rows.groupBy("sid").agg(F.first("src").alias("src"), F.sum("size").alias("source_size"))
    goal = targets(per.select("src", "source_size")).select(F.coalesce(F.concat(F.lit("="), "src"), F.lit("null")).alias("sid"), "src", "source_size", "target")
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    expect = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)
    return goal.withColumn("n_blocks", blocks).withColumn("expect", expect)


def pieces(rows: DataFrame, n_rows: int) -> DataFrame:
    """Words packed into blocks: (sid, block, _key, _copy, offset, words) for every document in every block.

    Documents of a source follow each other in hashed order; block b holds its words b * BLOCK to
    (b + 1) * BLOCK - 1, so a document may begin and end within blocks.
    """
    rows = rows.where(F.col("size") > 0).withColumn("_at", F.xxhash64("_mix_key", "_mix_copy"))
    placed = running(rows, "sid", ["_at", "_mix_key", "_mix_copy"], F.col("size"), "start", _bins(F.col("_at"), n_rows))
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / BLOCK).cast("long"), F.floor((end - 1) / BLOCK).cast("long")
    cut = placed.select("sid", "_mix_key", "_mix_copy", "start", end.alias("end"), F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("start", F.col("block") * BLOCK)
    return cut.select(
        "sid", "block", "_mix_key", "_mix_copy", (begin - F.col("start")).alias("offset"), (F.least("end", (F.col("block") + 1) * BLOCK) - begin).alias("words"),
        (begin == F.col("block") * BLOCK).alias("opens"),
    )


def counts(table: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(shard, sid, n): how many slots of each output shard every source fills, and the number of shards.

    Multinomial with the sources' shares, drawn with little noise: of a shard's expected counts the
    whole parts are given and only the remaining slots are drawn from the fractions.  A draw finds
    its source by equi-join on a grid over the cumulated fractions.
    """
    spark = table.sparkSession
    total = table.agg(F.sum("expect").alias("e")).first()["e"] or 0.0
    slots = round(total)
    shards = -(-slots // SHARD)
    if not shards:
        return spark.createDataFrame([], "shard long, sid string, n long"), 0
    tail = slots - (shards - 1) * SHARD
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(z).alias("z")) for k, z in ((0, SHARD), (1, tail))]))
    e = table.select("sid", (F.col("expect") / total).alias("p"), kinds.alias("k")).select("sid", "k.kind", (F.col("p") * F.col("k.z")).alias("e"), "k.z")
    e = e.withColumn("whole", F.floor("e")).withColumn("part", F.col("e") - F.floor("e"))
    before = Window.partitionBy("kind").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("kind")
    e = e.withColumn("hi", F.sum("part").over(before)).withColumn("sum", F.sum("part").over(every)).withColumn("rest", F.col("z") - F.sum("whole").over(every))
    e = settled(e.withColumn("last", F.max("hi").over(every)))
    grid = 1024
    lo, hi = (F.col("hi") - F.col("part")) / F.col("last"), F.col("hi") / F.col("last")
    steps = F.sequence(F.floor(lo * grid).cast("int"), F.least(F.floor(hi * grid).cast("int"), F.lit(grid - 1)))
    spans = e.where(F.col("part") > 0).select("kind", "sid", lo.alias("lo"), F.when(F.col("hi") >= F.col("last"), 2.0).otherwise(hi).alias("hi"), F.explode(steps).alias("cell"))

    shard = spark.range(shards).select(F.col("id").alias("shard"), F.when(F.col("id") == shards - 1, 1).otherwise(0).alias("kind"))
    need = {r["kind"]: int(r["rest"]) for r in e.groupBy("kind").agg(F.max("rest").alias("rest")).collect()}
    rest = F.when(F.col("kind") == 1, need[1]).otherwise(need[0])
    draw = shard.where(rest > 0).select("shard", "kind", F.explode(F.sequence(F.lit(1), rest)).alias("i"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "shard", "i"), 11).cast("double") * F.lit(2.0**-53)
    draw = draw.withColumn("u", unit).withColumn("cell", F.floor(F.col("u") * grid).cast("int"))
    drawn = draw.join(spans, ["kind", "cell"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // STRETCH).cast("long"))).alias("stretch")
    whole = e.where(F.col("whole") > 0).select("sid", "kind", "whole", stretch).repartition("sid", "stretch")
    inside = F.sequence(F.col("stretch") * STRETCH, F.least((F.col("stretch") + 1) * STRETCH, F.lit(shards)) - 1)
    whole = whole.select("sid", "kind", "whole", F.explode(inside.cast("array<bigint>")).alias("shard")).where((F.col("shard") == shards - 1) == (F.col("kind") == 1))
    return drawn.union(whole.select("shard", "sid", F.col("whole").alias("n"))).groupBy("shard", "sid").agg(F.sum("n").alias("n")), shards


def chosen(documents: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, taken): ``taken`` is one row per drawn slot and document in its block.

    Slots of a source are numbered through all shards; slot i takes the block at place i modulo
    the number of blocks in the source's pseudorandom order of blocks, so every block is taken once
    before any is taken again, and none more than ``MOST`` times.
    """
    rows = settled(sized(documents))
    table = settled(sources(rows))
    cut = settled(pieces(rows, rows.count()))
    drawn = settled(counts(table, seed)[0])
    drawn = running(drawn, "sid", ["shard"], F.col("n"), "first", F.floor(F.col("shard") / STRETCH).cast("long"))
    slot = drawn.select("shard", "sid", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    slot = salted_join(slot, table.select("sid", "n_blocks"), ["sid"], F.col("slot")).where(F.col("slot") < F.col("n_blocks") * int(MOST))
    slot = slot.select("sid", "shard", (F.col("slot") % F.col("n_blocks")).alias("place"), F.floor(F.col("slot") / F.col("n_blocks")).alias("pass"))

    blocks = cut.where("opens").select("sid", "block", F.xxhash64(F.lit(seed), "sid", "block").alias("_at"))
    blocks = running(blocks, "sid", ["_at", "block"], F.lit(1), "place", _bins(F.col("_at"), table.agg(F.sum("n_blocks")).first()[0] or 0))
    # Each step is a plan of its own: the driver holds small plans, not one with all their joins.
    taken = settled(settled(slot).join(settled(blocks.select("sid", "place", "block")), ["sid", "place"]).select("sid", "block", "pass"))
    return rows, table, settled(taken.join(cut, ["sid", "block"]).select("_mix_key", "_mix_copy", "pass", "offset", "words"))


def mixed(documents: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for every row.

    Null and empty texts have size 0 and are never taken; a source without words has target 0.
    Sources may be null (one source).  Equal rows are rows of their own.  Empty table: no rows.
    """
    rows, table, taken = chosen(documents, seed)
    per = settled(taken.groupBy("_mix_key", "_mix_copy").agg(F.sum("words").alias("taken")))
    out = rows.join(per, ["_mix_key", "_mix_copy"], "left")
    out = salted_join(out, table.select("sid", "source_size", "target"), ["sid"], F.col("_mix_key"))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as documents: one row for each document and pass, with the words that pass takes.

    A document of which a pass takes all words keeps its text to the sign; else the text holds the
    taken runs of words with the white space after them.  All columns stay; n_chars is the new length.
    """
    rows, _, taken = chosen(documents, seed)
    part = F.struct("offset", "words")
    per = taken.groupBy("_mix_key", "_mix_copy", "pass").agg(F.sort_array(F.collect_list(part)).alias("_mix_parts"), F.sum("words").alias("_mix_n"))
    per = per.join(rows.select("_mix_key", "_mix_copy", "size"), ["_mix_key", "_mix_copy"])
    per = settled(per.select("_mix_key", "_mix_copy", "_mix_parts", (F.col("_mix_n") == F.col("size")).alias("_mix_whole")))
    docs = keyed(documents).withColumn("_mix_copy", F.row_number().over(Window.partitionBy("_mix_key").orderBy("_mix_key")))
    out = docs.join(per, ["_mix_key", "_mix_copy"])
    every = F.regexp_extract_all("text", F.lit(f"({PART})"), F.lit(1))
    lead = F.when(F.col("_mix_parts")[0]["offset"] == 0, F.regexp_extract("text", f"^(?:{GAP})?", 0)).otherwise("")
    # The words are bound once, outside the loop over the runs.
    run = lambda words: F.flatten(F.transform("_mix_parts", lambda p: F.slice(words, (p["offset"] + 1).cast("int"), p["words"].cast("int"))))
    taken_ = F.transform(F.array(every), lambda words: F.array_join(run(words), ""))[0]
    out = out.withColumn("text", F.when(F.col("_mix_whole"), F.col("text")).otherwise(F.concat(lead, taken_)))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
