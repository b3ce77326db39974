"""Near-duplicates by ProbMinHash of weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.graph import components, settled
from spikeloom.llm.text import counted, mix, odd, shingles, slices
from spikeloom.operators.skew import attach, hot_counts

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
FINE, BLOCK = 1024, 512


def registers(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash of ``n`` texts: in each of ``m`` registers the shingle that arrives there first.

    A shingle of weight w arrives again and again after exponential times of rate w, each time at a
    register drawn from its hash.  A shingle is dropped as soon as its next arrival is later than
    the last register of its text was filled (early termination); all texts run in step.
    """
    first = np.full(n * m, np.inf)
    holder = np.zeros(n * m, np.uint64)
    late = np.full(n, np.inf)
    time, step = np.zeros(len(row)), 0
    while len(row):
        draw = mix(shingle + np.uint64((step + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        on = time < late[row]
        row, shingle, weight, time, draw = row[on], shingle[on], weight[on], time[on], draw[on]
        at = row * m + (mix(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        holder[at[won]] = shingle[won]
        touched = np.flatnonzero(np.bincount(row, minlength=n))
        late[touched] = first.reshape(n, m)[touched].max(axis=1)
        step += 1
    return holder.reshape(n, m)


def profile_likeness(a: bytes, b: bytes) -> float:
    """Probability Jaccard of two profiles (sorted shingles, then their weights)."""
    read = lambda p: (np.frombuffer(p, np.uint64, len(p) // 12), np.frombuffer(p, np.uint32, len(p) // 12, len(p) // 12 * 8))
    (da, wa), (db, wb) = read(a), read(b)
    every = np.union1d(da, db)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, da)] = wa
    y[np.searchsorted(every, db)] = wb
    # For a common shingle d: 1 / sum over all e of max(x_e / x_d, y_e / y_d).  The first is larger
    # where y_e / x_e <= y_d / x_d, so sums over the order of these ratios suffice.
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    left, right = np.r_[0, np.cumsum(x[order])], np.r_[0, np.cumsum(y[order])]
    both = (x > 0) & (y > 0)
    k = np.searchsorted(ratio[order], ratio[both], "right")
    return float(np.sum(1.0 / (left[k] / x[both] + (right[-1] - right[k]) / y[both])))


def _texts(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows, data, at in slices(batches):
            for i in range(0, rows.num_rows, 4096):
                part = rows.slice(i, 4096)
                cut = at[i : i + part.num_rows + 1]
                yield part, *counted(*shingles(data[cut[0] : cut[-1]], cut - cut[0], width))

    return each


def sketches(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the profile (d1, d2) and band keys; texts without a word give no row."""
    each = _texts(width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.array([odd(1000 + k) for k in range(rows)])
        for part, row, shingle, weight in each(batches):
            if not len(row):
                continue
            n = part.num_rows
            held = registers(row, shingle, weight, n, bands * rows).reshape(n, bands, rows)
            keys = mix((held * salt).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * odd(3))
            has = np.unique(row)
            first = np.searchsorted(row, has)
            w = weight.astype(np.uint64)
            digest = [np.add.reduceat(mix(shingle * odd(s)) * mix(w + np.uint64(s)), first).view(np.int64) for s in (11, 12)]
            band = pa.ListArray.from_arrays(np.arange(len(has) + 1, dtype=np.int32) * bands, keys[has].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(has)), *map(pa.array, digest), band], ["doc_id", "d1", "d2", "bands"])

    return documents.mapInArrow(task, "doc_id long, d1 long, d2 long, bands array<long>")


def profiles(documents: DataFrame, width: int) -> DataFrame:
    """doc_id and its profile: distinct shingles and their counts."""
    each = _texts(width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, shingle, weight in each(batches):
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            made = [shingle[a:b].tobytes() + weight[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "profile"])

    return documents.mapInArrow(task, "doc_id long, profile binary")


def profiles_of(documents: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Checkpointed profiles of the documents that occur in pairs (u, v)."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    return settled(profiles(documents.join(ids, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]))


def lookalikes(placed: DataFrame, bands: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """(cell, lo, hi, u, v), u < v: members of a cell in different classes whose fine sketches let them be alike.

    ``placed(cell, rep, label)``, ``bands(rep, bands)``: a pair comes out of its first common cell only.  The fine sketch has FINE registers of a byte; pairs are compared
    inside tasks, block against block, and only those within five deviations of the threshold come
    out (a pair at the threshold is lost once in three million times).  A cell of more than BLOCK
    members is cut into blocks, so no task holds more than two of them.
    """
    least = int(FINE * threshold - 5 * (FINE * threshold * (1 - threshold)) ** 0.5)

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                raw = [p.as_py() for p in part.column("profile")]
                n = [len(p) // 12 for p in raw]
                shingle = np.concatenate([np.frombuffer(p, np.uint64, k) for p, k in zip(raw, n)])
                weight = np.concatenate([np.frombuffer(p, np.uint32, k, 8 * k) for p, k in zip(raw, n)])
                held = mix(registers(np.repeat(np.arange(len(n)), n), shingle, weight, len(n), FINE)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in held], pa.binary())], ["rep", "fine"])

    def pairs(cell: int, ids: np.ndarray, label: np.ndarray, own: np.ndarray, band: np.ndarray, sketch: np.ndarray, split: bool) -> Iterator[tuple]:
        for i in range(len(ids)):
            other = np.flatnonzero((label != label[i]) & ((own != own[i]) if split else True) & (np.arange(len(ids)) > i))
            if len(other):
                other = other[band[i][(band[other] == band[i]).argmax(axis=1)] == cell]
                near = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
                yield np.minimum(ids[i], ids[near]), np.maximum(ids[i], ids[near])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _and_end(batches):
            if b is not None:
                held.append(b)
            rows = pa.Table.from_batches(held).combine_chunks() if held else None
            if rows is None or not len(rows):
                continue
            key = np.stack([rows.column(c).to_numpy() for c in ("cell", "lo", "hi")])
            edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            stop = np.r_[edge[1:], len(rows)]
            if b is not None:  # the last group may go on
                edge, stop = edge[:-1], stop[:-1]
            ids, label, own = (rows.column(c).to_numpy() for c in ("rep", "label", "own"))
            sketch = np.frombuffer(b"".join(x.as_py() for x in rows.column("fine")), np.uint8).reshape(-1, FINE)
            band = np.asarray(pa.concat_arrays(rows.column("bands").chunks).flatten()).reshape(len(rows), -1)
            found = [(*key[:, [x] * len(u)], u, v) for x, y in zip(edge, stop) if y - x > 1 for u, v in pairs(key[0, x], ids[x:y], label[x:y], own[x:y], band[x:y], sketch[x:y], key[1, x] != key[2, x])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["cell", "lo", "hi", "u", "v"])
            held = rows.slice(stop[-1] if len(stop) else 0).to_batches() if b is not None else []

    size = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    size = size.select("cell", F.ceil(F.col("_n") / BLOCK).cast("int").alias("k"), "_n")
    rows = attach(placed, size.select("cell", "k"), ["cell"], F.col("rep"), hot=hot_counts(size.select("cell", "_n"), ["cell"]))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    rows = rows.join(made.select("doc_id", "profile").mapInArrow(fine, "rep long, fine binary").join(bands, "rep"), "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "label", "bands", "fine")
    return rows.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(compare, "cell long, lo long, hi long, u long, v long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def verified(pairs: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """(u, v, likeness) of those pairs whose profiles' probability Jaccard reaches the threshold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            likeness = np.array([profile_likeness(x.as_py(), y.as_py()) for x, y in zip(b.column("pu"), b.column("pv"))], np.float64)
            on = pa.array(np.flatnonzero(likeness >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column("u").take(on), b.column("v").take(on), pa.array(likeness).take(on)], ["u", "v", "likeness"])

    left = attach(pairs, made.toDF("u", "pu"), ["u"], F.col("v"))
    full = attach(left, made.toDF("v", "pv"), ["v"], F.col("u"), hot=hot_counts(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("_n")), ["v"]))
    return full.select("u", "v", "pu", "pv").mapInArrow(task, "u long, v long, likeness double")


def verified_in_blocks(pairs: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """As ``verified``, for ``pairs(cell, lo, hi, u, v)``: a profile comes once to each block of pairs, not to each pair."""
    block = ["cell", "lo", "hi"]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        profile = dict(zip(right.column("doc_id").to_pylist(), right.column("profile").to_pylist()))
        u, v = left.column("u").to_pylist(), left.column("v").to_pylist()
        likeness = np.array([profile_likeness(profile[x], profile[y]) for x, y in zip(u, v)], np.float64)
        on = np.flatnonzero(likeness >= threshold - 1e-12)
        return pa.table({"u": pa.array([u[i] for i in on], pa.int64()), "v": pa.array([v[i] for i in on], pa.int64()), "likeness": pa.array(likeness[on])})

    ends = pairs.select(*block, F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    known = ends.join(made, "doc_id").select(*[F.col(c).alias(f"r_{c}") for c in block], "doc_id", "profile")
    return pairs.groupBy(*block).cogroup(known.groupBy(*[f"r_{c}" for c in block])).applyInArrow(task, "u long, v long, likeness double")


def near_duplicates(documents: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_verified) for every doc_id of ``documents(doc_id, text)``; see ``classes`` for the method.

    Rows that share a doc_id are one document with several texts: each text is compared on its own, and the
    classes of all its texts are one.  ``class_id`` is the least doc_id of the class.
    Rows without a doc_id give none.  Empty table: no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text")).where(F.col("doc_id").isNotNull())
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.groupBy("doc_id").agg(F.min(mark).alias("_one"), F.max(mark).alias("_two")).where("_one <> _two")
    several = settled(several.select("doc_id", "_one"))
    options = {"width": width, "threshold": threshold, "bands": bands, "rows": rows}
    if several.isEmpty():
        return classes(docs, **options)
    # Further texts of a document go under numbers of their own; its texts meet again by its doc_id.
    own = F.when(F.col("_one") != mark, F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    texts = docs.join(several, "doc_id", "left").select("doc_id", own.alias("node"), "text")
    found = settled(classes(texts.select(F.col("node").alias("doc_id"), "text"), **options).toDF("node", "class", "n_verified"))
    held = settled(texts.select("doc_id", "node").distinct().join(found, "node"))
    meet = held.join(several, "doc_id", "left_semi").select("doc_id", "class")
    meet = attach(meet, meet.groupBy("doc_id").agg(F.min("class").alias("first")), ["doc_id"], F.col("class"))
    label = components(meet.select(F.col("first").alias("u"), F.col("class").alias("v"))).toDF("class", "label")
    held = settled(held.join(label, "class", "left").withColumn("label", F.coalesce("label", "class")))
    least = held.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    per = held.groupBy("doc_id").agg(F.min("label").alias("label"), F.sum("n_verified").alias("n_verified"))
    return attach(per, least, ["label"], F.col("doc_id")).select("doc_id", "class_id", "n_verified")


def classes(docs: DataFrame, width: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """(doc_id, class_id, n_verified) for every doc_id of ``docs(doc_id, text)``, one text a doc_id.

    Documents with equal profiles are one representative.  Band collisions are compared with one
    document of their bucket first, that with most company in all its buckets; only members of a
    bucket that are then still in different classes are compared further, and of these only
    pairs whose finer sketches let them reach the threshold.  So a
    large group of copies costs one comparison a copy.
    With 24 bands of 4 registers a pair of likeness 0.8 is missed once in 300,000 times.

    ``class_id`` is the least doc_id of the class; ``n_verified`` counts the links to other
    representatives that were verified on the way to the classes, not all links at the threshold:
    it depends on which documents lead their buckets (copies of a representative share its count).  A text without a word (null, empty, white space) is like no other.
    """
    sketch = settled(sketches(docs, width, bands, rows))
    reps = settled(sketch.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))
    member = attach(sketch.select("doc_id", "d1", "d2"), reps.select("d1", "d2", "rep"), ["d1", "d2"], F.col("doc_id")).select("doc_id", "rep")
    member = settled(member)

    cells = reps.select("rep", F.explode("bands").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    # Most cells are lone, and this join drops them first; adaptive execution splits a hot cell here.
    shared = settled(cells.join(sizes, "cell"))
    shared = shared.join(shared.groupBy("rep").agg(F.sum("_n").alias("company")), "rep")
    lead = shared.groupBy("cell").agg(F.max(F.struct("company", -F.col("rep"))).alias("m"), F.max("_n").alias("_n")).select("cell", (-F.col("m.col2")).alias("lead"), "_n")
    stars = attach(shared.select("cell", "rep"), lead.select("cell", "lead"), ["cell"], F.col("rep"), hot=hot_counts(lead.select("cell", "_n"), ["cell"]))
    stars = settled(stars.where(F.col("lead") != F.col("rep")).select(F.least("lead", "rep").alias("u"), F.greatest("lead", "rep").alias("v")).distinct())
    made = profiles_of(docs, stars, width)
    links = settled(verified(stars, made, threshold))

    label = components(links.select("u", "v"))
    placed = shared.select("cell", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("cell", "rep", F.coalesce("label", "rep").alias("label"))
    placed = settled(placed)
    apart = placed.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("cell")
    placed = settled(placed.join(apart, "cell", "left_semi"))
    rest = lookalikes(placed, reps.select("rep", "bands"), made, threshold)
    rest = settled(rest.join(stars, ["u", "v"], "left_anti"))
    links = settled(links.union(verified_in_blocks(rest, made, threshold)))

    exact = member.where(F.col("doc_id") != F.col("rep")).toDF("u", "v")
    label = components(links.select("u", "v").union(exact))
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_verified"))
    counts = member.join(degree, "rep", "left").groupBy("doc_id").agg(F.sum("n_verified").alias("n_verified"))
    ids = docs.select("doc_id").distinct()
    out = ids.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One row of each class, with all columns: that of the least doc_id, and of its rows that of the least text.

    Rows without a doc_id are in no class and stay.
    """
    gone = near_duplicates(documents, **options).where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone"))
    rest = documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
    again = documents.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    again = settled(again.select("_again"))
    if again.isEmpty():
        return rest
    on = documents["doc_id"] == again["_again"]
    one = rest.join(again, on, "left_semi").groupBy(documents["doc_id"].alias("_again")).agg(F.min_by(F.struct(*documents.columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*documents.columns))).alias("_row"))
    return rest.join(again, on, "left_anti").unionByName(one.select("_row.*"))
