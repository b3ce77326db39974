"""SentencePiece encoding and decoding on a lattice of pieces.

``encoded_relational`` builds the lattice as a relation and folds it with higher-order functions;
the pipeline uses it. ``encoded`` searches the same lattice inside tasks, at about a third of the cost, for ``op5_sentencepiece``.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.text import slices

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
CHUNK_BYTES, MEMORY = 8 << 20, 250_000
#: Fixed values of the model format: kinds of pieces, and the penalty of an unknown sign below the least score.
NORMAL, USER, BYTE, UNKNOWN_PENALTY = 1, 4, 6, 10.0


class Vocabulary:
    """Pieces, scores and kinds of a model file; a vocabulary is at most a few hundred thousand rows."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation and kept white space are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.edges = [(p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)]
        self.least = min((s for _, _, s in self.edges), default=0.0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.longest = max((len(p) for p, _, _ in self.edges), default=1)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(self.pieces, kinds)]
        joined = {c for p, _, _ in self.edges if len(p) > 1 for c in p}
        #: ASCII signs that no longer piece holds: the text can be cut around them.
        self.lone = [chr(c) for c in range(128) if chr(c) not in joined]
        #: Whether a space mark occurs behind another sign of a piece, so that no cut before it is safe.
        self.inner = any(SPACE in p.lstrip(SPACE) for p, _, _ in self.edges)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score), the relation that substrings are joined to."""
        return spark.createDataFrame(self.edges, "piece string, id int, score double")


def units(text: Column, vocabulary: Vocabulary) -> Column:
    """The text with space marks, cut where no piece can reach across."""
    marked = F.replace(text, F.lit(" "), F.lit(SPACE))
    if vocabulary.prefix:
        marked = F.concat(F.lit(SPACE), marked)
    cuts = [] if vocabulary.inner else [f"(?<=[^{SPACE}])(?={SPACE})"]
    if vocabulary.lone:
        lone = "[" + "".join(f"\\x{ord(c):02x}" for c in vocabulary.lone) + "]"
        cuts += [f"(?<={lone})(?!^)", f"(?<!^)(?={lone})"]
    whole = F.split(marked, "|".join(cuts), -1) if cuts else F.array(marked)
    return F.when(F.length(text) > 0, F.filter(whole, lambda u: u != "")).otherwise(F.array().cast("array<string>"))


def viterbi(edges: Column, n: Column, most: int) -> Column:
    """Edges (score, start, id) of the best path over ``edges`` (stop, start, score, id), sorted, at most ``most`` to a stop.

    A fold over the places, each some edge's stop, keeps the best edge to each with the score of the
    path there; ties go to the edge that starts first.  A second fold reads the path off backwards.
    """
    kind = "struct<score:double,start:int,id:int>"
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-1).alias("id")).cast(kind))
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def step(edges: Column, s: Column, i: Column) -> Column:
        def onward(here: Column) -> Column:
            ways = F.transform(here, lambda e: F.struct((s["best"][e["start"]]["score"] + e["score"]).alias("score"), (-e["start"]).alias("start"), e["id"].alias("id")))
            best = F.transform(F.array(F.array_max(ways)), lambda w: F.struct(w["score"].alias("score"), (-w["start"]).alias("start"), w["id"].alias("id")))
            return F.struct(F.concat(s["best"], best).alias("best"), (s["next"] + F.size(here)).alias("next"))

        return let(F.filter(F.slice(edges, s["next"], F.lit(most)), lambda e: e["stop"] == i), onward)

    start = F.struct(origin.alias("best"), F.lit(1).alias("next"))
    # Bound once: Spark would put the whole expression of the edges into the fold and sort them again for each place.
    best = let(edges, lambda edges: F.aggregate(F.sequence(F.lit(1), n), start, lambda s, i: step(edges, s, i), lambda s: s["best"]))
    read = lambda best: F.aggregate(
        F.sequence(n, F.lit(1), F.lit(-1)),
        F.struct(n.alias("at"), F.array().cast(f"array<{kind}>").alias("path")),
        lambda s, i: F.when(s["at"] == i, F.struct(best[i]["start"].alias("at"), F.concat(s["path"], F.array(best[i])).alias("path"))).otherwise(s),
        lambda s: s["path"],
    )
    return F.reverse(let(best, read))


def lattice(words: DataFrame, keys: list[str], vocabulary: Vocabulary) -> DataFrame:
    """``words(*keys, unit)``, distinct, with ``ids``: substrings of bounded length, equi-joined to the pieces.

    The piece table is broadcast: its size is that of the vocabulary file.  A sign that is no piece
    is an edge of its own: its UTF-8 bytes as byte pieces, or the unknown piece without these.
    """
    # Outer: a filter on the arrays, which Spark would infer and push below the exchange of the units, keeps that from being shared.
    cut = words.select(*keys, "unit", F.explode_outer(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start"))
    longest = F.least(F.lit(vocabulary.longest), F.length("unit") - F.col("start"))
    cut = cut.select(*keys, "unit", "start", F.explode_outer(F.sequence(F.lit(1), longest)).alias("k"))
    cut = cut.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("k"))).withColumn("_key", F.xxhash64("piece"))
    # Joined by a hash, a long being quicker to look up than a string; the pieces are compared behind it.
    table = vocabulary.table(words.sparkSession).select(F.xxhash64("piece").alias("_key"), F.col("piece").alias("_piece"), "id", "score")
    same = F.col("piece") == F.col("_piece")
    hit = cut.join(F.broadcast(table), "_key", "left").select(*keys, "unit", "start", "k", F.when(same, F.col("id")).alias("id"), F.when(same, F.col("score")).alias("score"))
    hit = hit.where(F.col("id").isNotNull() | (F.col("k") == 1))
    # A sign without a piece is edge -1 here and spelled out once the best path is known.
    score = F.coalesce("score", F.lit(vocabulary.least - UNKNOWN_PENALTY))
    edge = F.struct((F.col("start") + F.col("k")).alias("stop"), "start", score.alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    edges = hit.groupBy(*keys, "unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    path = edges.select(*keys, "unit", viterbi(F.col("edges"), F.length("unit"), vocabulary.longest).alias("path"))
    known = F.array(*[F.lit(vocabulary.bytes.get(b, 0)) for b in range(256)])

    def spelled(e: Column) -> Column:
        if not vocabulary.bytes:
            return F.array(F.lit(0))
        code = F.hex(F.encode(F.substring("unit", e["start"] + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.element_at(known, F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + 1))

    whole = F.forall("path", lambda e: e["id"] >= 0)
    ids = F.when(whole, F.col("path.id")).otherwise(F.flatten(F.transform("path", lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(spelled(e)))))
    return path.select(*keys, "unit", ids.alias("ids"))


def decoded(ids: pa.ListArray, raw: list[bytes], prefix: bool) -> pa.Array:
    """Text of every list of ids: the bytes of the pieces, less the space that encoding put in front."""
    parts = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), pa.array(raw, pa.large_binary()).take(ids.values))
    whole = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
    return pc.binary_replace_slice(whole, 0, 1, b"") if prefix else whole


def encoded_relational(documents: DataFrame, model: str = MODEL, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """As ``encoded``, on the lattice as a relation.

    Rows are dealt to chunks of about ``chunk_bytes`` of text by a hash.  The distinct units of all
    chunks, runs that no piece can cross, go to one task each, are encoded on the lattice once and
    return to every chunk they occur in; the text itself is shuffled once.  Chunks bound what a task
    holds; a single longer text is a chunk of its own size.
    """
    vocabulary = Vocabulary(model)
    documents = documents.drop("ids", "n_tokens", "decoded_ok")
    names = documents.columns
    docs = documents
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    chunks = max(1, -(-total // chunk_bytes))
    docs = docs.withColumn("_chunk", F.pmod(F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")]), F.lit(chunks)))
    docs = docs.repartition(max(chunks, 1), "_chunk")
    # Naming every column here, without effect, lets both branches read the one exchange of the text.
    nothing = F.substring(F.xxhash64(*[c for c, t in documents.dtypes if not t.startswith("map")]).cast("string"), 1, 0)
    cut = docs.select(F.col("_chunk").alias("_book"), units(F.concat("text", nothing), vocabulary).alias("units"))
    # A unit goes to one task, with the chunks it occurs in, and its lattice is searched once, however many they are.
    parts = max(2 * chunks, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut.select("_book", F.explode_outer("units").alias("unit")).where(F.col("unit").isNotNull()).distinct()
    found = found.repartition(parts, "unit").withColumn("_hash", F.xxhash64("unit"))
    # The least chunk is there to let both sides of the join read the one exchange of the units.
    words = found.groupBy("_hash", "unit").agg(F.min("_book").alias("_least"))
    book = found.join(lattice(words, ["_hash", "_least"], vocabulary), ["_hash", "unit"]).where("coalesce(_least <= _book, true)").select("_book", "unit", "ids")
    rows = docs.withColumn("_units", units(F.col("text"), vocabulary))
    raw, prefix = vocabulary.raw, vocabulary.prefix
    schema = T.StructType([*documents.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_ok", T.BooleanType())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
        at, lists = one(left.column("_units")), one(right.column("ids"))
        got = lists.take(pc.index_in(at.flatten(), value_set=one(right.column("unit"))))
        ends = np.r_[0, np.cumsum(pc.list_value_length(got).to_numpy(zero_copy_only=False).astype(np.int64))] if len(got) else np.zeros(1, np.int64)
        first = np.asarray(at.offsets) - at.offsets[0].as_py()
        offsets = ends[first]
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), got.flatten())
        text = pc.fill_null(one(left.column("text")).cast(pa.binary()).cast(pa.large_binary()), b"")
        ok = pc.equal(decoded(ids, raw, prefix), text)
        out = [left.column(c) for c in names] + [ids, pa.array(np.diff(offsets)), ok]
        return pa.Table.from_arrays(out, names=[*names, "ids", "n_tokens", "decoded_ok"])

    return rows.groupBy("_chunk").cogroup(book.groupBy("_book")).applyInArrow(task, schema)


def trie(edges: list[tuple[str, int, float]]) -> dict:
    """Pieces by their signs: a sign leads to [score, id, signs that follow], without a score where no piece ends."""
    root: dict = {}
    for piece, i, score in edges:
        at = root
        for sign in piece[:-1]:
            at = at.setdefault(sign, [None, -1, {}])[2]
        at.setdefault(piece[-1], [None, -1, {}])[:2] = score, i
    return root


def best_path(unit: str, root: dict, least: float, known: dict[int, int]) -> array:
    """Piece ids of the best segmentation of a unit: the lattice and the fold of ``viterbi`` in one task.

    From each place the lattice's edges are read off the trie of pieces, sign by sign, and the best edge to every
    place is kept; the path is read backwards.
    """
    n = len(unit)
    score, back, ids = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    score[0] = 0.0
    for start, sign in enumerate(unit):
        so_far, stop = score[start], start + 1
        hit = root.get(sign)
        if hit is None or hit[0] is None:
            way = so_far + least - UNKNOWN_PENALTY
            if way > score[stop]:
                score[stop], back[stop], ids[stop] = way, start, -1
        if hit is None:
            continue
        value, i, after = hit
        if value is not None:
            way = so_far + value
            if way > score[stop]:
                score[stop], back[stop], ids[stop] = way, start, i
        while after and stop < n:
            hit = after.get(unit[stop])
            if hit is None:
                break
            stop += 1
            value, i, after = hit
            if value is not None:
                way = so_far + value
                if way > score[stop]:
                    score[stop], back[stop], ids[stop] = way, start, i
    path, at = [], n
    while at:
        start, i = back[at], ids[at]
        if i >= 0:
            path.append(i)
        else:
            path += [known.get(b, 0) for b in reversed(unit[start:at].encode())] if known else (0,)
        at = start
    path.reverse()
    return array("i", path)


def encoded(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """``documents`` with ``ids`` (array<int>), ``n_tokens`` and ``decoded_ok``: whether the ids decode to the text.

    Each batch of texts is cut into units, runs that no piece can cross; a unit's lattice is searched
    once a task, as long as its memory of units (``MEMORY`` of them) lasts.  Nothing is shuffled.

    Among segmentations of equal score the last piece that starts first wins.  Null and empty texts
    have no tokens.  Repeated rows are encoded each.  Columns that the result names are replaced, every
    other one passes.
    """
    v = Vocabulary(model)
    documents = documents.drop("ids", "n_tokens", "decoded_ok")
    names = documents.columns
    schema = T.StructType([*documents.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_ok", T.BooleanType())])
    root = trie(v.edges)
    least, known, raw, prefix = v.least, v.bytes, v.raw, v.prefix
    lone = "".join(f"\\x{ord(c):02x}" for c in v.lone)
    pattern = "(?s:.+)" if v.inner else f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, memory = re.compile(pattern).findall, {}
        for rows, data, at in slices(batches, limit=1 << 21):
            whole, ends = array("i"), [0]
            text = data.tobytes()
            for x, y in zip(at[:-1], at[1:]):
                if y > x:
                    marked = text[x:y].decode().replace(" ", SPACE)
                    for unit in cut(SPACE + marked if prefix else marked):
                        ids = memory.get(unit)
                        if ids is None:
                            if len(memory) >= MEMORY:
                                memory.clear()
                            ids = memory[unit] = best_path(unit, root, least, known)
                        whole.extend(ids)
                ends.append(len(whole))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(whole, np.int32) if whole else np.zeros(0, np.int32)))
            own = pc.fill_null(rows.column("text").cast(pa.binary()).cast(pa.large_binary()), b"")
            ok = pc.equal(decoded(ids, raw, prefix), own)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), ids, pa.array(np.diff(ends)), ok], [*names, "ids", "n_tokens", "decoded_ok"])

    return documents.mapInArrow(task, schema)
