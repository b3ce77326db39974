"""Exact substring deduplication: sorted suffixes at content-defined places, over all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.text import bisected, mix, odd, slices, span_hash, utf8
from spikeloom.operators.skew import attach, hot_counts

LENGTH, ANCHOR = 50, 24
CHUNK_BYTES, BUCKET_BYTES, SLICE = 2 << 20, 16 << 20, 1 << 19
#: Ranges of leading bytes, and the text whose suffixes a part of a range holds: larger corpora have more parts a range.
RANGES, PART_BYTES = 256, 32 << 20


def anchors(data: np.ndarray, at: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Windows of ``length`` bytes in runs that share an anchor: (text, first window, windows, anchor place, hash).

    A window's anchor is the ``width``-byte string within it of least hash (the leftmost of equals),
    so equal windows have equal anchors at equal places, wherever they occur.  ``width`` is a multiple
    of eight; the hash is cut to 48 bits.
    """
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    load = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    full = load[: n - width + 1] * odd(51)
    for k in range(8, width, 8):
        full ^= full >> np.uint64(29)
        full += load[k : k + len(full)]
        full *= odd(51 + k)
    full ^= full >> np.uint64(32)
    full *= odd(50)
    h = (full >> np.uint64(32)).astype(np.uint32)
    span = length - width + 1
    low = _sliding(np.minimum, h, span)
    # Places that hold the least hash of some window, in order.  A window's anchor is the first of them
    # at or after it with that hash; most windows take the first, the rest step on.
    pad = np.zeros(span - 1, np.uint32)
    hit = _sliding(np.maximum, np.concatenate([pad, low, pad]), span) == h
    hits = np.flatnonzero(hit)
    j = np.cumsum(hit, dtype=np.int32)[: len(low)] - hit[: len(low)]
    wrong = np.flatnonzero(h[hits[j]] != low)
    while len(wrong):
        j[wrong] += 1
        wrong = wrong[h[hits[j[wrong]]] != low[wrong]]
    # Runs end where the anchor changes; at a text's end the windows that reach beyond it are cut off.
    edge = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
    place = hits[j[edge]]
    stop = np.concatenate([edge[1:], [len(low)]])
    text = np.searchsorted(at, edge, "right") - 1
    last = np.searchsorted(at, stop - 1, "right") - 1
    many = np.flatnonzero(last > text)
    if len(many):  # runs over several texts: a part in each
        parts = [(t, max(edge[i], at[t]), min(stop[i], at[t + 1]), place[i]) for i in many for t in range(text[i], last[i] + 1) if at[t + 1] > at[t]]
        one = np.setdiff1d(np.arange(len(edge)), many)
        t, x, y, p = (np.array(c, np.int64) for c in zip(*parts))
        text, edge, stop, place = (np.concatenate(c) for c in ((text[one], t), (edge[one], x), (stop[one], y), (place[one], p)))
    stop = np.minimum(stop, at[text + 1] - length + 1)
    on = stop > edge
    text, edge, stop, place = text[on], edge[on], stop[on], place[on]
    return text, edge, stop - edge, place, mix(full[place]) >> np.uint64(16)


def _sliding(choose: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        x = choose(x[:-k], x[k:])
        k *= 2
    return choose(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def multikey_order(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``data[s : s + length]`` and whether each equals the one before it.

    Multikey quicksort a machine word at a time: only groups that tie so far are sorted by the next
    eight bytes, until every group is one string or all bytes are compared.
    """
    loads = np.lib.stride_tricks.sliding_window_view(data, 8)
    order = np.arange(len(start))
    same = np.r_[False, np.ones(max(0, len(start) - 1), bool)]
    for at in [*range(0, length - 7, 8), length - 8]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(~same[where])
        word = np.ascontiguousarray(loads[start[order[where]] + at]).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((word, group))
        order[where] = order[where][by]
        word, group = word[by], group[by]
        same[where] = np.r_[False, (word[1:] == word[:-1]) & (group[1:] == group[:-1])]
    return order, same


def _shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(tid, anchors): of every text the anchors that another text has too.

    A batch of texts sends its anchors packed by bucket of the hash and text, six bytes each, with
    each text and how many are its.  An anchor of several texts of a batch is settled at once and only one of them sends it, so
    a passage in very many documents is an entry a batch.  Buckets hold a bounded share of the text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got_h, got_t = [], []
            for rows, data, at in slices([batch], limit=SLICE):
                t, _, _, _, h = anchors(data, at, LENGTH, ANCHOR)
                got_h.append(h)
                got_t.append(rows.column("tid").to_numpy(zero_copy_only=False)[t])
            if not got_h:
                continue
            h, tid = np.concatenate(got_h), np.concatenate(got_t)
            order = np.lexsort((tid, h))
            h, tid = h[order], tid[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (tid[1:] != tid[:-1])
            h, tid = h[new], tid[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            lone = first & np.append(first[1:], True)
            # Settled: every text of an anchor that several texts here have.
            yield sent(*packed(h[~lone], tid[~lone], buckets))
            h, tid = h[first], tid[first]
            part = (h % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((tid, part))
            h, tid, part = h[order], tid[order], part[order]
            made = []
            cut = np.searchsorted(part, np.arange(buckets + 1))
            for x, y in zip(cut[:-1], cut[1:]):
                if y > x:
                    ids, own = np.unique(tid[x:y], return_counts=True)
                    six = h[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    made.append((part[x], six, own.astype(np.uint32).tobytes(), ids))
            if made:
                where, six, own, ids = zip(*made)
                k = len(made)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(where, np.int32)), pa.array(six, pa.binary()), pa.nulls(k, pa.binary()), pa.array(own, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names)

    def sent(where: list, six: list, tids: list) -> pa.RecordBatch:
        k = len(where)
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(six, pa.binary()), pa.array(tids, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64()))], names)

    def settle(rows: list[dict]) -> pa.RecordBatch:
        h = np.concatenate([six_byte(r["six"]) for r in rows])
        tid = np.concatenate([np.repeat(np.asarray(r["ids"], np.int64), np.frombuffer(r["own"], np.uint32)) for r in rows])
        order = np.lexsort((tid, h))
        h, tid = h[order], tid[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(edge, len(h)))
        several = np.repeat(tid[edge] != tid[edge + size - 1], size)
        return sent(*packed(h[several], tid[several], buckets))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "bucket"):
            open_ = [r for r in rows if r["tids"] is None]
            for batch in ([settle(open_)] if open_ else []) + [sent(*zip(*((r["bucket"], r["six"], r["tids"]) for r in rows if r["tids"] is not None)))] * (len(open_) < len(rows)):
                yield batch.select(["bucket", "six", "tids"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "bucket"):
            h = np.concatenate([six_byte(r["six"]) for r in rows])
            tid = np.concatenate([np.frombuffer(r["tids"], np.int64) for r in rows])
            order = np.argsort(tid, kind="stable")
            whose, start = np.unique(tid[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), pa.array(h[order].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(whose), lists], ["tid", "anchors"])

    names = ["bucket", "six", "tids", "own", "ids"]
    rows = docs.select("tid", "text").mapInArrow(task, "bucket int, six binary, tids binary, own binary, ids array<long>")
    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "bucket int, six binary, tids binary")
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gathered, "tid long, anchors array<long>")


def six_byte(raw: bytes) -> np.ndarray:
    """48-bit hashes from their six bytes each."""
    return np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel()


def packed(h: np.ndarray, tid: np.ndarray, buckets: int) -> tuple[list, list, list]:
    """(bucket of the text, hashes of six bytes each, texts), a row a bucket, texts in order."""
    to = (mix(tid.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((tid, to))
    h, tid, to = h[order], tid[order], to[order]
    where = np.unique(to)
    cut = np.searchsorted(to, np.append(where, buckets))
    six = [h[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x, y in zip(cut[:-1], cut[1:])]
    return where.tolist(), six, [tid[x:y].astype(np.int64).tobytes() for x, y in zip(cut[:-1], cut[1:])]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of each value of ``key``, from batches in its order."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][key] != r[key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _units(texts: DataFrame) -> DataFrame:
    """Suffixes at shared anchors: (doc_id, rid, first, windows, back, content).

    ``content`` spans the windows of a run, ``back`` is the anchor's place in it.  Of equal units in a slice only the one of least doc_id is sent.  The others are
    covered: a text's touching ones are one run, and its runs are packed into ``content`` of one row without windows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, limit=SLICE):
            t, first, n, place, h = anchors(data, at, LENGTH, ANCHOR)
            if not len(t):
                continue
            lists = rows.column("anchors")
            wanted = np.asarray(lists.flatten())
            row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
            key = lambda r, x: mix(x.view(np.uint64) + r.astype(np.uint64) * odd(41))
            on = np.flatnonzero(np.isin(key(t, h), key(row, wanted)))
            if not len(on):
                continue
            t, first, n, place = t[on], first[on], n[on], place[on]
            end = first + n - 1 + LENGTH
            doc, rid = (rows.column(c).to_numpy(zero_copy_only=False)[t] for c in ("doc_id", "rid"))
            unit = mix(span_hash(data, first, end) + (place - first).astype(np.uint64) * odd(42))
            order = np.lexsort((doc, unit))
            new = np.r_[True, unit[order][1:] != unit[order][:-1]]
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            covered = np.zeros(len(t), bool)
            covered[order] = doc[order] > least
            text, packed_ = packed_spans(t[covered], (first - at[t])[covered], (end - at[t])[covered])
            on = np.flatnonzero(~covered)
            raw = data.tobytes()
            none = np.zeros(len(text), np.int64)
            ids = [rows.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "rid")]
            cols = [doc[on], rid[on], first[on] - at[t[on]], n[on], (place - first)[on]]
            tail = [*ids, none, none, none]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), k) for c, k in zip(zip(cols, tail), (pa.int64(),) * 2 + (pa.int32(),) * 3)]
                + [pa.array([raw[x:y] for x, y in zip(first[on], end[on])] + packed_, pa.binary())],
                ["doc_id", "rid", "first", "n", "back", "content"],
            )

    return texts.mapInArrow(task, "doc_id long, rid long, first int, n int, back int, content binary")


def joined(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Touching or overlapping spans as one: (begin, end) a row, in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]] if len(begin) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return np.stack([begin[head], end[np.r_[head[1:], len(begin)] - 1]], axis=1) if len(head) else np.zeros((0, 2), np.int64)


def packed_spans(whose: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A row each of ``whose`` with its touching spans joined: 32-bit (begin, end) pairs in order."""
    keys, row = np.unique(whose, return_inverse=True)
    span = joined(begin + (row << 33), end + (row << 33))  # no span of one key touches another's
    cut = np.searchsorted(span[:, 0] >> 33, np.arange(len(keys) + 1))
    span = (span & ((1 << 33) - 1)).astype(np.int32)
    return keys, [span[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]


def _covered(units: DataFrame, cuts: list[int], split: int) -> DataFrame:
    """(rid, spans): removed runs, packed as by ``packed_spans``, from suffixes range-partitioned by their leading bytes and sorted.

    ``cuts`` are sampled splitters over the first seven bytes; each range has ``split`` parts, an anchor
    in one of them, so that parts hold a bounded share of the text.  A bucket is read in order of its anchors, in
    chunks that end between two anchors; what one anchor has open crosses the chunk's boundary.
    Units equal to one of an earlier document are covered whole; the windows of the others are
    sorted by multikey quicksort and each equal to one of an earlier document is covered.
    """

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        get = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
        doc, rid, first, n, back = (get(c).astype(np.int64) for c in ("doc_id", "rid", "first", "n", "back"))
        data, at = utf8(pa.concat_arrays(rows.column("content").chunks))
        begin, stop, whose = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        idx = np.arange(len(rows))
        if len(idx):
            unit = mix(span_hash(data, at[:-1][idx], at[1:][idx]) + back[idx].astype(np.uint64) * odd(43))
            order = np.lexsort((doc[idx], unit))
            new = np.r_[True, unit[order][1:] != unit[order][:-1]]
            least = doc[idx][order][np.flatnonzero(new)][np.cumsum(new) - 1]
            whole = idx[order[doc[idx][order] > least]]
            begin.append(first[whole]), stop.append((first + n - 1 + LENGTH)[whole]), whose.append(rid[whole])
            rest = np.sort(idx[order[doc[idx][order] == least]])
            # Only anchors with several different units can still share single windows.
            lead_data, lead_at = utf8(pa.concat_arrays(rows.column("lead").chunks))
            lead = span_hash(lead_data, lead_at[:-1], lead_at[1:])[rest]
            kinds = np.zeros(len(rows), np.uint64)
            kinds[idx] = unit
            pair = np.unique(np.stack([lead, kinds[rest]]), axis=1)[0]
            several = np.unique(pair[1:][pair[1:] == pair[:-1]])
            rest = rest[np.isin(lead, several)]
            if len(rest):
                owner = np.repeat(rest, n[rest])
                step = np.arange(len(owner)) - np.repeat(np.cumsum(n[rest]) - n[rest], n[rest])
                order, same = multikey_order(data, at[owner] + step, LENGTH)
                group = np.cumsum(~same) - 1
                edge = np.flatnonzero(~same)
                lo = np.minimum.reduceat(doc[owner][order], edge)[group]
                hit = np.zeros(len(owner), bool)
                hit[order] = doc[owner][order] > lo
                where = np.flatnonzero(hit)
                if len(where):
                    joint = np.r_[False, (where[1:] == where[:-1] + 1) & (owner[where[1:]] == owner[where[:-1]])]
                    head = np.flatnonzero(~joint)
                    tail = np.r_[head[1:], len(where)] - 1
                    who = owner[where[head]]
                    begin.append(first[who] + step[where[head]]), stop.append(first[who] + step[where[tail]] + LENGTH), whose.append(rid[who])
        keys, spans = packed_spans(*map(np.concatenate, (whose, begin, stop)))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(spans, pa.binary())], ["rid", "spans"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            packed_ = b.filter(pc.equal(b.column("n"), 0))
            if packed_.num_rows:
                yield packed_.select(["rid", "content"]).rename_columns(["rid", "spans"])
                b = b.filter(pc.greater(b.column("n"), 0))
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size < CHUNK_BYTES:
                continue
            whole = pa.Table.from_batches(held)
            lead = whole.column("lead")
            last, cut = lead[-1].as_py(), len(whole) - 1
            lo, hi = 0, len(whole) - 1  # bisection: rows are in order of their leading bytes
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if lead[mid].as_py() < last else (lo, mid)
            cut = lo
            if cut:
                yield settle(whole.slice(0, cut))
            held = whole.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held) if cut else 0
        if held:
            yield settle(pa.Table.from_batches(held))

    lead = F.substring("content", F.col("back") + 1, F.lit(ANCHOR))
    # Runs that are covered already only pass through, so they may go anywhere.
    part = F.when(F.col("n") > 0, bisected(lead, [c.to_bytes(7, "big") for c in cuts]) * split + F.pmod(F.xxhash64(lead), F.lit(split)))
    part = F.coalesce(part, F.pmod("rid", F.lit((len(cuts) + 1) * split)))
    # Neither part nor anchor passes the shuffle: the anchor is cut out of the content again, its order is that of the parts.
    dealt = units.repartition(part.cast("int")).withColumn("lead", F.when(F.col("n") > 0, lead)).sortWithinPartitions("lead", "doc_id")
    return dealt.mapInArrow(task, "rid long, spans binary")


def removed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): documents with a row key ``rid``, and (rid, spans, whole) of what to remove: packed spans, or all."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    ids = docs.select("doc_id", "rid", F.xxhash64("text").alias("tid"), F.octet_length("text").alias("n"), F.xxhash64(F.lit(1), "text").alias("two"))
    ids = ids.where((F.col("n") >= LENGTH) & F.col("doc_id").isNotNull())
    firsts = ids.groupBy("tid", "two").agg(F.min(F.struct("doc_id", "rid")).alias("f"), F.count(F.lit(1)).alias("_n")).select("tid", "two", "f.rid", F.col("f.doc_id").alias("least"), "_n")
    # Copies of an earlier document are covered whole; only the first of equal texts is looked at.
    copied = firsts.where(F.col("_n") > 1)
    copies = attach(ids, copied.select("tid", "two", "least"), ["tid", "two"], F.col("rid"), hot=hot_counts(copied.select("tid", "two", "_n"), ["tid", "two"]))
    copies = copies.where(F.col("doc_id") > F.col("least")).select("rid", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("whole"))
    n = F.octet_length("text")
    sample = F.substring(F.encode("text", "UTF-8"), (F.pmod(F.col("rid"), F.greatest(n - ANCHOR, F.lit(1))) + 1).cast("int"), F.lit(7))
    total = docs.agg(F.sum(n).alias("bytes"), F.percentile_approx(F.when(n >= LENGTH, F.conv(F.rpad(F.hex(sample), 14, "0"), 16, 10).cast("long")), [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts")).first()
    cuts = sorted(set(total["cuts"] or []))
    shared = _shared_anchors(docs.where(F.col("doc_id").isNotNull()).withColumn("tid", F.xxhash64("text")), max(1, (total["bytes"] or 0) // BUCKET_BYTES))
    mine = firsts.select("tid", "rid").join(shared, "tid").select("rid", "anchors")
    units = _units(docs.join(mine, "rid", "left").where(F.col("anchors").isNotNull()).select("doc_id", "rid", "text", "anchors"))
    return docs, copies.union(_covered(units, cuts, 1 + (total["bytes"] or 0) // (RANGES * PART_BYTES)).withColumn("whole", F.lit(False)))


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``documents(doc_id, text)``.

    A byte is removed if a 50-byte string that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input.  A null text is empty.  Rows that share a doc_id are
    judged each, and not against each other.  A row without a doc_id loses nothing and takes nothing.
    """
    docs, runs = removed(documents)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            raw, made = data.tobytes(), []
            for i, (spans, whole) in enumerate(zip(b.column("spans").to_pylist(), b.column("whole").to_pylist())):
                text = raw[at[i] : at[i + 1]]
                span = np.frombuffer(b"".join(spans or []), np.int32).reshape(-1, 2)
                merged = [[0, len(text)]] if whole else joined(span[:, 0], span[:, 1]).tolist()
                sha, at_ = hashlib.sha256(), 0
                for x, y in merged:
                    sha.update(text[at_:x])
                    at_ = y
                sha.update(text[at_:])
                made.append((len(text), sum(y - x for x, y in merged), len(merged), sha.hexdigest()))
            cols = zip(*made) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    per = runs.groupBy("rid").agg(F.collect_list("spans").alias("spans"), F.max("whole").alias("whole"))
    out = docs.join(per, "rid", "left").select("doc_id", "text", "spans", "whole")
    return out.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
