"""Periodic runs of words, by a dictionary of basic factors.

A basic factor is a stretch of ``2**k`` words.  Factors get equal names where their words are equal;
names of one length come from pairs of names of half that length.  The occurrences of a factor
within a window of twice its length form one arithmetic progression whose step is a period, so the
distance from each occurrence to its successor, where it is at most ``2**k``, proposes a period.
Neighbouring places that propose the same period are one run: all places of a run of smallest period
``q <= 2**k`` that have a whole factor and period ahead propose ``q``, and the places beside it do not,
so a maximal stretch of equal proposals gives the run's exact ends.  Runs found at several lengths are
kept once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.text import slices

LEAST, FOLDS = 24, 3
SLICE = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def by_name(name: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(same, place): places in order of (name, place), and whether each has the name of the one before it."""
    bits = int(place.max()).bit_length()
    if int(name.max()).bit_length() + bits < 63:
        packed = np.sort(name << bits | place)
        name, place = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.lexsort((place, name))
        name, place = name[order], place[order]
    return np.concatenate([[False], name[1:] == name[:-1]]), place


def repetitions(words: np.ndarray, at: np.ndarray, least: int = LEAST, folds: int = FOLDS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of at least ``least`` words and ``folds`` periods, in order.

    ``words`` are numbers of the words of several texts, that of text ``i`` at ``at[i]:at[i + 1]``; ``folds`` is
    at least 3.  Only factors that occur twice in their text have longer ones that do, so later levels
    work on few places.
    """
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(words)) + text  # a free place between texts: no factor reaches across
    begin = at[:-1] + np.arange(len(size))
    name = text * (int(words.max(initial=0)) + 1) + words
    found, k = [], 0
    while len(place):
        span = 1 << k
        same, place = by_name(name, place)
        step = np.diff(place, prepend=0)
        near = np.flatnonzero(same & (step <= span))
        if len(near):
            first, q = place[near - 1], step[near]
            order = np.argsort(first)
            first, q = first[order], q[order]
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(q) != 0)]))
            last = first[np.append(edge[1:], len(first)) - 1]
            start, q = first[edge], q[edge]
            length = last - start + q + span
            whole = length >= np.maximum(least, folds * q)
            found.append(np.stack([start[whole], length[whole], q[whole]]))
        if span >= int(size.max(initial=0)) // folds:
            break
        twice = same.copy()
        twice[:-1] |= same[1:]
        number = np.cumsum(~same)[twice]
        place = place[twice]
        order = np.argsort(place)
        place, number = place[order], number[order]
        half = np.searchsorted(place, place + span)
        both = np.flatnonzero(place[np.minimum(half, len(place) - 1)] == place + span) if len(place) else half
        number = np.unique(number, return_inverse=True)[1] if len(number) else number
        name, place, k = number[both] * len(number) + number[half[both]], place[both], k + 1
    start, length, q = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((q, start))
    start, length, q = start[order], length[order], q[order]
    text = np.searchsorted(begin, start, "right") - 1
    return text, start - begin[text], length, q


def collapsed(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Of ``n`` words, those that stay: a run keeps its first period, unless another run drops that."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(documents: DataFrame, least: int = LEAST, folds: int = FOLDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``documents(doc_id, text)``.

    Words are what stands between ASCII white space.  ``runs`` holds (start, length, period) of every
    maximal stretch of words of smallest period ``period`` that has at least ``least`` words and ``folds``
    periods, by start, then period; ``collapsed`` is the text of the words that stay, joined by one space,
    where every run keeps only its first period.

    Equal words are found by comparison, not by hashes.  A text is worked on whole, inside one task, with
    about SLICE bytes of others; memory grows with the longest text.  Null and empty texts: no words, no
    runs, an empty ``collapsed``.  Repeated rows and null doc_ids: a row each.  Other columns are left out.
    Empty table: no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in slices(batches, limit=SLICE):
            raw = data.tobytes()
            split = [raw[a:b].split() for a, b in zip(at[:-1], at[1:])]  # at the six bytes of ASCII white space
            ends = np.cumsum([0] + [len(w) for w in split])
            flat = pa.array([x for w in split for x in w], pa.large_binary())
            number = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            text, start, length, period = repetitions(number, ends, least, folds)
            cut = np.searchsorted(text, np.arange(len(split) + 1))
            kept = []
            for words, a, b in zip(split, cut[:-1], cut[1:]):
                if a < b:
                    stays = collapsed(len(words), start[a:b], length[a:b], period[a:b])
                    words = [words[i] for i in np.flatnonzero(stays)]
                kept.append(b" ".join(words))
            runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(task, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def greatest_run(runs: Column) -> Column:
    """The run of greatest exact length/period, the first of equals; null where there is none."""
    above = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(above(r, best), r).otherwise(best))


def with_planted_period(documents: DataFrame) -> DataFrame:
    """(doc_id, text): about one text in ten goes on with a period of its own from some word.

    With h = crc32 of the decimal doc_id and g = h div 10, the texts with h % 10 = 0 repeat, from word a = g % n
    of n on, the next 1 + (n - a) div (3 + g % 8) words.  A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", SPACE), lambda w: w != ""))
    docs = documents.select(F.col("doc_id").cast("long"), "text").withColumns({"_g": F.floor(h / 10), "_words": words})
    docs = docs.withColumn("_n", F.coalesce(F.size("_words"), F.lit(0)))
    a = F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))
    docs = docs.withColumn("_a", a).withColumn("_p", (F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1))
    again = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return docs.select("doc_id", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
