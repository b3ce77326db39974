"""Quality rules: hashed n-gram logistic regression over fixed base rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.text import mix, odd, per_text, slices, span_hash, words

BITS = 18
GRAMS = (3, 4)
SYMBOLS = b"#*$%&|<>"
MAX_TRAIN = 4000
SLICE = 1 << 20
MIN_WORDS, MAX_REPEAT, MIN_GOOD = 50, 50, 0.5


@dataclass
class Model:
    """Weight of every hashed n-gram, and the calibration ``good = sigmoid(slope * score + shift)``."""

    weight: np.ndarray
    slope: float
    shift: float


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hashed feature) of one family after the other: words, word pairs, byte n-grams of each length."""
    n_bits = np.uint64(64 - BITS)
    start, end, row = words(data, at)
    row = row.astype(np.int32)
    h = span_hash(data, start, end) if len(start) else np.zeros(0, np.uint64)
    yield row, (mix(h + odd(20)) >> n_bits).astype(np.int32)
    same = row[:-1] == row[1:]
    h = (h[:-1] * odd(21) + h[1:] * odd(22))[same]
    yield row[:-1][same], (mix(h) >> n_bits).astype(np.int32)
    del start, end, row, same, h
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    for g in GRAMS:
        m = max(0, len(data) - g + 1)
        key = np.full(m, g, np.uint64)
        for k in range(g):
            key <<= np.uint64(8)
            key |= data[k : k + m]
        fits = text[:m] == text[g - 1 :] if m else np.zeros(0, bool)
        key *= odd(23)
        key >>= n_bits
        yield text[:m][fits], key.astype(np.int32)[fits]


def scores(data: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Score of every text: the mean weight of each family, summed; 0 for an empty one."""
    n = len(at) - 1
    total = np.zeros(n)
    for row, f in features(data, at):
        size = np.maximum(1, np.bincount(row, minlength=n))
        total += np.bincount(row, weights=weight[f], minlength=n) / size
    return total


def fit(rows: list, seed_share: int = 5, rounds: int = 200, rate: float = 2.0, decay: float = 1e-6) -> Model:
    """Logistic regression by full-batch Adam on sparse rows (fold, label, features, shares).

    A fifth of the rows, by hash, is held out and calibrates the score (Platt).  Without rows of
    both labels every text counts as good.
    """
    weight = np.zeros(1 << BITS)
    label = np.array([r["y"] for r in rows], float)
    if len(set(label)) < 2:
        return Model(weight.astype(np.float32), 0.0, 10.0)
    used = np.zeros(1 << BITS, bool)
    for r in rows:
        used[np.frombuffer(r["f"], np.int32)] = True
    used = np.flatnonzero(used)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    # Blocks of rows keep the arrays of one step small.
    blocks = []
    for i in range(0, len(rows), 100):
        some = rows[i : i + 100]
        sizes = [len(r["f"]) // 4 for r in some]
        column = place[np.concatenate([np.frombuffer(r["f"], np.int32) for r in some])]
        blocks.append((slice(i, i + len(some)), np.repeat(np.arange(len(some), dtype=np.int32), sizes), column, np.concatenate([np.frombuffer(r["x"], np.float32) for r in some])))
    folds = [r["fold"] for r in rows]
    rows.clear()

    def summed(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, weights=value * w[column], minlength=at.stop - at.start) for at, row, column, value in blocks])

    train = np.array([f % seed_share != 0 for f in folds])
    if len(set(label[train])) < 2 or len(set(label[~train])) < 2:
        train[:] = True
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    share = np.where(label == 1, 0.5 / max(1, (label[train] == 1).sum()), 0.5 / max(1, (label[train] == 0).sum())) * train
    for t in range(1, rounds + 1):
        s = summed(w) + b
        e = share * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - label)
        g = np.r_[decay * w, e.sum()]
        for at, row, column, value in blocks:
            g[:-1] += np.bincount(column, weights=value * e[at][row], minlength=len(used))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - 0.1 * move[-1]
    weight[used] = w
    s = summed(w)
    held = ~train if (~train).any() else train
    x, y = s[held], label[held]
    scale = max(1e-9, x.std())
    x = x / scale
    slope, shift = 1.0, b / scale
    # Platt's targets keep the slope finite where the held-out rows separate.
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        r, d = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(d * x * x).sum() + 1e-6, (d * x).sum()], [(d * x).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(r * x).sum(), r.sum()])
        slope, shift = slope - np.clip(step[0], -5, 5), shift - np.clip(step[1], -5, 5)
    return Model(weight.astype(np.float32), float(slope / scale), float(shift))


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fit on at most ``most`` labelled documents, those with the least hash of their doc_id.

    The bound is this parameter.  The rows' sparse features (about 10 kB a document) meet in one
    task, which fits and returns the weights; only these come to the driver.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).orderBy("fold", "doc_id").limit(most)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of three numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, limit=SLICE):
            n = rows.num_rows
            found = list(features(data, at))
            key = np.concatenate([r.astype(np.int64) * (1 << BITS) + f for r, f in found])
            share = np.concatenate([1.0 / np.maximum(1, np.bincount(r, minlength=n))[r] for r, _ in found])
            one, back = np.unique(key, return_inverse=True)
            value = np.bincount(back, weights=share, minlength=len(one)).astype(np.float32)
            cut = np.searchsorted(one, np.arange(n + 1) * (1 << BITS))
            f = (one % (1 << BITS)).astype(np.int32)
            made = [(f[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("fold"), rows.column("y"), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.binary())],
                ["fold", "y", "f", "x"],
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["fold"], r["f"]))
        model = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.slope]), pa.array([model.shift])], ["weight", "slope", "shift"])

    rows = texts.select("fold", F.col("y").cast("int").alias("y"), "text").mapInArrow(task, "fold long, y int, f binary, x binary")
    made = rows.repartition(1).mapInArrow(fitted, "weight binary, slope double, shift double").first()
    return Model(np.frombuffer(made["weight"], np.float32), made["slope"], made["shift"]) if made else fit([])


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    n = len(at) - 1
    start, end, row = words(data, at)
    text = np.repeat(np.arange(n), np.diff(at))
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.bincount(row, minlength=n).astype(np.int64),
        "word_chars": per_text(points[end] - points[start], row, n),
        "n_symbols": np.bincount(text[symbol[data]], minlength=n).astype(np.int64),
    }
    # Lines: from a text's start or after a line feed, up to the next line feed or the text's end.
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.r_[at[:-1], feed + 1])
    begin = begin[begin < len(data)]
    stop = np.minimum(np.r_[feed, len(data)][np.searchsorted(feed, begin)], at[np.searchsorted(at, begin, "right")])
    worded = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[worded], stop[worded]
    line_row = np.searchsorted(at, begin, "right") - 1
    h = span_hash(data, begin, stop) if len(begin) else np.zeros(0, np.uint64)
    one = np.unique(mix(h) + line_row.astype(np.uint64) * odd(31), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[one], minlength=n)
    # Words inside any three-word window that occurs twice or more in its text.
    cover = np.zeros(len(start), bool)
    if len(start) > 2:
        h = span_hash(data, start, end)
        key = mix(h[:-2] * odd(32) + h[1:-1] * odd(33) + h[2:] * odd(34)) + row[:-2].astype(np.uint64) * odd(35)
        fits = np.flatnonzero(row[:-2] == row[2:])
        _, back, times = np.unique(key[fits], return_inverse=True, return_counts=True)
        twice = fits[times[back] > 1]
        for k in range(3):
            cover[twice + k] = True
    out["n_repeat_words"] = np.bincount(row[cover], minlength=n).astype(np.int64)
    return out


def judge(documents: DataFrame, model: Model, min_good: float = MIN_GOOD) -> DataFrame:
    """Base counts, base_failed, the probability of being good and kept, for every row of ``documents(doc_id, text)``.

    A text is kept if it passes the base rules and its calibrated probability is at least
    ``min_good``.  Null and empty texts have no words and fail the base rules; repeated rows are
    judged alike, each on its own.
    """
    cast = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, good double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, limit=SLICE):
            c = base_counts(data, at)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])
            good = 1 / (1 + np.exp(-np.clip(model.slope * scores(data, at, model.weight) + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(x) for x in c.values()), pa.array(failed), pa.array(~failed & (good >= min_good)), pa.array(good)],
                ["doc_id", *c, "base_failed", "kept", "good"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, cast)


def keep_good(documents: DataFrame, model: Model, min_good: float = MIN_GOOD) -> DataFrame:
    """The rows of ``documents`` that are kept, with all columns, judged in the same pass without a join."""
    fields = documents.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, limit=SLICE):
            c = base_counts(data, at)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])
            good = 1 / (1 + np.exp(-np.clip(model.slope * scores(data, at, model.weight) + model.shift, -30, 30)))
            yield rows.filter(pa.array(~failed & (good >= min_good)))

    return documents.mapInArrow(task, fields)
