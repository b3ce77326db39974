"""Quartile bucket digests of whole texts and a bounded difference between them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.text import bisected

BUCKETS = 256
SPAN = 1 << 22


def bucket_counts(text: bytes) -> np.ndarray:
    """How many byte triplets of the text fall into each bucket; the text is read in bounded spans."""
    total = np.zeros(BUCKETS, np.int64)
    for i in range(0, max(0, len(text) - 2), SPAN):
        b = np.frombuffer(text, np.uint8, min(SPAN + 2, len(text) - i), i).astype(np.uint32)
        key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        total += np.bincount((key * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(text: bytes) -> str:
    """Hex digest: length code, quartile ratio codes, then two bits a bucket (the quartile its count lies in)."""
    counts = bucket_counts(text)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(8 * float(np.log2(1 + len(text)))))
    ratio = [int(15 * q / q3) if q3 else 0 for q in (q1, q2)]
    packed = (code[0::4] << 6) | (code[1::4] << 4) | (code[2::4] << 2) | code[3::4]
    return f"{length:02x}{ratio[0]:x}{ratio[1]:x}" + packed.astype(np.uint8).tobytes().hex()


#: Difference that counts as nothing in common: what unrelated codes differ by on average (1.25 a bucket).
WORST = int(1.25 * BUCKETS)


def likeness(a: str, b: str) -> float:
    """1 - difference / WORST, within 0 and 1: equal digests give 1.

    The difference adds the distance of the quartile codes, 6 instead of 3 for opposite ends, and
    the bounded distances of length and ratios.
    """
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    spread = lambda v: np.stack([v[2:] >> 6, (v[2:] >> 4) & 3, (v[2:] >> 2) & 3, v[2:] & 3]).astype(int)
    gap = np.abs(spread(x) - spread(y))
    score = int(np.where(gap == 3, 6, gap).sum())
    score += min(48, abs(int(x[0]) - int(y[0]))) + abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15))
    return max(0.0, 1.0 - score / WORST)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(key: int | None, text: str, following: str) -> tuple:
    own, other = text.encode(), edited(text, following)
    raw = other.encode()
    a, b, c = digest(own), digest(raw), digest(following.encode())
    return key, len(text), hashlib.sha256(raw).hexdigest(), a, b, likeness(a, b), likeness(a, c)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def with_following(documents: DataFrame, rows_per_part: int = 4096) -> DataFrame:
    """Rows keyed so that every document and the one after it share a part.

    Splitters are sampled doc_ids (a quantile sketch); the first document of every part is also
    dealt to the part before it, and the very first to the last part, as look-ahead rows.  Only
    these are copied, so the text is shuffled once.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least")).first()
    parts = max(1, -(-size["n"] // rows_per_part))
    cuts = docs.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted({c for c in cuts or [] if c > (size["least"] or 0)})
    heads = [size["least"] or 0, *cuts]
    part = F.lit(0)
    if cuts:
        # Splitters are a bounded list of numbers, one a part: the place of a row is found by bisection.
        part = bisected(F.col("at"), cuts)
    ahead = F.when(F.col("at").isin(heads), F.array(F.struct(F.pmod(part - 1, F.lit(len(heads))).alias("part"), F.lit(True).alias("ahead"))))
    own = F.array(F.struct(part.alias("part"), F.lit(False).alias("ahead")))
    return docs.withColumn("to", F.explode(F.concat(own, F.coalesce(ahead, F.array().cast("array<struct<part:int,ahead:boolean>>"))))).select("doc_id", "text", "at", "tie", "to.part", "to.ahead")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness.

    Documents follow each other by doc_id, a missing doc_id first, equal ones by a hash of the text;
    the last is followed by the first, a lone document by itself.  A null text is empty.  Texts
    under three bytes count no triplet.  Empty table: no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        before: tuple | None = None
        for batch in batches:
            # In order: the rows of a part, then its look-ahead row.
            for key, text, part, ahead in zip(*(batch.column(c) for c in ("doc_id", "text", "part", "ahead"))):
                now = (part.as_py(), key.as_py(), text.as_py())
                if before is not None and before[0] == now[0]:
                    made.append(_row(before[1], before[2], now[2]))
                before = None if ahead.as_py() else now
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), TYPES)], NAMES)
                made = []

    dealt = with_following(documents)
    dealt = dealt.repartition("part").sortWithinPartitions("part", "ahead", "at", "tie")
    # Of rows that tie with a part's first document only the first is the look-ahead row: later ones
    # follow a look-ahead row and so start no pair.
    return dealt.select("doc_id", "text", "part", "ahead").mapInArrow(
        task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
