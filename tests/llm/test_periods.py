"""Periodic runs against a scan of every period."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from spikeloom.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scanned(words, least=24, folds=3):
    """Runs by trying every period and keeping stretches that no smaller period covers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([number[x] for x in words], np.int64)
    found = []
    for q in range(1, len(w) // folds + 1):
        edge = np.flatnonzero(np.diff(np.r_[0, (w[:-q] == w[q:]).astype(int), 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            size = b - a + q
            if size >= max(least, folds * q) and not any(s <= a and a + size <= s + n for s, n, _ in found):
                found.append((a, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_kernel_on_random_words():
    rng = np.random.default_rng(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 120))
            t = rng.integers(0, rng.integers(1, 4), n)
            if n:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, n // 3 + 2))
                t = np.array([t[i] if i < a else t[a + (i - a) % p] for i in range(n)])
            texts.append(t.astype(np.int64))
        at = np.cumsum([0] + [len(t) for t in texts])
        for least, folds in ((24, 3), (3, 3), (8, 4)):
            got = list(zip(*[x.tolist() for x in periods.repetitions(np.concatenate(texts), at, least, folds)]))
            assert got == [(i, *r) for i, t in enumerate(texts) for r in scanned(t.tolist(), least, folds)]


def test_names_beyond_packed_words():
    """Where a name and a place do not fit one number, both orders agree."""
    rng = np.random.default_rng(4)
    place = rng.permutation(1000)
    name = rng.integers(0, 9, 1000)
    near, far = periods.by_name(name, place), periods.by_name(name + (1 << 60), place)
    assert all((x == y).all() for x, y in zip(near, far))


@pytest.mark.parametrize("which", ["docs", "frame"])
def test_runs_and_digests(request, shared, which):
    df = shared.read.parquet("/root/testdata/sf0.001/documents.parquet") if which == "docs" else request.getfixturevalue("frame")
    got = sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df).collect()], key=str)
    want = []
    for r in df.select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        runs = scanned(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((r.doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=str)
    assert any(runs for _, _, runs, _ in got)


def test_query_on_given_documents(shared):
    got = {r.doc_id: r for r in entry.queries()["op11_periodic_runs"](shared, "/root/testdata/sf0.001").collect()}
    for r in shared.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        w = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = scanned(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        of = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        left = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *(best or (None,) * 3))
        assert (x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == (1000 * best[1] // best[2] if best else None, of, left)


def test_one_very_long_text_and_none(shared, empty):
    words = ["a", "b", "c", "d"] * 100_000 + [f"w{i}" for i in range(50_000)] + [f"x{i % 1000}" for i in range(5_500)]
    df = shared.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    r = periods.periodic_runs(df).first()
    assert [tuple(x) for x in r.runs] == [(0, 400_000, 4), (450_000, 5_500, 1000)]
    assert len(r.collapsed.split()) == 4 + 50_000 + 1000
    assert periods.periodic_runs(empty).count() == 0
    assert periods.with_planted_period(empty).count() == 0
