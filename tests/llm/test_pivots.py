"""Exact top-k search against all inner products."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from spikeloom.llm import pivots


def by_all_products(rows, k=10, every=100):
    have = []
    for i, (vec, x) in enumerate(rows):
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            have.append((i, vec, [math.floor(1024 * c) for c in x]))
    out = []
    for i, q, x in have:
        if q is not None and q % every == 0:
            order = sorted((-sum(a * b for a, b in zip(x, y)), math.inf if v is None else v, j, v) for j, v, y in have if j != i)
            out += [(q, n + 1, v, -s) for n, (s, _, _, v) in enumerate(order[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()], key=str)


def test_given_vectors(shared):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in shared.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = entry.queries()["op13_exact_top_k"](shared, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == by_all_products(rows)


def test_odd_vectors_in_small_blocks(shared, monkeypatch):
    """Ties, copies, repeated and null ids, nulls, other lengths, non-finite components; several blocks on both sides."""
    monkeypatch.setattr(pivots, "CANDIDATES", 40)
    monkeypatch.setattr(pivots, "QUERIES", 2)
    monkeypatch.setattr(pivots, "STEP", 3)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.01 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(400 + i, centres[0].tolist()) for i in range(60)] + [(500, centres[0].tolist())] * 3
    rows += [(600, None), (700, [None] + [1.0] * 7), (800, [math.nan] * 8), (900, [math.inf] * 8), (1000, []), (1100, [1.0, 2.0]), (None, centres[1].tolist()), (1200, [0.0] * 8)]
    df = shared.createDataFrame([(i, x, 1.0, 2) for i, x in rows], "vec_id long, embedding array<double>, held double, row int")
    for k, n in ((10, 32), (3, 2), (1000, 32), (10, 0)):
        assert found(pivots.top_scores(df, k=k, pivots=n)) == by_all_products(rows, k)


def test_bounds_spare_work(shared):
    """Clustered vectors: far clusters are never evaluated."""
    rng = np.random.default_rng(6)
    centres = 4 * rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.001 * rng.normal(size=16)).tolist()) for i in range(4000)]
    got = pivots.top_scores(shared.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert max(r.n_evaluated / r.n_bounded for r in got) < 0.2
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], key=str) == by_all_products(rows)


def test_products_beyond_doubles(shared):
    rows = [(i, [1e5 + i, -2e5 + i % 7, 3e5]) for i in range(60)]
    got = pivots.top_scores(shared.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20)
    assert found(got) == by_all_products(rows, every=20)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(100, [1.0])]])
def test_none_or_one_vector(shared, rows):
    assert pivots.top_scores(shared.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []
