"""Autoregression from moments against passes over the whole series."""

import math

import numpy as np
import pytest

from spikeloom.operators import lattice as la


@pytest.fixture(scope="module")
def made(spark):
    """Two series of two channels with known lag matrices."""
    rng = np.random.default_rng(12)
    a = [np.array([[0.5, -0.2], [0.1, 0.3]]), np.array([[-0.3, 0.0], [0.2, -0.25]])]
    data = {}
    for key, n in (("p", 700), ("q", 523)):
        x = np.zeros((n, 2))
        for t in range(2, n):
            x[t] = 0.4 + a[0] @ x[t - 1] + a[1] @ x[t - 2] + rng.normal(size=2)
        data[key] = x
    rows = [(k, t, v.tolist()) for k, x in data.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, idx long, x array<double>"), data


def regression(x, p, start, constant=True):
    n = len(x)
    past = np.hstack([x[start - j : n - j] for j in range(1, p + 1)] + ([np.ones((n - start, 1))] if constant else []))
    b = np.linalg.lstsq(past, x[start:], rcond=None)[0]
    return b, x[start:] - past @ b


def test_order_search(made):
    vectors, data = made
    got = {(r.recording_id, r.order): r for r in la.order_search(vectors, ["recording_id"], (1, 6), 2, 50).collect()}
    for k, x in data.items():
        sbc = {}
        for p in range(1, 7):
            _, e = regression(x, p, 6)
            n, free = len(e), 2 * p + 1
            logdet = np.linalg.slogdet(e.T @ e)[1]
            sbc[p] = logdet / 2 - np.log(n) * (n - free) / n
            assert np.isclose(got[k, p].sbc, sbc[p]) and np.isclose(got[k, p].fpe, logdet / 2 - np.log(n * (n - free) / (n + free)))
        assert {got[k, p].chosen for p in sbc} == {min(sbc, key=sbc.get)} == {2}


@pytest.mark.parametrize("order", [1, 2])
def test_residuals(made, order):
    vectors, data = made
    got = {r.recording_id: r for r in la.residual_test(vectors, ["recording_id"], order, 8, 2, 50).collect()}
    for k, x in data.items():
        _, e = regression(x, order, order)
        e = e - e.mean(axis=0)
        c0 = e.T @ e
        d = np.sqrt(np.outer(np.diag(c0), np.diag(c0)))
        inverse = np.linalg.inv(c0 / d)
        n, total = len(e), 0.0
        for lag in range(1, 9):
            r = (e[lag:].T @ e[:-lag] / d).ravel()
            total += r @ np.kron(inverse, inverse) @ r
        total = n * total + 4 * 8 * 9 / 2 / n
        assert np.isclose(got[k].lmp, total) and got[k].degrees == 4 * (8 - order)
        assert (got[k].p_value > 0.01) == (order == 2)


def test_chi_square_tail():
    for x, free, want in ((3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0), (2.0, 2, math.exp(-1))):
        assert np.isclose(la.upper_tail(x, free), want, rtol=1e-10)
    for x, free in ((60.0, 30), (500.0, 400), (380.0, 400), (9.0, 7)):
        t = np.linspace(x, x + 900, 2_000_001)
        f = np.exp((free / 2 - 1) * np.log(t / 2) - t / 2 - math.lgamma(free / 2)) / 2
        assert np.isclose(la.upper_tail(x, free), np.trapezoid(f, t), rtol=1e-6)


@pytest.mark.parametrize("method", ["nuttall_strand", "vieira_morf"])
def test_lattice(made, method):
    """Against the recursion over the error series themselves."""
    vectors, data = made
    got = {r.recording_id: r for r in la.lattice(vectors, ["recording_id"], 3, 2, 50, method).collect()}
    for k, x in data.items():
        u = x.T
        ef, eb, pf = u.copy(), u.copy(), u @ u.T
        pb, fore, back = pf.copy(), [np.eye(2)], [np.eye(2)]
        for m in range(1, 4):
            f, b = ef[:, m:], eb[:, m - 1 : -1]
            if method == "nuttall_strand":
                p, q, r = (f @ f.T) @ np.linalg.inv(pf), np.linalg.inv(pb) @ (b @ b.T), 2 * f @ b.T
                rho = np.linalg.solve(np.kron(np.eye(2), p) + np.kron(q.T, np.eye(2)), r.T.ravel()).reshape(2, 2).T
                am, bm = -rho @ np.linalg.inv(pb), -rho.T @ np.linalg.inv(pf)
            else:
                am, bm = -(f @ b.T) @ np.linalg.inv(b @ b.T), -(f @ b.T).T @ np.linalg.inv(f @ f.T)
            pf, pb = pf - am @ bm @ pf, pb - bm @ am @ pb
            ef, eb = np.c_[ef[:, :m], f + am @ b], np.c_[eb[:, :m], b + bm @ f]
            wide = [*fore, np.zeros((2, 2))], [np.zeros((2, 2)), *back]
            fore, back = [a + am @ b for a, b in zip(*wide)], [b + bm @ a for a, b in zip(*wide)]
        assert np.allclose(got[k].coefficients, -np.array(fore[1:]).ravel(), atol=1e-9)
        assert np.allclose(got[k].noise, (pf / len(x)).ravel(), atol=1e-9) and np.allclose(got[k].back_noise, (pb / len(x)).ravel(), atol=1e-9)
        assert np.allclose(got[k].back_coefficients, -np.array(back[-2::-1]).ravel(), atol=1e-9)
