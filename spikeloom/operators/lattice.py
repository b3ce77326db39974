"""Multichannel autoregression from one pass over lagged products.

All models here are functions of the moments of windows of ``lags + 1`` neighbouring samples and of the first ``lags``
samples: tasks add up outer products of windows, and what is solved afterwards is (channels * lags)-sized.
Sums over fewer lags begin earlier in the channel; the windows of the first samples make up the difference, so
every sum covers exactly the samples it covers in a pass over the whole series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from spikeloom.operators.chunks import ARR
from spikeloom.operators.ordered import rolling


class Sums:
    """Lagged moments of one series of vectors."""

    def __init__(self, n: int, moments: np.ndarray, first: np.ndarray, channels: int):
        self.n, self.channels, self.lags = n, channels, len(first)
        self.moments, self.first = moments, first

    def windows(self, lags: int, start: int | None = None) -> tuple[np.ndarray, int]:
        """Sum of h h' over samples t >= start (``lags`` unless given), h = x(t), x(t - 1), .. x(t - lags), 1; and how many samples."""
        c, start = self.channels, lags if start is None else start
        at = np.r_[np.arange(c * (lags + 1)), len(self.moments) - 1]
        out = self.moments[np.ix_(at, at)].copy()
        for t in range(start, self.lags):
            h = np.r_[self.first[t - lags : t + 1][::-1].ravel(), 1.0]
            out += np.outer(h, h)
        return out, self.n - start


def lag_sums(vectors: DataFrame, keys: Sequence[str], lags: int, channels: int, length: int) -> DataFrame:
    """(keys, n, s, first): per key the number of samples, the moments of all whole windows and the first ``lags`` samples.

    ``vectors(keys, idx, x)`` has one array of ``channels`` values per sample, idx from 0 without gaps.
    """
    width = channels * (lags + 1) + 1
    d = rolling(vectors.select(*keys, "idx", "x"), keys, "idx", length, lags, 0, {"_h": lambda f: F.collect_list("x").over(f)})
    full = d.where(F.size("_h") == lags + 1).select(*keys, F.concat(F.flatten(F.reverse("_h")), F.array(F.lit(1.0))).alias("_r"))
    types = dict(full.dtypes)

    def moments(it):
        for pdf in it:
            for key, g in pdf.groupby(list(keys), sort=False):
                m = np.stack(g["_r"].to_numpy())
                yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "s": [(m.T @ m).ravel()]})

    part = full.mapInPandas(moments, ", ".join(f"{k} {types[k]}" for k in keys) + ", s array<double>")
    # Arrays are summed entry by entry: one row a key and entry is all that is shuffled.
    entry = part.select(*keys, F.posexplode("s").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    sums = entry.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))
    head = vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("idx") < lags, F.struct("idx", "x")))).alias("_f")
    )
    values = lambda c, f: F.transform(c, lambda z: z[f])
    return sums.where(F.size("_s") == width * width).join(head, list(keys)).select(*keys, "n", values("_s", "v").alias("s"), F.flatten(values("_f", "x")).alias("first"))


def solved(sums: DataFrame, keys: Sequence[str], channels: int, fields: Sequence[tuple[str, object]], work: Callable[[Sums], Sequence[tuple]]) -> DataFrame:
    """``work(sums)`` yields rows of ``fields`` for every key."""
    from pyspark.sql.types import ArrayType

    out = ArrayType(StructType([StructField(n, t) for n, t in fields]))

    @F.pandas_udf(out)
    def run(s: pd.Series, n: pd.Series, first: pd.Series) -> pd.Series:
        made = []
        for v, k, f in zip(s, n, first):
            v = np.asarray(v)
            made.append([dict(zip([x for x, _ in fields], r)) for r in work(Sums(int(k), v.reshape(math.isqrt(len(v)), -1), np.asarray(f).reshape(-1, channels), channels))])
        return pd.Series(made)

    return sums.select(*keys, "n", F.explode(run("s", "n", "first")).alias("_m")).select(*keys, "n", "_m.*")


def fitted(sums: Sums, order: int, start: int, constant: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(coefficients by lag, intercept, residual sums of products, samples) of least squares over samples from ``start`` on."""
    c = sums.channels
    m, n = sums.windows(order, start)
    now = np.arange(c)
    past = np.r_[np.arange(c, c * (order + 1)), *([[len(m) - 1]] if constant else [])].astype(int)
    b = np.linalg.lstsq(m[np.ix_(past, past)], m[np.ix_(past, now)], rcond=None)[0]
    rest = m[np.ix_(now, now)] - b.T @ m[np.ix_(past, now)]
    a = np.array([b[c * j : c * (j + 1)].T for j in range(order)]).reshape(order, c, c)
    return a, b[-1] if constant else np.zeros(c), rest, n


def criteria(sums: Sums, order: int, most: int, constant: bool) -> tuple[float, float]:
    """Schwarz's criterion and the logarithm of the final prediction error, over the samples that the highest order leaves."""
    c = sums.channels
    _, _, rest, n = fitted(sums, order, most, constant)
    free = c * order + int(constant)
    logdet = np.linalg.slogdet(rest)[1]
    return float(logdet / c - math.log(n) * (n - free) / n), float(logdet / c - math.log(n * (n - free) / (n + free)))


def order_search(vectors: DataFrame, keys: Sequence[str], orders: tuple[int, int], channels: int, length: int, constant: bool = True, selector: str = "sbc") -> DataFrame:
    """(keys, n, order, sbc, fpe, chosen): the criteria of every order from the moments of the highest, and the order of the least."""
    lo, hi = orders

    def work(s: Sums):
        found = [(p, *criteria(s, p, hi, constant)) for p in range(lo, hi + 1)]
        best = min(found, key=lambda r: r[1 if selector == "sbc" else 2])[0]
        return [(p, sbc, fpe, best) for p, sbc, fpe in found]

    fields = [("order", IntegerType()), ("sbc", DoubleType()), ("fpe", DoubleType()), ("chosen", IntegerType())]
    return solved(lag_sums(vectors, keys, hi, channels, length), keys, channels, fields, work)


def upper_tail(x: float, free: int) -> float:
    """Probability that a chi-square number with ``free`` degrees exceeds x: the regularised incomplete gamma function."""
    a, z = free / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series of the lower part
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 10_000):  # continued fraction of the upper part
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def residual_test(vectors: DataFrame, keys: Sequence[str], order: int, lags: int, channels: int, length: int, constant: bool = True) -> DataFrame:
    """(keys, n, lmp, degrees, p_value): the Li-McLeod portmanteau test of the residuals of a fit, up to ``lags``.

    Lagged products of residuals are quadratic forms of the moments of ``order + lags`` lags, so no residual is
    ever written.  ``lags`` exceeds the order.
    """
    if lags <= order:
        raise ValueError("residual lags must exceed the order")
    c = channels

    def work(s: Sums):
        a, w, _, n = fitted(s, order, order, constant)
        one = np.hstack([np.eye(c), *[-x for x in a], np.zeros((c, 1))])

        def shifted(lag: int, most: int, mean: np.ndarray) -> np.ndarray:
            out = np.zeros((c, c * (most + 1) + 1))
            out[:, c * lag : c * (lag + order + 1)] = one[:, :-1]
            out[:, -1] = -w - mean
            return out

        first, k = s.windows(order, order)
        mean = (shifted(0, order, np.zeros(c)) @ first)[:, -1] / k
        zero = shifted(0, order, mean)
        c0 = zero @ first @ zero.T
        scale = np.sqrt(np.outer(np.diag(c0), np.diag(c0)))
        inverse = np.linalg.inv(c0 / scale)
        lmp = 0.0
        for lag in range(1, lags + 1):
            m, _ = s.windows(order + lag, order + lag)
            x = (shifted(0, order + lag, mean) @ m @ shifted(lag, order + lag, mean).T / scale).ravel()
            lmp += x @ np.kron(inverse, inverse) @ x
        lmp = n * lmp + c * c * lags * (lags + 1) / 2 / n
        free = c * c * (lags - order)
        return [(float(lmp), free, upper_tail(lmp, free))]

    fields = [("lmp", DoubleType()), ("degrees", IntegerType()), ("p_value", DoubleType())]
    return solved(lag_sums(vectors, keys, order + lags, channels, length), keys, channels, fields, work)


def reflected(s: Sums, order: int, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(forward coefficients, forward error, backward coefficients, backward error) by a lattice recursion.

    Forward and backward prediction errors are rows of weights over the window; their sums of products come from
    the moments.  ``nuttall_strand`` takes the harmonic partial correlation (a Sylvester equation),
    ``vieira_morf`` the geometric one.
    """
    c = s.channels
    whole, _ = s.windows(0, 0)
    pf = whole[:c, :c].copy()
    pb = pf.copy()
    ahead = back = np.eye(c)
    for m in range(1, order + 1):
        g = s.windows(m, m)[0][:-1, :-1]
        ef, eb = np.hstack([ahead, np.zeros((c, c))]), np.hstack([np.zeros((c, c)), back])
        ff, bb, fb = ef @ g @ ef.T, eb @ g @ eb.T, ef @ g @ eb.T
        if method == "nuttall_strand":
            left, right = ff @ np.linalg.inv(pf), np.linalg.inv(pb) @ bb
            rho = np.linalg.solve(np.kron(left, np.eye(c)) + np.kron(np.eye(c), right.T), (2 * fb).ravel()).reshape(c, c)
            am, bm = -rho @ np.linalg.inv(pb), -rho.T @ np.linalg.inv(pf)
        elif method == "vieira_morf":
            am, bm = -fb @ np.linalg.inv(bb), -fb.T @ np.linalg.inv(ff)
        else:
            raise ValueError(f"unknown recursion {method}")
        pf, pb = pf - am @ bm @ pf, pb - bm @ am @ pb
        ahead, back = ef + am @ eb, eb + bm @ ef
    split = lambda x: np.array([x[:, c * k : c * (k + 1)] for k in range(order + 1)])
    return -split(ahead)[1:], pf, -split(back)[-2::-1], pb


def lattice(vectors: DataFrame, keys: Sequence[str], order: int, channels: int, length: int, method: str = "nuttall_strand") -> DataFrame:
    """(keys, n, coefficients, noise, back_coefficients, back_noise): a multichannel lattice autoregression.

    Coefficients are order x channels x channels by lag, flattened; noise is the final error over the number of samples.
    """

    def work(s: Sums):
        a, pf, b, pb = reflected(s, order, method)
        return [(a.ravel(), (pf / s.n).ravel(), b.ravel(), (pb / s.n).ravel())]

    fields = [(c, ARR) for c in ("coefficients", "noise", "back_coefficients", "back_noise")]
    return solved(lag_sums(vectors, keys, order, channels, length), keys, channels, fields, work)
