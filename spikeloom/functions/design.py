"""Filter, taper and wavelet coefficients, computed once on the driver from published formulas."""

from __future__ import annotations

import math

import numpy as np


def _to_digital(poles, gain, order, fs, highpass, lowpass):
    """Analog unit-cutoff lowpass to a digital low-, high- or band-pass in poles and zeros."""
    warp = lambda f: 4.0 * math.tan(math.pi * f / fs)
    if highpass and lowpass:
        lo, hi = warp(highpass), warp(lowpass)
        bw, w0 = hi - lo, math.sqrt(lo * hi)
        half = poles * bw / 2
        root = np.sqrt(half * half - w0 * w0 + 0j)
        p, z, k = np.concatenate([half + root, half - root]), np.zeros(order), gain * bw**order
    elif highpass:
        w = warp(highpass)
        p, z = w / poles, np.zeros(order)
        k = gain * np.real(1 / np.prod(-poles))
    else:
        w = warp(lowpass)
        p, z, k = poles * w, np.zeros(0), gain * w**order
    k = k * np.real(np.prod(4.0 - z) / np.prod(4.0 - p))
    zd = np.concatenate([(4.0 + z) / (4.0 - z), -np.ones(len(p) - len(z))])
    return zd, (4.0 + p) / (4.0 - p), k


def _sections(zeros, poles, gain):
    """Second-order sections; conjugate poles share a section, zeros alternate in sign."""
    cplx = [p for p in poles if p.imag > 1e-12]
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    pairs = [(1.0, -2 * p.real, abs(p) ** 2) for p in cplx]
    while len(real) >= 2:
        a, b = real.pop(), real.pop()
        pairs.append((1.0, -(a + b), a * b))
    if real:
        pairs.append((1.0, -real[0], 0.0))
    plus = [z for z in np.real(zeros) if z > 0]
    minus = [z for z in np.real(zeros) if z <= 0]
    sos = []
    for a in pairs:
        want = 1 if a[2] == 0.0 else 2
        picked = []
        while len(picked) < want and (plus or minus):
            src = plus if len(plus) >= len(minus) else minus
            picked.append(src.pop())
        b = (1.0, -picked[0], 0.0) if want == 1 else (1.0, -(picked[0] + picked[1]), picked[0] * picked[1])
        sos.append([*b, *a])
    out = np.array(sos)
    out[0, :3] *= gain
    return out


def butterworth(order, fs, highpass=None, lowpass=None):
    k = np.arange(1, order + 1)
    poles = np.exp(1j * math.pi * (2 * k + order - 1) / (2 * order))
    return _sections(*_to_digital(poles, 1.0, order, fs, highpass, lowpass))


def bessel(order, fs, highpass=None, lowpass=None):
    """Phase-normalised Bessel filter from the roots of the reverse Bessel polynomial."""
    f = math.factorial
    coef = [f(2 * order - i) / (2 ** (order - i) * f(i) * f(order - i)) for i in range(order + 1)]
    poles = np.roots(coef[::-1]) / coef[0] ** (1.0 / order)
    gain = float(np.real(np.prod(-poles)))
    return _sections(*_to_digital(poles, gain, order, fs, highpass, lowpass))


def notch(freq, q, fs):
    w = 2 * math.pi * freq / fs
    beta = math.tan(w / q / 2)
    g = 1 / (1 + beta)
    return np.array([[g, -2 * g * math.cos(w), g, 1.0, -2 * g * math.cos(w), 2 * g - 1]])


def state_space(sos):
    """One linear system (A, B, C, D) equal to the cascade of sections."""
    n = 2 * len(sos)

    def step(s, x):
        s2 = np.zeros(n)
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            y = b0 * x + s[2 * i]
            s2[2 * i] = b1 * x - a1 * y + s[2 * i + 1]
            s2[2 * i + 1] = b2 * x - a2 * y
            x = y
        return s2, x

    a, c = np.zeros((n, n)), np.zeros(n)
    for j in range(n):
        a[:, j], c[j] = step(np.eye(n)[j], 0.0)
    b, d = step(np.zeros(n), 1.0)
    return a, b, c, d


def edge_length(sos):
    """Odd-extension length of zero-phase filtering: three times the number of taps."""
    short = min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    return 3 * (2 * len(sos) + 1 - short)


def firwin_lowpass(taps, cutoff, beta=5.0):
    """Kaiser-windowed lowpass with unit gain at zero; cutoff relative to Nyquist."""
    m = np.arange(taps) - (taps - 1) / 2
    h = cutoff * np.sinc(cutoff * m) * np.kaiser(taps, beta)
    return h / h.sum()


def firwin_shape(taps, freq, gain, fs, win):
    """FIR by frequency sampling: piecewise linear gain, linear phase, windowed."""
    n = 1 + 2 ** int(math.ceil(math.log2(taps)))
    x = np.linspace(0.0, fs / 2, n)
    fx = np.interp(x, freq, gain) * np.exp(-(taps - 1) / 2.0 * 1j * math.pi * x / (fs / 2))
    return np.fft.irfft(fx)[:taps] * win


def window(kind, n, periodic=True):
    """hann, hamming, boxcar or ("tukey", share)."""
    m = n + 1 if periodic else n
    i = np.arange(n)
    if kind == "boxcar":
        return np.ones(n)
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * math.pi * i / (m - 1))
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(2 * math.pi * i / (m - 1))
    if kind[0] == "tukey":
        x = np.minimum(i, m - 1 - i) / ((m - 1) * kind[1] / 2)
        return np.where(x < 1, 0.5 * (1 - np.cos(math.pi * x)), 1.0)
    raise ValueError(f"unknown window {kind}")


def _tridiagonal_top(d, e, k):
    """Largest k eigenpairs of a symmetric tridiagonal matrix."""
    n = len(d)
    if n <= 1024:
        w, v = np.linalg.eigh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
        return w[::-1][:k], v[:, ::-1][:, :k]
    r = np.zeros(n)
    r[:-1] += np.abs(e)
    r[1:] += np.abs(e)
    lo, hi = np.full(k, (d - r).min()), np.full(k, (d + r).max())
    want = np.arange(1, k + 1)
    for _ in range(80):
        mid = (lo + hi) / 2
        q, above = d[0] - mid, np.zeros(k)
        above += q > 0
        for i in range(1, n):
            q = d[i] - mid - e[i - 1] ** 2 / np.where(np.abs(q) < 1e-300, 1e-300, q)
            above += q > 0
        lo, hi = np.where(above >= want, mid, lo), np.where(above >= want, hi, mid)
    w = (lo + hi) / 2
    vecs = np.empty((n, k))
    for j in range(k):
        x = np.sin(math.pi * (j + 1) * (np.arange(n) + 1) / (n + 1))
        for _ in range(4):
            c, y = np.empty(n - 1), np.empty(n)
            b = d[0] - w[j] + 1e-14
            c[0], y[0] = e[0] / b, x[0] / b
            for i in range(1, n):
                m = d[i] - w[j] + 1e-14 - e[i - 1] * c[i - 1]
                if i < n - 1:
                    c[i] = e[i] / m
                y[i] = (x[i] - e[i - 1] * y[i - 1]) / m
            for i in range(n - 2, -1, -1):
                y[i] -= c[i] * y[i + 1]
            x = y / np.linalg.norm(y)
        vecs[:, j] = x
    return w, vecs


def dpss(n, nw, k):
    """Slepian tapers (k, n) and their concentrations; symmetric tapers have positive sum."""
    t = np.arange(n)
    w = nw / n
    d = ((n - 1 - 2 * t) / 2.0) ** 2 * math.cos(2 * math.pi * w)
    e = t[1:] * (n - t[1:]) / 2.0
    _, v = _tridiagonal_top(d, e, k)
    tapers = v.T.copy()
    for i in range(k):
        lead = tapers[i].sum() if i % 2 == 0 else ((n - 1) / 2 - t) @ tapers[i]
        if lead < 0:
            tapers[i] *= -1
    size = 2 ** int(math.ceil(math.log2(2 * n)))
    auto = np.fft.irfft(np.abs(np.fft.rfft(tapers, size)) ** 2)[:, :n]
    kern = 4 * w * np.sinc(2 * w * t)
    kern[0] = 2 * w
    return tapers, auto @ kern


def frequencies(f0, f1, num, scaling="log"):
    return np.geomspace(f0, f1, num) if scaling == "log" else np.linspace(f0, f1, num)


def morlet(freq, fs, n_cycles=7.0, sigma=-1, gauss_sd=5.0, zero_mean=True, order=2):
    """Complex Morlet wavelet cut at gauss_sd deviations, of norm sqrt(2) in the given order."""
    sd = n_cycles / (2 * math.pi * (freq if sigma == -1 else sigma))
    half = int((gauss_sd * sd) // (1.0 / fs))
    t = np.arange(-half, half + 1) / fs
    w = np.exp(2j * math.pi * freq * t)
    if zero_mean:
        w = w - math.exp(-2 * (math.pi * freq * sd) ** 2)
    w = w * np.exp(-(t**2) / (2 * sd**2))
    return w / (math.sqrt(0.5) * np.linalg.norm(w, ord=order))


def equiripple(taps, bands, gains, fs, density=16, rounds=60):
    """Linear-phase FIR with equal ripples (Parks-McClellan exchange), odd length.

    ``bands`` lists band edges in pairs and ``gains`` one target per band.
    """
    if taps % 2 == 0:
        raise ValueError("an odd number of taps is needed")
    r = (taps - 1) // 2 + 1
    grid, want = [], []
    step = fs / 2 / (density * r)
    for i, g in enumerate(gains):
        lo, hi = bands[2 * i], bands[2 * i + 1]
        f = np.linspace(lo, hi, max(int((hi - lo) / step) + 1, 2))
        grid.append(f)
        want.append(np.full(len(f), float(g)))
    x, d = np.cos(2 * math.pi * np.concatenate(grid) / fs), np.concatenate(want)
    edges = np.cumsum([0, *map(len, grid)])
    pick = np.linspace(0, len(x) - 1, r + 1).round().astype(int)
    best = None
    for _ in range(rounds):
        basis = np.cos(np.arccos(np.clip(x[pick], -1, 1))[:, None] * np.arange(r))
        a = np.column_stack([basis, (-1.0) ** np.arange(r + 1)])
        sol = np.linalg.solve(a, d[pick])
        coef, ripple = sol[:r], abs(sol[r])
        err = d - np.cos(np.arccos(np.clip(x, -1, 1))[:, None] * np.arange(r)) @ coef
        top = []
        for s, e in zip(edges[:-1], edges[1:]):
            v = err[s:e]
            for i in range(len(v)):
                left = i == 0 or (v[i] - v[i - 1]) * np.sign(v[i]) >= 0
                right = i == len(v) - 1 or (v[i] - v[i + 1]) * np.sign(v[i]) > 0
                if left and right:
                    top.append(s + i)
        alt = []
        for i in top:
            if alt and np.sign(err[i]) == np.sign(err[alt[-1]]):
                if abs(err[i]) > abs(err[alt[-1]]):
                    alt[-1] = i
            else:
                alt.append(i)
        while len(alt) > r + 1:
            alt.pop(0 if abs(err[alt[0]]) < abs(err[alt[-1]]) else -1)
        best = coef
        if len(alt) < r + 1 or np.abs(err).max() - ripple < 1e-9 + 1e-4 * ripple:
            break
        pick = np.array(alt)
    half = np.concatenate([best[:0:-1] / 2, [best[0]], best[1:] / 2])
    return half


def daubechies(moments):
    """Lowpass synthesis filter with ``moments`` vanishing moments and extremal phase, by spectral factorisation."""
    y = np.roots([math.comb(moments - 1 + k, k) for k in range(moments - 1, -1, -1)])
    # Each root y of the half-band polynomial gives z + 1/z = 2 - 4y; the one inside the circle is kept.
    z = [min(np.roots([1.0, 4 * v - 2, 1.0]), key=abs) for v in y]
    h = np.real(np.poly([*z, *[-1.0] * moments]))
    return h * math.sqrt(2) / h.sum()


def quadrature(lowpass):
    """(analysis low, analysis high, synthesis low, synthesis high) of an orthogonal filter bank."""
    low = np.asarray(lowpass)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    return low[::-1], high[::-1], low, high
