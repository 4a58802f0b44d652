"""Digital filter design and the recursion over one block of samples (NumPy only)."""

from __future__ import annotations

import math

import numpy as np


# ------------------------------------------------------------ analog prototypes
def _butter(n, rp, rs):
    k = np.arange(-n + 1, n, 2)
    return np.array([]), -np.exp(1j * math.pi * k / (2 * n)), 1.0


def _cheby1(n, rp, rs):
    eps = math.sqrt(10 ** (0.1 * rp) - 1)
    mu = math.asinh(1 / eps) / n
    theta = math.pi * np.arange(-n + 1, n, 2) / (2 * n)
    p = -np.sinh(mu + 1j * theta)
    k = np.prod(-p).real
    return np.array([]), p, k / math.sqrt(1 + eps * eps) if n % 2 == 0 else k


def _cheby2(n, rp, rs):
    eps = 1 / math.sqrt(10 ** (0.1 * rs) - 1)
    mu = math.asinh(1 / eps) / n
    m = np.arange(-n + 1, n, 2)
    m0 = m[m != 0]
    z = -np.conjugate(1j / np.sin(m0 * math.pi / (2 * n)))
    p = -np.exp(1j * math.pi * m / (2 * n))
    p = 1 / (math.sinh(mu) * p.real + 1j * math.cosh(mu) * p.imag)
    return z, p, (np.prod(-p) / np.prod(-z)).real


def _bessel(n, rp, rs):
    """Reverse Bessel polynomial, scaled so that its phase mid-point is at 1."""
    c = [math.factorial(2 * n - k) / (2 ** (n - k) * math.factorial(k) * math.factorial(n - k)) for k in range(n + 1)]
    p = np.roots(c[::-1]) / c[0] ** (1 / n)
    return np.array([]), p, np.prod(-p).real


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-16 and len(out) < 12:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _cd(u, k):
    """Jacobi cd of u quarter periods, by descending Landen steps."""
    w = np.cos(np.asarray(u) * math.pi / 2)
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _asn(w: complex, k: float) -> complex:
    """Inverse of sn, in quarter periods."""
    steps = _landen(k)
    prev = k
    for v in steps:
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (prev * w) ** 2 + 0j)))
        prev = v
    return 2 / math.pi * np.arcsin(w + 0j)


def _ellip(n, rp, rs):
    if n == 1:
        p = -math.sqrt(1 / (10 ** (0.1 * rp) - 1))
        return np.array([]), np.array([p + 0j]), -p
    ep, es = math.sqrt(10 ** (0.1 * rp) - 1), math.sqrt(10 ** (0.1 * rs) - 1)
    k1 = ep / es
    k1c = math.sqrt(1 - k1 * k1)
    half = n // 2
    u = (2 * np.arange(1, half + 1) - 1) / n
    # degree equation for the selectivity k
    sn = _cd(1 - u, k1c)
    kc = k1c ** n * np.prod(sn) ** 4
    k = math.sqrt(1 - kc * kc)
    zeta = _cd(u, k)
    z = 1j / (k * zeta)
    v0 = -1j * _asn(1j / ep, k1) / n
    p = 1j * _cd(u - 1j * v0, k)
    poles = np.concatenate([p, p.conj()])
    zeros = np.concatenate([z, z.conj()])
    if n % 2:
        poles = np.append(poles, 1j * _cd(1 - 1j * v0, k))   # real pole: sn(j v0)
    poles = np.where(poles.real > 0, -poles.conj(), poles)
    gain = (np.prod(-poles) / np.prod(-zeros)).real
    return zeros, poles, gain if n % 2 else gain / math.sqrt(1 + ep * ep)


PROTOTYPES = {"butter": _butter, "cheby1": _cheby1, "cheby2": _cheby2, "bessel": _bessel, "ellip": _ellip}


def design(order: int, edges, band: str, kind: str = "butter", rp: float = 3.0, rs: float = 60.0):
    """(b, a) of a digital filter; edges are fractions of the Nyquist frequency."""
    z, p, k = PROTOTYPES[kind](order, rp, rs)
    w = 4 * np.tan(math.pi * np.atleast_1d(np.asarray(edges, float)) / 2)
    extra = len(p) - len(z)
    if band in ("low", "high"):
        w0 = w[0]
        if band == "low":
            z, p, k = z * w0, p * w0, k * w0 ** extra
        else:
            k = k * (np.prod(-z) / np.prod(-p)).real
            z, p = np.concatenate([w0 / z, np.zeros(extra)]), w0 / p
    else:
        w0, bw = math.sqrt(w[0] * w[1]), w[1] - w[0]
        if band == "band":
            split = lambda r: np.concatenate([r * bw / 2 + s * np.sqrt((r * bw / 2 + 0j) ** 2 - w0 ** 2) for s in (1, -1)])
            z, p, k = np.concatenate([split(z), np.zeros(extra)]), split(p), k * bw ** extra
        elif band == "stop":
            k = k * (np.prod(-z) / np.prod(-p)).real
            split = lambda r: np.concatenate([bw / 2 / r + s * np.sqrt((bw / 2 / r + 0j) ** 2 - w0 ** 2) for s in (1, -1)]) if len(r) else r
            z, p = np.concatenate([split(z), np.full(extra, 1j * w0), np.full(extra, -1j * w0)]), split(p)
        else:
            raise ValueError("band is one of low, high, band, stop")
    fs2 = 4.0
    k = k * (np.prod(fs2 - z) / np.prod(fs2 - p)).real
    zd = np.concatenate([(fs2 + z) / (fs2 - z), -np.ones(len(p) - len(z))])
    pd = (fs2 + p) / (fs2 - p)
    return k * np.poly(zd).real, np.poly(pd).real


def dc_blocker(cutoff: float):
    """One-pole high pass; cutoff is a fraction of the Nyquist frequency."""
    s, c = math.sin(math.pi * cutoff), math.cos(math.pi * cutoff)
    pole = (math.sqrt(3) - 2 * s) / (s + math.sqrt(3) * c)
    return np.array([1.0, -1.0]), np.array([1.0, -pole])


# -------------------------------------------------------------------- recursion
class StateFilter:
    """Linear recursion in state form; a block starts from any state, so blocks of one
    signal can run in different tasks."""

    block = 64

    def __init__(self, b, a):
        b, a = np.asarray(b, float), np.asarray(a, float)
        n = max(len(a), len(b)) - 1
        b, a = np.pad(b, (0, n + 1 - len(b))) / a[0], np.pad(a, (0, n + 1 - len(a))) / a[0]
        self.n = n
        self.A = np.zeros((n, n))
        self.A[:, 0] = -a[1:]
        self.A[: n - 1, 1:] += np.eye(n - 1)
        self.B = b[1:] - a[1:] * b[0]
        self.d = b[0]
        m = self.block
        power, self.out, self.inp, self.powers = np.eye(n), np.zeros((m, n)), np.zeros((n, m)), []
        h = np.zeros(m)
        for k in range(m):
            self.out[k] = power[0]
            self.powers.append(power)
            self.inp[:, m - 1 - k] = power @ self.B
            power = self.A @ power
        self.step = power
        h[0] = self.d
        for k in range(1, m):
            h[k] = self.inp[0, m - k]
        self.conv = np.array([[h[i - j] if i >= j else 0.0 for j in range(m)] for i in range(m)])

    def settled(self) -> np.ndarray:
        """State of a long constant input of 1."""
        return np.linalg.solve(np.eye(self.n) - self.A, self.B)

    def power(self, length: int) -> np.ndarray:
        return np.linalg.matrix_power(self.A, int(length))

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and end state."""
        m, full = self.block, len(x) // self.block
        y, s = np.empty(len(x)), np.asarray(state, float)
        blocks = x[: full * m].reshape(full, m)
        direct, drive = blocks @ self.conv.T, blocks @ self.inp.T
        for k in range(full):
            y[k * m:(k + 1) * m] = direct[k] + self.out @ s
            s = self.step @ s + drive[k]
        rest = x[full * m:]
        if r := len(rest):
            y[full * m:] = self.conv[:r, :r] @ rest + self.out[:r] @ s
            s = self.powers[r] @ s + self.inp[:, m - r:] @ rest
        return y, s
