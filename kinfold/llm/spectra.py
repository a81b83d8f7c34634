"""Eigendecomposition of a scatter matrix under rank-one changes.

A ``Spectrum`` holds the number of rows seen, their mean, and eigenvalues and
eigenvectors of their scatter (the sum of centred outer products). A row moves
the mean and adds one outer product; two spectra are combined by the outer
products of one's eigenpairs and of the difference of the means. Every outer
product goes through ``rank_one``: deflation, the roots of the secular equation
by rational interpolation within brackets, and eigenvectors from the vector
that has these roots exactly (so they stay orthogonal).
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z2_j / (d_j - x) = 0 for ascending distinct d, z2 > 0
    and rho > 0: (root_i - d_j) as a matrix, and the roots. Root i lies between
    d_i and d_{i+1}, the last below d_n + rho sum z2."""
    n = len(d)
    gap = np.append(d[1:], d[-1] + rho * z2.sum()) - d
    delta = d[None, :] - d[:, None]
    lower = np.tri(n, dtype=bool)
    # The sign at the middle tells the nearer pole, from which a root is measured.
    middle = 1 / rho + (z2 / (delta - gap[:, None] / 2)).sum(axis=1)
    right = middle < 0
    right[-1] = False
    shift = np.where(right, gap, 0)
    delta = delta - shift[:, None]
    # Exact zeros at the pole that the root is measured from.
    rows = np.arange(n)
    delta[rows, np.minimum(rows + right, n - 1)] = 0
    lo = np.where(right, -gap / 2, np.where(middle < 0, gap / 2, 0))
    hi = np.where(right, 0, np.where(middle < 0, gap, gap / 2))
    left_pole = -shift
    right_pole = gap - shift
    tau = (lo + hi) / 2
    busy = np.ones(n, bool)
    for _ in range(80):
        m = delta - tau[:, None]
        r = z2 / m
        f = 1 / rho + r.sum(axis=1)
        size = np.abs(r).sum(axis=1)
        r /= m
        total = r.sum(axis=1)
        busy &= np.abs(f) > _EPS * (8 * (1 / rho + size) + np.abs(tau) * total)
        if not busy.any():
            break
        lo = np.where(f < 0, tau, lo)
        hi = np.where(f >= 0, tau, hi)
        psi = np.where(lower, r, 0).sum(axis=1)
        a1, a2 = left_pole - tau, right_pole - tau
        c = f - a1 * psi - a2 * (total - psi)
        a = (a1 + a2) * f - a1 * a2 * total
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        nxt = tau + step
        middle = (lo + hi) / 2
        inside = (nxt > lo) & (nxt < hi)
        nxt = np.where(inside, nxt, middle)
        # A bracket without a number between its ends is a root.
        busy &= (middle > lo) & (middle < hi)
        tau = np.where(busy, nxt, tau)
    return tau[:, None] - delta, d + shift + tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (ascending) of ``vectors diag(values) vectors' + rho v v'``, rho > 0."""
    z = vectors.T @ v
    size = float(z @ z)
    if not rho * size > 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    tol = 8 * _EPS * max(float(np.abs(values).max()), rho * size)
    # Equal eigenvalues: a rotation moves their share of z into one of them.
    for j in np.flatnonzero(np.diff(values) <= tol):
        h = np.hypot(z[j], z[j + 1])
        if h > 0:
            c, s = z[j + 1] / h, z[j] / h
            left, other = vectors[:, j].copy(), vectors[:, j + 1].copy()
            vectors[:, j] = c * left - s * other
            vectors[:, j + 1] = s * left + c * other
            z[j], z[j + 1] = 0.0, h
    # A direction without a share of z keeps its eigenpair.
    live = np.abs(z) > 8 * _EPS * np.sqrt(size)
    d, zz = values[live], z[live]
    apart, roots = secular_roots(d, zz * zz, rho)
    # The vector for which these roots are exact.
    ratio = d[None, :] - d[:, None]
    np.fill_diagonal(ratio, 1)
    scaled = apart / ratio
    scaled = np.where(np.eye(len(d), dtype=bool), apart, scaled)
    near = np.copysign(np.sqrt(np.abs(np.prod(scaled, axis=0))), zz)
    turn = near[None, :] / -apart
    turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
    values[live] = roots
    vectors[:, live] = vectors[:, live] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """n rows, their mean, and the eigenpairs of their scatter (ascending)."""

    def __init__(self, size: int, n: int = 0, mean: np.ndarray | None = None,
                 values: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.n = n
        self.mean = np.zeros(size) if mean is None else mean
        self.values = np.zeros(size) if values is None else values
        self.vectors = np.eye(size) if vectors is None else vectors

    def add(self, x: np.ndarray) -> None:
        """One row."""
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, off, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        """All rows of another spectrum."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        off, n = other.mean - self.mean, self.n + other.n
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * other.n / n)
        self.mean = self.mean + off * (other.n / n)
        self.n = n
