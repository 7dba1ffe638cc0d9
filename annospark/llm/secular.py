"""Spectra of symmetric matrices under rank-one updates: secular equations with deflation, for one task."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 80  # of root finding; a few are needed


def _roots(poles: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Differences ``poles[j] - root[i]`` as row i, for the roots of ``1 / rho + sum(z^2 / (poles - x)) = 0``.

    ``poles`` ascend and differ, no ``z`` is 0, ``rho > 0``: one root lies right of each pole. A root is sought as its
    distance from the nearer of the two poles around it, so close roots keep their digits. Each step solves the equation of
    two poles that touches the true one, and halves the bracket where that leaves it.
    """
    n, z2 = len(poles), z * z
    right = np.append(poles[1:], poles[-1] + rho * z2.sum())
    gap = right - poles
    with np.errstate(all="ignore"):
        middle = 1 / rho + (z2 / (poles - (poles + gap / 2)[:, None])).sum(axis=1)
        left_half = (middle >= 0) | (np.arange(n) == n - 1)
        origin = np.where(left_half, poles, right)
        d = poles - origin[:, None]
        # brackets and start, as distances from the origin
        low, high = np.where(left_half, 0.0, -gap / 2), np.where(left_half, gap / 2, 0.0)
        high[-1] = gap[-1]
        tau = (low + high) / 2
        di, dj = poles - origin, right - origin
        done = np.zeros(n, bool)
        for _ in range(ROUNDS):
            delta = d - tau[:, None]
            part = z2 / delta
            w, size = 1 / rho + part.sum(axis=1), 1 / rho + np.abs(part).sum(axis=1)
            done |= np.abs(w) <= EPS * size
            if done.all():
                break
            slope = (part / delta).sum(axis=1)
            low, high = np.where(w < 0, tau, low), np.where(w < 0, high, tau)
            a_, b_ = di - tau, dj - tau
            c = w - b_ * slope - (di - dj) * z2 / (a_ * a_)
            a, b = (a_ + b_) * w - a_ * b_ * slope, a_ * b_ * w
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            newton = -w / slope
            step = np.where(np.isfinite(step) & (w * step < 0), step, newton)
            new = tau + step
            inside = (new > low) & (new < high)
            new = np.where(inside, new, (low + high) / 2)
            done |= new == tau
            tau = np.where(done, tau, new)
    return d - tau[:, None]


def _update(values: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of ``diag(values) + rho z z'`` where nothing is left to deflate."""
    delta = _roots(values, z, rho)  # row i: values - root i
    n = len(values)
    # the z for which these roots are exact; with it the vectors are orthogonal to the last digits
    apart = values[:, None] - values[None, :]
    np.fill_diagonal(apart, 1.0)
    ratio = -delta.T / apart.T  # [j, i]: (root_i - value_j) / (value_i - value_j)
    own = np.diag(ratio).copy()
    np.fill_diagonal(ratio, 1.0)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1) * own / rho)) * np.where(z < 0, -1, 1)
    vectors = (exact / delta).T
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    at = np.arange(n)
    return values - delta[at, at], vectors


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + rho x x'``, ``rho >= 0``.

    Directions that ``x`` hardly touches keep their pair; of two values as good as equal, a rotation takes ``x`` out of
    one. The rest comes from the secular equation.
    """
    z = vectors.T @ x
    size = np.sqrt(z @ z)
    if not rho * size * size > 0:
        return values, vectors
    tolerance = 8 * EPS * max(np.abs(values).max(), rho * size * size)
    vectors = vectors.copy()
    live = np.flatnonzero(rho * size * np.abs(z) > tolerance)
    if len(live) > 1 and np.diff(values[live]).min() <= tolerance:
        kept = [live[0]]
        for j in live[1:]:
            i = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if values[j] - values[i] > tolerance and abs((values[j] - values[i]) * c * s) > tolerance:
                kept.append(j)
                continue
            # turn the plane of i and j until only j is touched
            vectors[:, [i, j]] = np.column_stack((c * vectors[:, i] - s * vectors[:, j], s * vectors[:, i] + c * vectors[:, j]))
            z[i], z[j] = 0.0, r
            values = values.copy()
            values[i], values[j] = values[i] * c * c + values[j] * s * s, values[i] * s * s + values[j] * c * c
            kept[-1] = j
        live = np.array(kept)
    values = values.copy()
    if len(live) == 1:
        values[live] += rho * z[live] ** 2
    elif len(live):
        values[live], turn = _update(values[live], z[live], rho)
        vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, mean, and the eigenpairs of the scatter matrix of vectors seen so far."""

    def __init__(self, d: int, n: int = 0, mean=None, values=None, vectors=None):
        self.n, self.mean = n, np.zeros(d) if mean is None else mean
        self.values, self.vectors = (np.zeros(d) if values is None else values), (np.eye(d) if vectors is None else vectors)

    def add(self, x: np.ndarray) -> None:
        """One more vector, as a centred rank-one update."""
        off = x - self.mean
        self.n += 1
        self.values, self.vectors = rank_one(self.values, self.vectors, off, (self.n - 1) / self.n)
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        """The spectrum of both: one rank-one update for each pair of the other, and one for the distance of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        off, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * other.n / n)
        self.mean, self.n = self.mean + off * (other.n / n), n
