"""Eigenvalues and eigenvectors of a scatter matrix that grows by one vector at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 80        # a root is found in about seven; halving alone would take this many


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z^2 / (d - x))`` for ascending, distinct ``d``, as (pole, distance).

    Root i lies between d[i] and d[i + 1] (the last one below d[-1] + rho * |z|^2). It is given as the nearer pole's
    number and the distance from it, so that differences to all poles keep their relative precision. All roots are
    refined together: two-pole interpolation, and halving where that leaves the bracket.
    """
    k, weight = len(d), rho * z * z
    edges = np.append(d, d[-1] + weight.sum())
    gap = np.diff(edges)
    value = lambda at: 1 + (weight / (d - at[:, None])).sum(1)
    right = value(d + gap / 2) < 0
    right[-1] = False
    pole = np.arange(k) + right
    shifted = d - d[pole][:, None]                      # poles as seen from each root's origin
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.append(gap[:-1] / 2, gap[-1:]))
    near = np.where(right, -gap, 0.0)                   # the interval's two poles, seen from the origin
    far = near + gap
    tau = (low + high) / 2
    left = np.arange(k) <= np.arange(k)[:, None]        # poles at or below each root
    live = np.ones(k, bool)
    for _ in range(ROUNDS):
        gaps = shifted - tau[:, None]
        term = weight / gaps
        f = 1 + term.sum(1)
        slope = term / gaps
        below, above = (slope * left).sum(1), (slope * ~left).sum(1)
        live &= np.abs(f) > 4 * k * EPS * (1 + np.abs(term).sum(1))
        if not live.any():
            break
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        one, two = near - tau, far - tau
        c = f - one * below - two * above
        a = (one + two) * f - one * two * (below + above)
        b = one * two * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = tau + step
        moved = np.where((moved > low) & (moved < high), moved, (low + high) / 2)
        live &= (moved != tau) & (high - low > 2 * EPS * np.abs(tau))
        tau = np.where(live, moved, tau)
    return pole, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + weight v v'``, ``weight`` >= 0.

    Deflation first: a direction that ``v`` does not touch keeps its pair, and of two equal eigenvalues one is turned
    out of ``v``'s way. The secular equation gives the others; their vectors come from weights worked back from the
    roots, which keeps them orthogonal.
    """
    z = vectors.T @ v
    norm = float(np.sqrt(z @ z))
    rho = weight * norm * norm
    top = float(np.abs(values).max(initial=0.0))
    if not rho > 0 or rho <= EPS * EPS * top:
        return values, vectors
    z = z / norm
    limit = 8 * EPS * max(top, rho)
    live = rho * np.abs(z) > limit
    at = np.flatnonzero(live)
    if len(at) > 1 and (np.diff(values[at]) * np.abs(z[at[:-1]] * z[at[1:]]) <= limit).any():
        vectors, values = vectors.copy(), values.copy()
        held = at[0]
        for j in at[1:]:
            r = float(np.hypot(z[held], z[j]))
            c, s = z[j] / r, z[held] / r
            if (values[j] - values[held]) * abs(c * s) <= limit:
                u, w = vectors[:, held].copy(), vectors[:, j].copy()
                vectors[:, held], vectors[:, j] = c * u - s * w, s * u + c * w
                one, two = values[held], values[j]
                values[held], values[j] = one * c * c + two * s * s, one * s * s + two * c * c
                z[j], z[held], live[held] = r, 0.0, False
            held = j
        at = np.flatnonzero(live)
        at = at[np.argsort(values[at], kind="stable")]
    if not len(at):
        return values, vectors
    d, zs = values[at], z[at]
    pole, tau = secular_roots(d, zs, rho)
    apart = (d - d[pole][:, None]) - tau[:, None]       # [root, pole]: pole less root
    away = d - d[:, None]
    np.fill_diagonal(away, 1.0)
    size = np.sqrt(np.exp(np.log(np.abs(apart)).sum(0) - np.log(np.abs(away)).sum(0)))
    turned = np.copysign(size, zs) / apart
    turned /= np.sqrt((turned * turned).sum(1))[:, None]
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[at] = d[pole] + tau
    out_vectors[:, at] = vectors[:, at] @ turned.T
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


@dataclass
class Spectrum:
    """``n`` vectors' mean and the spectrum of their scatter matrix (sum of squares about the mean)."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def _touch(self, v: np.ndarray, weight: float) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v, weight)

    def add(self, rows: np.ndarray) -> None:
        """Take in the rows of a block.

        Each one is a centred rank-one update. A block of more rows than columns is first turned (QR) into as many
        rows as columns with the same scatter about its mean; these are the updates, with one more for the step
        from the old mean to the block's.
        """
        if not len(rows):
            return
        if len(rows) <= rows.shape[1]:
            for row in rows:
                gap = row - self.mean
                self._touch(gap, self.n / (self.n + 1))
                self.n += 1
                self.mean = self.mean + gap / self.n
            return
        mean = rows.mean(0)
        self._join(len(rows), mean, np.linalg.qr(rows - mean, mode="r"))

    def _join(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        gap = mean - self.mean
        self._touch(gap, self.n * n / (self.n + n))
        for row in rows:
            self._touch(row, 1.0)
        self.n += n
        self.mean = self.mean + gap * (n / self.n)

    def merge(self, other: Spectrum) -> None:
        """Take in another spectrum: an update for each of its directions and one for the gap of the means."""
        if other.n:
            self._join(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def to_bytes(self) -> bytes:
        return np.concatenate([self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, n: int, data: bytes) -> Spectrum:
        x = np.frombuffer(data)
        size = int(np.sqrt(len(x) + 1)) - 1
        return cls(n, x[:size].copy(), x[size:2 * size].copy(), x[2 * size:].reshape(size, size).copy())
