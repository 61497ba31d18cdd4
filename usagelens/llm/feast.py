"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

The matrix is reduced to tridiagonal form once; the signs of the pivots of the shifted form
(its inertia) count the eigenvalues above any shift.  Counts place cuts in gaps of the
spectrum, so that every interval holds few eigenvalues.  For an interval, a Gauss quadrature of
``(zI - A)^-1 Y`` around a circle through its ends projects a random block Y onto the interval's
eigenvectors, and Rayleigh-Ritz extracts them.  The block is filtered anew until residuals are at
rounding, and the pairs found must be as many as the inertia counts say.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues of an interval, points on a half circle, filterings, fresh starts.
GROUP, NODES, PASSES, STARTS = 6, 8, 40, 4
#: Relative to the trace: gaps that may hold a cut, eigenvalues that count as zero.
GAP, ZERO = 1e-7, 1e-12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a, n = a.copy(), len(a)
    for j in range(n - 2):
        v = a[j + 1:, j].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length:
            v /= length
            a[j + 1:, j:] -= 2 * np.outer(v, v @ a[j + 1:, j:])
            a[j:, j + 1:] -= 2 * np.outer(a[j:, j + 1:] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy()


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above the shift: the positive pivots of the shifted tridiagonal form."""
    diagonal, off = form
    tiny = np.finfo(float).tiny ** 0.5
    above, pivot, before = 0, 1.0, 0.0
    for d, e in zip(diagonal.tolist(), [*(off * off).tolist(), 0.0]):
        pivot = d - shift - before / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
        before = e
    return above


def _bracket(form, rank: int, low: float, high: float) -> tuple[float, float]:
    """Ends between which the eigenvalue of this rank (from 1, falling) lies."""
    for _ in range(40):
        middle = (low + high) / 2
        if count_above(form, middle) >= rank:
            low = middle
        else:
            high = middle
    return low, high


def intervals(form: tuple[np.ndarray, np.ndarray], scale: float, wanted: int
              ) -> list[tuple[float, float, int]]:
    """``low, high, count`` of intervals that together hold the ``wanted`` largest eigenvalues."""
    diagonal, off = form
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    low, high = low - GAP * scale, high + GAP * scale
    n = len(diagonal)
    places: list[tuple[float, float]] = []

    def edge(rank: int) -> float | None:
        """A shift between this eigenvalue and the next, if a gap is there."""
        while len(places) < min(rank + 1, n):
            places.append(_bracket(form, len(places) + 1, low, high))
        if rank == n:
            return low
        gap = places[rank - 1][0] - places[rank][1]
        return places[rank][1] + gap / 2 if gap > GAP * scale else None

    found, top, done = [], high, 0
    while done < wanted:
        edges = {r: e for r in range(done + 1, min(done + GROUP, n) + 1) if (e := edge(r)) is not None}
        last = done + GROUP
        while not edges:  # a cluster of equal eigenvalues stays together
            last += 1
            if (e := edge(last)) is not None:
                edges[last] = e
        past = [r for r in edges if r >= wanted]
        rank = min(past) if past else max(edges)
        found.append((edges[rank], top, rank - done))
        top, done = edges[rank], rank
    return found


def eigenpairs(a: np.ndarray, low: float, high: float, count: int, scale: float, seed: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between the ends, falling, and their vectors as columns."""
    n = len(a)
    middle, radius = (low + high) / 2, (high - low) / 2
    at, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (at + 1))
    for start in range(STARTS):
        rng = np.random.default_rng([seed, start])
        block = rng.normal(size=(n, min(n, count + max(4, count) * (start + 1))))
        for _ in range(PASSES):
            filtered = sum(0.5 * w * np.real(radius * t * np.linalg.solve(
                (middle + radius * t) * np.eye(n) - a, block.astype(complex)))
                for t, w in zip(turns, weights))
            basis = np.linalg.qr(filtered)[0]
            values, mix = np.linalg.eigh(basis.T @ a @ basis)
            block = basis @ mix
            inside = (values > low) & (values < high)
            if inside.sum() == count:
                vectors = block[:, inside]
                off = np.linalg.norm(a @ vectors - vectors * values[inside], axis=0).max()
                if off <= 64 * np.finfo(float).eps * scale:
                    return values[inside][::-1], vectors[:, ::-1]
    raise ArithmeticError(f"{count} eigenvalues counted in an interval were not all found")


def leading(a: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest eigenvalues of a positive semi-definite matrix and unit vectors.

    Eigenvalues that are zero to rounding are left out.
    """
    scale = float(np.trace(a))
    if not scale > 0:
        return np.empty(0), np.empty((len(a), 0))
    form = tridiagonal(a)
    wanted = min(k, count_above(form, ZERO * scale))
    parts = [eigenpairs(a, *part, scale, seed + i)
             for i, part in enumerate(intervals(form, scale, wanted))]
    return (np.concatenate([v for v, _ in parts])[:wanted],
            np.concatenate([u for _, u in parts], axis=1)[:, :wanted])
