"""Eigenvectors of a symmetric matrix: float32 first, then refined by products in higher precision.

One step of Ogita and Aishima's iteration corrects all eigenvectors at once from X'X and X'AX and
converges quadratically where eigenvalues are apart. For eigenvalues too close to be told
apart at the present error, the matrix is projected on their common space, shifted and solved anew there;
so relative gaps become large and the iteration goes on.
"""

from __future__ import annotations

import numpy as np

MOST_STEPS = 30


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Runs of two or more eigenvalues whose neighbours are not further apart than ``apart``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def _step(a: np.ndarray, x: np.ndarray, least: float):
    """One correction: (better vectors, values, size of the correction, gap from which on values are apart).

    Gaps up to ``least`` are below the rounding of the matrix itself: any basis is right there.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    apart = 2 * (np.linalg.norm((s - np.diag(values)).astype(float))
                 + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    gap = values[None, :] - values[:, None]
    told = np.abs(gap) > max(apart, least)
    e = np.where(told, (s + values[None, :] * r) / np.where(told, gap, 1), r / 2)
    return x + x @ e, values, float(np.abs(e).max()), apart


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, apart: float) -> np.ndarray:
    x = x.copy()
    for run in _clusters(values, apart):
        own, _ = np.linalg.qr(x[:, run].astype(float))
        own = own.astype(a.dtype)
        own = own @ (1.5 * np.eye(len(run), dtype=a.dtype) - 0.5 * (own.T @ own))
        # the least shift leaves the sub-problem only what tells its eigenvalues apart
        middle = values[run].mean()
        part = own.T @ (a @ own - middle * own)
        size = float(np.abs(part).max())
        if size > 0:
            part = ((part + part.T) / (2 * size)).astype(float)
            own = own @ np.linalg.eigh(part)[1].astype(a.dtype)
        x[:, run] = own
    return x


def refined(matrix: np.ndarray, exact=np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) to double precision.

    The matrix must be symmetric and finite. A matrix of zeros has unit vectors of the axes.
    """
    scale = float(np.abs(matrix).max(initial=0))
    if scale == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = matrix.astype(exact) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(exact)
    tiny = float(np.finfo(float).eps) / 64
    rounding, smallest = 4 * float(np.finfo(float).eps) * float(np.linalg.norm(a.astype(float))), np.inf
    for step in range(MOST_STEPS):
        x, values, change, apart = _step(a, x, rounding)
        close = apart > rounding and bool(_clusters(values, apart))
        # where eigenvalues nearly meet, the correction ends at the rounding of the products
        if not close and (change < tiny or step > 6 and change > smallest / 2):
            break
        smallest = min(smallest, change)
        if close and step % 3 == 1:
            x, smallest = _solve_clusters(a, x, values, apart), np.inf
    for _ in range(2):
        x = x @ (1.5 * np.eye(len(a), dtype=exact) - 0.5 * (x.T @ x))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(float), x[:, order].astype(float)
