"""Eigenvalues and eigenvectors of a symmetric matrix: Householder reduction to tridiagonal form, then implicit QR steps with shifts."""

from __future__ import annotations

import math

import numpy as np

MOST_STEPS = 60


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, the entries beside it, Q) with matrix = Q T Q'. Each step reflects one column and updates the rest by a rank-two term."""
    a = np.array(matrix, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size:
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest to the smallest, unit eigenvectors as rows)."""
    d, e, q = tridiagonal(matrix)
    vectors = np.ascontiguousarray(q.T)  # a rotation of two columns of Q touches two rows here
    high, steps, eps = len(d) - 1, 0, np.finfo(np.float64).eps
    while high > 0:
        small = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if small[-1]:
            high, steps = high - 1, 0
            continue
        if steps > MOST_STEPS:
            raise ArithmeticError("the QR steps do not converge")
        low = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        _step(d, e, vectors, low, high)
        steps += 1
    order = np.argsort(-d, kind="stable")
    return d[order], vectors[order]


def _step(d: np.ndarray, e: np.ndarray, vectors: np.ndarray, low: int, high: int) -> None:
    """One QR step on the unreduced block low..high, shifted by the eigenvalue of its last two rows that lies next to the last entry."""
    half = (d[high - 1] - d[high]) / 2
    shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
    x, bulge = d[low] - shift, e[low]
    for k in range(low, high):
        r = math.hypot(x, bulge)
        c, s = (x / r, bulge / r) if r else (1.0, 0.0)
        if k > low:
            e[k - 1] = r
        a, b, off = d[k], d[k + 1], e[k]
        d[k] = c * c * a + 2 * c * s * off + s * s * b
        d[k + 1] = s * s * a - 2 * c * s * off + c * c * b
        e[k] = c * s * (b - a) + (c * c - s * s) * off
        if k + 1 < high:
            bulge = s * e[k + 1]
            e[k + 1] *= c
            x = e[k]
        upper = c * vectors[k] + s * vectors[k + 1]
        vectors[k + 1] = c * vectors[k + 1] - s * vectors[k]
        vectors[k] = upper
