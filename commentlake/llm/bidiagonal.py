"""Singular values and right singular vectors of a small triangular matrix, by its bidiagonal form.

Householder reflections make it bidiagonal; dqds finds the squared singular values
one by one, each to high relative accuracy; a twisted factorisation of the shifted
tridiagonal product gives each vector. Everything here is numpy over one matrix
whose side is the number of dimensions.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
#: Vectors whose values are nearer than this, relatively, are made orthogonal explicitly.
NEAR = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, superdiagonal, right reflections) of the square ``r``."""
    a = np.array(r, dtype=float)
    n = a.shape[0]
    right: list[tuple[int, np.ndarray]] = []

    def reflect(x: np.ndarray) -> np.ndarray | None:
        """The unit vector whose reflection maps x to a multiple of the first axis."""
        rest = float(np.abs(x[1:]).max()) if len(x) > 1 else 0.0
        if rest == 0.0:
            return None
        x = x / max(rest, abs(x[0]))
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflect(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflect(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ v, v)
                right.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


# ---- dqds ------------------------------------------------------------------
def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One differential step: the qd array of B B' - shift, and its d; None if the shift was too large."""
    n = len(q)
    q2, e2, ds = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        ds[k] = d
        q2[k] = d + e[k]
        ratio = q[k + 1] / q2[k] if q2[k] > 0 else 1.0
        e2[k] = e[k] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    ds[-1] = q2[-1] = d
    return q2, e2, ds


def _below(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the least eigenvalue: one over the trace of the inverse (a Newton step from below)."""
    d, total = q[0], 0.0
    for k in range(len(q) - 1):
        if d <= 0:
            return 0.0
        total += 1.0 / d
        d *= q[k + 1] / (d + e[k])
    return 0.0 if d <= 0 else 1.0 / (total + 1.0 / d)


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling."""
    scale = max(float(np.abs(diagonal).max(initial=0.0)), float(np.abs(above).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    todo = [((diagonal / scale) ** 2, (above / scale) ** 2, 0.0)]
    small = (4 * EPS) ** 2
    while todo:
        q, e, gone = todo.pop()
        while len(q):
            cut = np.flatnonzero(e <= small * (gone + np.minimum(q[:-1], q[1:])))
            if len(cut):
                at = int(cut[-1]) + 1
                todo.append((q[:at], e[: at - 1], gone))
                q, e = q[at:], e[at:]
                continue
            if len(q) == 1:
                found.append(gone + float(q[0]))
                break
            if q[0] < q[-1] * 2.0**-10:  # graded the wrong way: the flipped transpose has the same values
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = _below(q, e)
            step = _dqds(q, e, shift)
            while step is None:
                shift = shift * (1 - 1e-3) if shift > gone * EPS else 0.0
                step = _dqds(q, e, shift)
            q, e, _ = step
            gone += shift
    return np.sort(np.array(found))[::-1] * scale * scale


# ---- vectors ---------------------------------------------------------------
def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """A unit eigenvector of B'B near ``value``, from the twisted factorisation with the least pivot."""
    n = len(diagonal)
    floor = EPS * max(float(np.abs(diagonal).max()), float(np.abs(above).max(initial=0.0)), TINY)
    d = np.where(np.abs(diagonal) < floor, np.copysign(floor, diagonal), diagonal)
    dd, low = d * d, (above / d[:-1] if n > 1 else above)
    nil = max(value, float(dd.max())) * EPS * EPS + TINY  # in place of a pivot that vanishes
    s, up = np.empty(n), np.empty(max(0, n - 1))  # from the top
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + dd[k]
        pivot = pivot if abs(pivot) > nil else nil
        up[k] = dd[k] * low[k] / pivot
        s[k + 1] = up[k] * low[k] * s[k] - value
    p, down = np.empty(n), np.empty(max(0, n - 1))  # from the bottom
    p[-1] = dd[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = dd[k] * low[k] ** 2 + p[k + 1]
        pivot = pivot if abs(pivot) > nil else nil
        ratio = dd[k] / pivot
        down[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    at = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -up[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -down[k] * z[k]
    return z / np.linalg.norm(z)


def _polished(diagonal: np.ndarray, above: np.ndarray, value: float, others: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Inverse iteration against near vectors already found, where twisted ones nearly coincide."""
    n = len(diagonal)
    t = np.diag(diagonal**2)
    t[np.arange(1, n), np.arange(1, n)] += above**2
    off = diagonal[:-1] * above
    t += np.diag(off, 1) + np.diag(off, -1) - np.eye(n) * value * (1 + 4 * EPS)
    t[np.diag_indices(n)] += EPS * value * np.where(np.arange(n) % 2, 1.0, -1.0)
    z = start
    for _ in range(4):
        z = np.linalg.solve(t, z)
        z /= np.linalg.norm(z)
        for _ in range(2):
            z -= others.T @ (others @ z)
        z /= np.linalg.norm(z)
    return z


def leading(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all squared singular values falling, the leading positive ones, their right vectors as orthonormal rows)."""
    n = r.shape[0]
    if n == 0 or not np.abs(r).max():
        return np.zeros(n), np.zeros(0), np.zeros((0, n))
    d, e, reflections = bidiagonalise(r)
    scale = max(float(np.abs(d).max()), float(np.abs(e).max(initial=0.0)))
    d, e = d / scale, e / scale
    # Blocks that do not touch have vectors of their own, however near their values are.
    edges = [0, *(np.flatnonzero(np.abs(e) <= EPS * (np.abs(d[:-1]) + np.abs(d[1:]))) + 1).tolist(), n]
    found = [(x, lo, hi) for lo, hi in zip(edges, edges[1:], strict=False) for x in squared_values(d[lo:hi], e[lo : hi - 1])]
    found.sort(key=lambda x: -x[0])
    # Below this a value is rounding of the reduction itself: no direction is known for it.
    top = [x for x in found[:most] if x[0] > found[0][0] * (4 * n * EPS) ** 2]
    vectors, rng = np.zeros((len(top), n)), np.random.default_rng(7)
    for k, (value, lo, hi) in enumerate(top):
        z = twisted(d[lo:hi], e[lo : hi - 1], value)
        near = [j for j in range(k) if top[j][1] == lo and top[j][0] - value <= NEAR * value]
        if near:
            others = vectors[near, lo:hi]
            left = z - others.T @ (others @ z)
            if np.linalg.norm(left) < 0.5:
                z = _polished(d[lo:hi], e[lo : hi - 1], value, others, rng.standard_normal(hi - lo))
            else:
                z = left - others.T @ (others @ left)
                z /= np.linalg.norm(z)
        vectors[k, lo:hi] = z
    for at, v in reversed(reflections):
        vectors[:, at:] -= 2.0 * np.outer(vectors[:, at:] @ v, v)
    values = np.array([x[0] for x in found]) * scale * scale
    return values, values[: len(top)], vectors
