"""Singular values and right singular vectors of a small triangular factor.

Householder reflections make it bidiagonal, dqds finds the singular values to high relative accuracy, twisted
factorisations give the vectors of the bidiagonal one, and the reflections carry them back.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = np.finfo(np.float64).tiny
CLOSE = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v and the value a such that (I - 2 v v^T) x = a e_1."""
    a = -math.copysign(float(np.linalg.norm(x)), float(x[0]))
    v = x.copy()
    v[0] -= a
    size = float(np.linalg.norm(v))
    return (v / size, a) if size > 0 else (np.zeros_like(x), float(x[0]))


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflectors (the k-th acts on entries k + 1 and up) of a square matrix."""
    a = np.array(r, np.float64)
    d = len(a)
    right = []
    for k in range(d):
        v, top = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        a[k, k] = top
        if k + 2 < d:
            v, _ = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential quotient-difference step; None where the shift exceeds the smallest value."""
    d, top, side = q[0] - shift, [], []
    if d < 0:
        return None
    for k in range(len(e)):
        up = d + e[k]
        if up <= 0:  # both are zero: the pair of rows is already apart
            top.append(0.0)
            side.append(0.0)
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / up
            top.append(up)
            side.append(e[k] * t)
            d = d * t - shift
        if d < 0:
            return None
    return [*top, d], side


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling."""
    d = len(diagonal)
    scale = max([1e-300, *map(abs, diagonal.tolist()), *map(abs, above.tolist())])
    q = [(x / scale) ** 2 for x in diagonal.tolist()]
    e = [(x / scale) ** 2 for x in above.tolist()]
    found: list[float] = []
    work = [(q, e, 0.0)]
    while work:
        q, e, moved = work.pop()
        rounds = 0
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (moved + q[k]) or e[k] <= EPS * EPS * (moved + q[k + 1]) or e[k] < TINY), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if rounds == 0 and q[0] < q[-1]:  # small values deflate at the end
                q, e = q[::-1], e[::-1]  # the transpose read from its other end
            rounds += 1
            shift, step = _smallest(q[-2], e[-1], q[-1]) * (1 - 4 * EPS), None
            while step is None:
                step = _dqds(q, e, shift)
                if step is None:
                    shift = shift / 4 if shift > EPS * EPS * (moved + q[-1]) else 0.0
            q, e = step
            moved += shift
            if rounds > 60 * d:
                raise ArithmeticError("singular values did not settle")
    return np.sort(np.sqrt(np.maximum(found, 0)))[::-1] * scale


def _smallest(a: float, b: float, c: float) -> float:
    """Smaller eigenvalue of the last two rows of B B^T: [[a + b, sqrt(b c)], [., c]]."""
    trace, det = a + b + c, a * c
    root = math.sqrt(max(0.0, (a + b - c) ** 2 + 4 * b * c))
    return max(0.0, 2 * det / (trace + root)) if trace + root > 0 else 0.0


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[list[float], list[float], np.ndarray]:
    """Multipliers from both ends of B^T B - value, and the twist pivots."""
    size, floor = len(diagonal), EPS * EPS * max(float(np.max(diagonal**2, initial=0)), TINY)
    a, b = (diagonal * diagonal).tolist(), (above * above).tolist()
    ab = (diagonal[:-1] * above).tolist()
    away = lambda x: x if abs(x) > floor else math.copysign(floor, x)
    s, low = -value, []
    starts = [s]
    for k in range(size - 1):
        pivot = away(s + a[k])
        low.append(ab[k] / pivot)
        s = (b[k] * s / pivot if b[k] else 0.0) - value
        starts.append(s)
    p, up = a[-1] - value, [0.0] * (size - 1)
    ends = [p] * size
    for k in range(size - 2, -1, -1):
        pivot = away(b[k] + p)
        up[k] = ab[k] / pivot
        p = (p * a[k] / pivot if b[k] else a[k]) - value
        ends[k] = p
    return low, up, np.array(starts) + np.array(ends) + value


def _vector(low: list[float], up: list[float], twist: int) -> np.ndarray:
    z = np.zeros(len(low) + 1)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -low[k] * z[k + 1]
    for k in range(twist, len(up)):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def bidiagonal_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of the given singular values, falling and counted from the largest.

    One vector a value from its best twist. Where values lie within ``CLOSE`` of each other the group's vectors are
    made orthogonal; a vector that its predecessors already span comes from the next best twist.
    """
    top, found = max(float(np.max(np.abs(diagonal), initial=0)), TINY), []
    above = np.where(np.abs(above) <= EPS * top, 0.0, above)
    for k, value in enumerate(values.tolist()):
        low, up, pivots = _twisted(diagonal, above, value * value)
        near = [found[j] for j in range(k) if values[j] - value <= CLOSE * value]
        for twist in np.argsort(np.abs(pivots), kind="stable").tolist():
            z = _vector(low, up, twist)
            for _ in range(2):
                for other in near:
                    z = z - other * (other @ z)
            size = np.linalg.norm(z)
            if size > 0.1 or not near:
                break
        found.append(z / np.linalg.norm(z))
    return np.array(found).T if found else np.zeros((len(diagonal), 0))


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of a square matrix, falling, and right singular vectors (columns) of at most ``k`` largest.

    Values that rounding cannot tell from zero get no vector.
    """
    scale = float(np.max(np.abs(r), initial=0))
    if scale == 0:
        return np.zeros(len(r)), np.zeros((len(r), 0))
    diagonal, above, reflectors = bidiagonalise(r / scale)
    values = singular_values(diagonal, above)
    z = bidiagonal_vectors(diagonal, above, values[:k][values[:k] > len(r) * EPS * values[0]])
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        z[j + 1:] -= 2 * np.outer(v, v @ z[j + 1:])
    return values * scale, z
