"""Singular values and right vectors of a small matrix: Householder, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Neighbours closer than this share of their size are made orthogonal to each other.
CLUSTER = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V with matrix = U B V', by reflections from both sides."""
    m = np.array(matrix, dtype=float)
    n = m.shape[1]
    if len(m) < n:
        m = np.vstack([m, np.zeros((n - len(m), n))])
    v = np.eye(n)
    for i in range(n):
        _reflect(m[i:, i:])
        if i < n - 2:
            w = _reflect(m[i:, i + 1 :].T)
            v[:, i + 1 :] -= 2 * np.outer(v[:, i + 1 :] @ w, w)
    return np.diagonal(m)[:n].copy(), np.diagonal(m, 1)[: n - 1].copy(), v


def _reflect(block: np.ndarray) -> np.ndarray:
    """Reflect the rows' space of ``block`` in place so that its first column keeps one entry."""
    w = block[:, 0].copy()
    size = np.abs(w).max(initial=0.0)
    if size == 0 or not w[1:].any():
        return np.zeros(len(w))
    w /= size
    w[0] += np.copysign(np.linalg.norm(w), w[0])
    w /= np.linalg.norm(w)
    block -= 2 * np.outer(w, w @ block)
    return w


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B, falling, by differential quotient-difference steps with shifts.

    Each value comes out with a small error relative to itself. A step whose shift is too
    large shows a negative number and is taken back.
    """
    found: list[float] = []
    todo = [(list(a * a), list(b * b), 0.0, 0.0)]
    while todo:
        q, e, shift, rest = todo.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(max(q.pop() + shift + rest, 0.0))
                continue
            cut = next((i for i in range(n - 1) if e[i] <= EPS * EPS * q[i]
                        or (i == n - 2 and e[i] <= EPS * EPS * (shift + q[n - 1]))), None)
            if cut is not None:
                todo.append((q[cut + 1 :], e[cut + 1 :], shift, rest))
                q, e = q[: cut + 1], e[:cut]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            q, e, taken = _step(q, e)
            total = shift + taken
            rest += taken - (total - shift)
            shift = total
    return np.sort(found)[::-1]


def _shift(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows, which no smallest eigenvalue exceeds."""
    before = e[-2] if len(e) > 1 else 0.0
    a, c = q[-2] + before, q[-1] + e[-1]
    det = q[-2] * q[-1] + before * c
    half = (a + c) / 2
    return det / (half + np.sqrt(max(half * half - det, 0.0))) if half > 0 else 0.0


def _step(q: list[float], e: list[float]) -> tuple[list[float], list[float], float]:
    shift = _shift(q, e) * (1 - 4 * EPS)
    for attempt in range(5):
        if attempt == 4:
            shift = 0.0
        d = lowest = q[0] - shift
        new_q, new_e = [], []
        for i in range(len(e)):
            if d < 0:
                break
            new_q.append(d + e[i])
            ratio = q[i + 1] / new_q[-1] if new_q[-1] > 0 else 0.0
            new_e.append(e[i] * ratio)
            d = d * ratio - shift
            lowest = min(lowest, d)
        if d >= 0:
            return [*new_q, d], new_e, shift
        # Failed at the last number: its deficit leads to a shift just below the eigenvalue.
        late = len(new_q) == len(e) and attempt == 0
        shift = max(0.0, shift + d) if late else shift / 4
    return q, e, 0.0


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of B'B and their vectors, as columns.

    A vector comes from the twisted factorisation of the block that it belongs to, cut where
    its factors from both ends meet with the least rest. Vectors of close values are made
    orthogonal to each other.
    """
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    n = len(a)
    a = np.where(np.abs(a) > EPS * size, a, EPS * size)
    joins = np.abs(b) > EPS * size
    edges = [0, *(np.flatnonzero(~joins) + 1).tolist(), n]
    pairs: list[tuple[float, int, np.ndarray]] = []
    for low, high in zip(edges, edges[1:], strict=False):
        own_a, own_b = a[low:high], b[low : high - 1]
        own = values if high - low == n else squared_values(own_a, own_b)
        d, l = own_a * own_a, own_b / own_a[:-1]  # noqa: E741
        group: list[np.ndarray] = []
        for i, value in enumerate(own[:wanted]):
            if i and own[i - 1] - value > CLUSTER * own[i - 1]:
                group = []
            z = _vector(d, l, float(value), group)
            group.append(z)
            whole = np.zeros(n)
            whole[low:high] = z
            pairs.append((float(value), low, whole))
    pairs.sort(key=lambda p: -p[0])
    return np.array([p[0] for p in pairs[:wanted]]), np.stack([p[2] for p in pairs[:wanted]], axis=1)


def _factors(d: np.ndarray, l: np.ndarray, value: float):  # noqa: E741
    """L D L' - value from the top (s, plus, lower) and from the bottom (p, minus, upper)."""
    n, tiny = len(d), EPS * EPS * max(value, float(np.abs(d).max()), 1e-300)
    s, p = np.empty(n), np.empty(n)
    plus, lower, upper = np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        plus[i] = (d[i] + s[i]) or tiny
        lower[i] = d[i] * l[i] / plus[i]
        s[i + 1] = lower[i] * l[i] * s[i] - value
    plus[n - 1] = (d[n - 1] + s[n - 1]) or tiny
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        minus = (d[i] * l[i] * l[i] + p[i + 1]) or tiny
        upper[i] = l[i] * d[i] / minus
        p[i] = p[i + 1] * d[i] / minus - value
    return s, p, plus, lower, upper


def _vector(d: np.ndarray, l: np.ndarray, value: float, group: list[np.ndarray]) -> np.ndarray:  # noqa: E741
    n = len(d)
    if n == 1:
        return np.ones(1)
    s, p, plus, lower, upper = _factors(d, l, value)
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    z, share = _apart(z / np.linalg.norm(z), group)
    if share < 0.5:
        # An equal value had this vector: another one is found by inverse iteration.
        z, _ = _apart(np.random.default_rng(n + len(group)).normal(size=n), group)
        for _ in range(3):
            for i in range(1, n):
                z[i] -= lower[i - 1] * z[i - 1]
            z = z / plus
            for i in range(n - 2, -1, -1):
                z[i] -= lower[i] * z[i + 1]
            z, _ = _apart(z / np.linalg.norm(z), group)
    return z


def _apart(z: np.ndarray, group: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """z without its shares of the group, at length 1, and the length that was left of it."""
    before = np.linalg.norm(z)
    for _ in range(2):
        for other in group:
            z = z - (other @ z) * other
    left = np.linalg.norm(z)
    return z / (left or 1.0), float(left / (before or 1.0))


def largest_right(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest squared singular values, falling, their right vectors, and the sum of all squares."""
    a, b, v = bidiagonalise(matrix)
    values = squared_values(a, b)
    top, vectors = right_vectors(a, b, values, wanted)
    return top, v @ vectors, float(values.sum())
