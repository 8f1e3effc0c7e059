"""A two-state linear-chain conditional random field over one long chain of many sequences.

State 1 has emission exp(u) at a position and state 0 has 1; ``theta`` holds the logarithms
of the transitions 01, 10, 11 (00 is 0) and of the start in state 1.  A sequence start resets the chain: both
rows of its transition matrix are the start weights, so messages do not pass it.  Messages go in
two levels: products over blocks of about sqrt(n) positions, side by side, then from block to block.
"""

from __future__ import annotations

import numpy as np


def _messages(m: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages (scaled) at every position of the (blocks, length, 2, 2) matrices."""
    _, length = m.shape[:2]
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for k in range(length):
        a, b = whole[:, :, 0], whole[:, :, 1]
        x = m[:, k]
        whole = np.stack([a * x[:, None, 0, 0] + b * x[:, None, 1, 0], a * x[:, None, 0, 1] + b * x[:, None, 1, 1]], axis=2)
        whole /= whole.max(axis=(1, 2), keepdims=True)
    into, back = np.ones((blocks, 2)), np.ones((blocks, 2))
    each = whole.tolist()
    v = (0.5, 0.5)
    for c in range(blocks):
        into[c] = v
        (p, q), (r, s) = each[c]
        x, y = v[0] * p + v[1] * r, v[0] * q + v[1] * s
        v = (x / (x + y), y / (x + y))
    v = (0.5, 0.5)
    for c in range(blocks - 1, -1, -1):
        back[c] = v
        (p, q), (r, s) = each[c]
        x, y = p * v[0] + q * v[1], r * v[0] + s * v[1]
        v = (x / (x + y), y / (x + y))
    forward, backward = np.empty((blocks, length, 2)), np.empty((blocks, length, 2))
    f0, f1 = into.T
    for k in range(length):
        x = m[:, k]
        f0, f1 = f0 * x[:, 0, 0] + f1 * x[:, 1, 0], f0 * x[:, 0, 1] + f1 * x[:, 1, 1]
        total = f0 + f1
        f0, f1 = f0 / total, f1 / total
        forward[:, k, 0], forward[:, k, 1] = f0, f1
    b0, b1 = back.T
    for k in range(length - 1, -1, -1):
        backward[:, k, 0], backward[:, k, 1] = b0, b1
        x = m[:, k]
        b0, b1 = x[:, 0, 0] * b0 + x[:, 0, 1] * b1, x[:, 1, 0] * b0 + x[:, 1, 1] * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return forward, backward


def marginals(u: np.ndarray, starts: np.ndarray, theta: np.ndarray, pairs: bool = False):
    """P(state 1) at each position; with ``pairs`` also the expected counts that ``theta`` weighs.

    ``starts`` has the positions where a sequence begins (0 among them).
    """
    n = len(u)
    if not n:
        return (u, np.zeros(4)) if pairs else u
    e = np.exp(np.clip(u, -30, 30))
    t = np.exp(theta)
    length = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // length)
    m = np.zeros((blocks * length, 2, 2))
    m[n:] = np.eye(2)
    m[:n, 0, 0], m[:n, 0, 1], m[:n, 1, 0], m[:n, 1, 1] = 1.0, t[0] * e, t[1], t[2] * e
    m[starts, :, 0] = 1.0
    m[starts, :, 1] = (t[3] * e[starts])[:, None]
    forward, backward = _messages(m.reshape(blocks, length, 2, 2), blocks)
    forward, backward = forward.reshape(-1, 2)[:n], backward.reshape(-1, 2)[:n]
    joint = forward * backward
    p = joint[:, 1] / joint.sum(axis=1)
    if not pairs:
        return p
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    both = forward[at - 1][:, :, None] * m[at] * backward[at][:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    x = both.sum(axis=0)
    return p, np.array([x[0, 1], x[1, 0], x[1, 1], p[starts].sum()])


def train(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int, rounds: int = 30, rate: float = 0.7, l2: float = 1e-3):
    """(weights, theta) by adaptive gradient ascent on the conditional likelihood of the labels.

    Each part is (features, labels, starts) of some sequences: features are (positions, k) indices below ``size``.  Parts are gone
    through one after the other in each round, so memory follows the largest part.
    """
    w, theta = np.zeros(size), np.zeros(4)
    w2, theta2 = np.full(size, 1e-8), np.full(4, 1e-8)
    for _ in range(rounds):
        g, gt = -l2 * w, -l2 * theta
        for features, y, starts in parts:
            inner = np.ones(len(y), dtype=bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            a, b = y[at - 1], y[at]
            gt += np.array([((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum(), y[starts].sum()], dtype=float)
            p, expected = marginals(sum(w[column] for column in features.T), starts, theta, pairs=True)
            for column in features.T:
                g += np.bincount(column, weights=y - p, minlength=size)
            gt -= expected
        w2 += g * g
        w += rate * g / np.sqrt(w2)
        theta2 += gt * gt
        theta = np.clip(theta + rate * gt / np.sqrt(theta2), -12, 12)
    return w, theta


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Weighted logistic regression with intercept (last), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    ridge = np.diag([l2] * (len(b) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge @ b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        b += step / max(1.0, np.abs(step).max() / 2)
    return b
