"""Linear-chain conditional random field with two states (0 and 1), in numpy.

The score of a labelling is the sum of `w . x` over the positions in state 1 plus `move[i, j]` for each step from i to j; the first position
has no step. Fitting maximises the regularised conditional likelihood on the driver, over a sample whose bound the caller documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import numpy as np

LIMIT = 30.0


@dataclass
class Chain:
    w: np.ndarray
    move: np.ndarray  # 2 x 2

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w, -LIMIT, LIMIT)

    def marginals(self, unary: list[float]) -> list[float]:
        """P(state 1) at each position of one sequence, by forward and backward odds."""
        n = len(unary)
        if not n:
            return []
        t00, t01, t10, t11 = (exp(v) for v in self.move.ravel())
        e = [exp(u) for u in unary]
        ahead = [0.0] * n
        a = ahead[0] = e[0]
        for i in range(1, n):
            a = ahead[i] = e[i] * (t01 + t11 * a) / (t00 + t10 * a)
        out = [0.0] * n
        b = 1.0
        out[-1] = a / (1 + a)
        for i in range(n - 2, -1, -1):
            x = b * e[i + 1]
            b = (t10 + t11 * x) / (t00 + t01 * x)
            odds = ahead[i] * b
            out[i] = odds / (1 + odds)
        return out

    def viterbi(self, unary: list[float]) -> list[int]:
        """The best labelling of one sequence; ties go to state 0."""
        if not unary:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one, back = 0.0, unary[0], []
        for u in unary[1:]:
            from0, from1 = int(zero + m00 < one + m10), int(zero + m01 < one + m11)
            back.append((from0, from1))
            zero, one = max(zero + m00, one + m10), u + max(zero + m01, one + m11)
        at = int(one > zero)
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        return path[::-1]


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _objective(theta: np.ndarray, x: np.ndarray, y: np.ndarray, steps: list[np.ndarray], l2: float) -> tuple[float, np.ndarray]:
    """Negative log likelihood and gradient. steps[t]: rows at place t of the sequences longer than t, longest first."""
    d = x.shape[1]
    w, move = theta[:d], theta[d:].reshape(2, 2)
    u = x @ w
    f = np.zeros((len(u), 2))
    f[steps[0], 1] = u[steps[0]]
    for t in range(1, len(steps)):
        now, before = steps[t], f[steps[t - 1][: len(steps[t])]]
        f[now, 0] = _lse(before[:, 0] + move[0, 0], before[:, 1] + move[1, 0])
        f[now, 1] = u[now] + _lse(before[:, 0] + move[0, 1], before[:, 1] + move[1, 1])
    b = np.zeros_like(f)
    pair = np.zeros((2, 2))
    gold = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        now, before = steps[t], steps[t - 1][: len(steps[t])]
        one = b[now, 1] + u[now]
        b[before, 0] = _lse(move[0, 0] + b[now, 0], move[0, 1] + one)
        b[before, 1] = _lse(move[1, 0] + b[now, 0], move[1, 1] + one)
        z = _lse(f[now, 0] + b[now, 0], f[now, 1] + b[now, 1])
        for i in (0, 1):
            for j, tail in ((0, b[now, 0]), (1, one)):
                pair[i, j] += np.exp(f[before, i] + move[i, j] + tail - z).sum()
        np.add.at(gold, (y[before], y[now]), 1)
    z = _lse(f[:, 0] + b[:, 0], f[:, 1] + b[:, 1])
    p = np.exp(f[:, 1] + b[:, 1] - z)
    first = steps[0]
    value = z[first].sum() - (u * y).sum() - (gold * move).sum() + l2 / 2 * (theta @ theta)
    grad = np.concatenate([x.T @ (p - y), (pair - gold).ravel()]) + l2 * theta
    return float(value), grad


def _lbfgs(f, theta: np.ndarray, iterations: int, memory: int = 8) -> np.ndarray:
    value, grad = f(theta)
    s, y = [], []
    for _ in range(iterations):
        q, alphas = grad.copy(), []
        for a, b in zip(reversed(s), reversed(y)):
            alphas.append((a @ q) / (a @ b))
            q -= alphas[-1] * b
        q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1]) if s else 1 / max(1.0, np.linalg.norm(grad))
        for a, b, k in zip(s, y, reversed(alphas)):
            q += (k - (b @ q) / (a @ b)) * a
        step = 1.0
        while True:
            new = theta - step * q
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * step * (grad @ q) or step < 1e-6:
                break
            step /= 2
        moved, bent = new - theta, new_grad - grad
        if moved @ bent > 1e-10:
            s, y = [*s, moved][-memory:], [*y, bent][-memory:]
        done = abs(value - new_value) <= 1e-6 * abs(value)
        theta, value, grad = new, new_value, new_grad
        if done:
            break
    return theta


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, l2: float = 1.0, iterations: int = 60) -> Chain:
    """x: features of all positions, sequence after sequence; y: states; lengths: of the sequences (each at least 1)."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    steps = [starts[: np.searchsorted(-sizes, -t, side="left")] + t for t in range(int(sizes[0]))]
    theta = _lbfgs(lambda v: _objective(v, x, y, steps, l2), np.zeros(x.shape[1] + 4), iterations)
    return Chain(theta[: x.shape[1]], theta[x.shape[1]:].reshape(2, 2))


def logit(p: float, edge: float = 1e-6) -> float:
    p = min(max(p, edge), 1 - edge)
    return log(p / (1 - p))
