"""Content or boilerplate, line by line: a linear-chain conditional random field.

The score of a sequence of labels is the sum of what its lines' features give
to boilerplate, of one weight for each pair of neighbouring labels and of one
for each label at either end. Sequences of different lengths are worked on side
by side: all first lines, then all second lines of those that have one, and so
on (:class:`Chains`). Training maximises the likelihood with a ridge by L-BFGS on
the forward-backward gradient; decoding is Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONTENT, BOILERPLATE = 0, 1


class Chains:
    """Where the lines of sequences of given lengths come to lie, step by step, the longest sequence first."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.steps = int(lengths.max(initial=0))
        ends = np.bincount(lengths, minlength=self.steps + 1)
        #: How many sequences have a line at each step.
        self.alive = len(lengths) - np.cumsum(ends)[: self.steps]
        self.offset = np.concatenate([[0], np.cumsum(self.alive)])
        begins = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        step = np.repeat(np.arange(self.steps), self.alive)
        #: For each place, the line that lies there.
        self.line = begins[np.arange(len(step)) - self.offset[:-1][step]] + step
        self.last = np.ones(len(step), bool)
        for t in range(self.steps - 1):
            self.last[self.offset[t] : self.offset[t] + self.alive[t + 1]] = False

    def at(self, t: int) -> slice:
        return slice(self.offset[t], self.offset[t + 1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis=axis, keepdims=True)
    return (high + np.log(np.exp(x - high).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Field:
    """``weights`` of features for boilerplate, ``trans[a, b]`` of label b after a, ``first`` and ``final`` of labels at the ends."""

    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    final: np.ndarray

    @classmethod
    def unpack(cls, theta: np.ndarray) -> Field:
        n = len(theta) - 8
        return cls(theta[:n], theta[n : n + 4].reshape(2, 2), theta[n + 4 : n + 6], theta[n + 6 :])

    def _emissions(self, x: np.ndarray, chains: Chains) -> np.ndarray:
        e = np.zeros((len(x), 2))
        e[:, BOILERPLATE] = (x @ self.weights)[chains.line]
        if chains.steps:
            e[chains.at(0)] += self.first
            e[chains.last] += self.final
        return e

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of the lines ``x`` of sequences one after the other; of equal ones content."""
        chains = Chains(lengths)
        score = self._emissions(x, chains)
        back = np.zeros((len(x), 2), np.int8)
        for t in range(1, chains.steps):
            before = score[chains.offset[t - 1] : chains.offset[t - 1] + chains.alive[t]]
            paths = before[:, :, None] + self.trans
            back[chains.at(t)] = paths.argmax(axis=1)
            score[chains.at(t)] += paths.max(axis=1)
        labels = np.zeros(len(x), np.int8)
        for t in range(chains.steps - 1, -1, -1):
            here = score[chains.at(t)].argmax(axis=1).astype(np.int8)
            if t + 1 < chains.steps:
                n = chains.alive[t + 1]
                here[:n] = back[chains.offset[t + 1] + np.arange(n), labels[chains.at(t + 1)]]
            labels[chains.at(t)] = here
        out = np.zeros(len(x), np.int8)
        out[chains.line] = labels
        return out

    def forward_backward(self, x: np.ndarray, chains: Chains) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the sum over all labellings, probabilities of labels by place, and expected pairs of labels."""
        e = self._emissions(x, chains)
        alpha, beta = e.copy(), np.zeros_like(e)
        for t in range(1, chains.steps):
            before = alpha[chains.offset[t - 1] : chains.offset[t - 1] + chains.alive[t]]
            alpha[chains.at(t)] += _log_sum(before[:, :, None] + self.trans, 1)
        total = _log_sum(alpha[chains.last], 1)
        norm = np.zeros(len(e))
        norm[chains.last] = total
        pairs = np.zeros((2, 2))
        for t in range(chains.steps - 2, -1, -1):
            n = chains.alive[t + 1]
            here = slice(chains.offset[t], chains.offset[t] + n)
            after = (e[chains.at(t + 1)] + beta[chains.at(t + 1)])[:, None, :] + self.trans
            beta[here] = _log_sum(after, 2)
            norm[here] = norm[chains.at(t + 1)]
            pairs += np.exp(alpha[here][:, :, None] + after - norm[here][:, None, None]).sum(axis=0)
        return float(total.sum()), np.exp(alpha + beta - norm[:, None]), pairs


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, chains: Chains, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log likelihood with a ridge, and its gradient."""
    field = Field.unpack(theta)
    total, p, pairs = field.forward_backward(x, chains)
    seen = y[chains.line]
    truth = np.zeros(len(theta))
    n = len(field.weights)
    truth[:n] = x[chains.line].T @ (seen == BOILERPLATE)
    for t in range(chains.steps - 1):
        k = chains.alive[t + 1]
        a, b = seen[chains.offset[t] : chains.offset[t] + k], seen[chains.at(t + 1)]
        truth[n : n + 4] += np.bincount(2 * a + b, minlength=4)
    expected = np.zeros(len(theta))
    expected[:n] = x[chains.line].T @ p[:, BOILERPLATE]
    expected[n : n + 4] = pairs.ravel()
    if chains.steps:
        truth[n + 4 : n + 6] = np.bincount(seen[chains.at(0)], minlength=2)
        truth[n + 6 :] = np.bincount(seen[chains.last], minlength=2)
        expected[n + 4 : n + 6], expected[n + 6 :] = p[chains.at(0)].sum(axis=0), p[chains.last].sum(axis=0)
    return total - float(theta @ truth) + ridge / 2 * float(theta @ theta), expected - truth + ridge * theta


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, ridge: float = 1.0, rounds: int = 80, theta: np.ndarray | None = None) -> np.ndarray:
    """Parameters for the labels ``y`` of the lines ``x``, by L-BFGS with a memory of eight steps."""
    chains = Chains(lengths)
    theta = np.zeros(x.shape[1] + 8) if theta is None else theta
    value, slope = likelihood(theta, x, y, lengths, chains, ridge)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max(initial=0) < 1e-3 * max(1, len(lengths)) ** 0.5:
            break
        way, kept = slope.copy(), []
        for s, d in reversed(steps):
            kept.append((s @ way) / (s @ d))
            way -= kept[-1] * d
        if steps:
            s, d = steps[-1]
            way *= (s @ d) / (d @ d)
        for (s, d), a in zip(steps, reversed(kept)):
            way += s * (a - (d @ way) / (s @ d))
        size = 1.0 if steps else 1 / max(1.0, float(np.abs(slope).max()))
        while size > 1e-10:
            to = theta - size * way
            new_value, new_slope = likelihood(to, x, y, lengths, chains, ridge)
            if new_value <= value - 1e-4 * size * float(slope @ way):
                break
            size /= 2
        else:
            break
        if (to - theta) @ (new_slope - slope) > 1e-12:
            steps = [*steps[-7:], (to - theta, new_slope - slope)]
        theta, value, slope = to, new_value, new_slope
    return theta
