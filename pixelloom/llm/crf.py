"""A linear-chain conditional random field with two labels.

A chain is a row of blocks, each with a set of features. Label 1 scores the sum of its features'
weights, label 0 scores zero; a step between neighbours adds a weight for its pair of labels, from
one of several tables, as the step's kind says. Training raises the penalised log-likelihood by full
gradients, from forward and backward sums over all chains at once; decoding is by Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chains:
    """Chains side by side: features of each block as places of ``[chain, step]``, padded to one length."""

    features: np.ndarray  # numbers of features, all blocks in order
    block: np.ndarray  # the block each belongs to
    chain: np.ndarray  # per block its chain
    step: np.ndarray  # per block its place in the chain
    kind: np.ndarray  # per block the kind of the step that leads to it
    label: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return int(self.chain.max()) + 1, int(self.step.max()) + 1


def chains_of(rows: list[list[tuple[list[int], int, int]]]) -> Chains:
    """From chains of blocks ``(features, kind, label)``; chains without blocks are left out."""
    rows = [r for r in rows if r]
    flat = [b for r in rows for b in r]
    return Chains(
        np.array([f for b in flat for f in b[0]], np.int64), np.repeat(np.arange(len(flat)), [len(b[0]) for b in flat]),
        np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.arange(len(r)) for r in rows]),
        np.array([b[1] for b in flat]), np.array([b[2] for b in flat]),
    )


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def likelihood(data: Chains, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels and its gradients by ``weights`` and ``steps[kind, from, to]``."""
    n, length = data.shape
    emit = np.bincount(data.block, weights[data.features], minlength=len(data.label))
    scores, there, kind = np.zeros((n, length, 2)), np.zeros((n, length), bool), np.zeros((n, length), int)
    scores[data.chain, data.step, 1] = emit
    there[data.chain, data.step] = True
    kind[data.chain, data.step] = data.kind
    ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        moved = _log_sum(ahead[:, t - 1, :, None] + steps[kind[:, t]], 1) + scores[:, t]
        ahead[:, t] = np.where(there[:, t, None], moved, ahead[:, t - 1])
    total = _log_sum(ahead[:, -1], 1)
    for t in range(length - 2, -1, -1):
        moved = _log_sum(steps[kind[:, t + 1]] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(there[:, t + 1, None], moved, 0.0)
    share = np.exp(ahead + behind - total[:, None, None])[..., 1]
    label = np.zeros((n, length), int)
    label[data.chain, data.step] = data.label
    rest = data.label - share[data.chain, data.step]
    by_weight = np.bincount(data.features, rest[data.block], minlength=len(weights))
    by_step, value = np.zeros_like(steps), emit[data.label == 1].sum() - total.sum()
    for t in range(1, length):
        own = there[:, t]
        pair = ahead[own, t - 1, :, None] + steps[kind[own, t]] + (scores[own, t] + behind[own, t])[:, None, :] - total[own, None, None]
        np.add.at(by_step, kind[own, t], -np.exp(pair))
        np.add.at(by_step, (kind[own, t], label[own, t - 1], label[own, t]), 1.0)
        value += steps[kind[own, t], label[own, t - 1], label[own, t]].sum()
    return float(value), by_weight, by_step


def train(data: Chains, n_features: int, n_kinds: int, rounds: int = 150, rate: float = 0.3, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and steps of the highest penalised likelihood, by adaptive gradient ascent."""
    weights, steps = np.zeros(n_features), np.zeros((n_kinds, 2, 2))
    seen_w, seen_s = np.full(n_features, 1e-8), np.full(steps.shape, 1e-8)
    for _ in range(rounds):
        _, up_w, up_s = likelihood(data, weights, steps)
        up_w, up_s = up_w - penalty * weights, up_s - penalty * steps
        seen_w, seen_s = seen_w + up_w**2, seen_s + up_s**2
        weights, steps = weights + rate * up_w / np.sqrt(seen_w), steps + rate * up_s / np.sqrt(seen_s)
    return weights, steps


def decode(emit: list[float], kinds: list[int], steps: list) -> list[int]:
    """The labels of the highest score (Viterbi); of equal ones that with more zeros in the end."""
    if not emit:
        return []
    back, zero, one = [], 0.0, emit[0]
    for e, k in zip(emit[1:], kinds[1:]):
        (a, b), (c, d) = steps[k]
        from_zero, from_one = (0 if zero + a >= one + c else 1), (0 if zero + b >= one + d else 1)
        back.append((from_zero, from_one))
        zero, one = (one + c if from_zero else zero + a), (one + d if from_one else zero + b) + e
    label = 0 if zero >= one else 1
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]
