"""Weak supervision: reliabilities of voters that may abstain, by expectation-maximisation.

Only counts of vote patterns enter, so the work on the driver is bounded by the
number of patterns (3 to the power of the voters) and not by the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Votes: against, abstain, for; coded 0, 1, 2.
AGAINST, ABSTAIN, FOR = 0, 1, 2


@dataclass(frozen=True)
class Reliability:
    """log_ratio[r, vote]: what a vote of rule r adds to the log odds; prior: the log odds before any vote."""

    log_ratio: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = self.prior + self.log_ratio[np.arange(votes.shape[1]), votes].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def estimate(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60, strength: float = 20.0) -> Reliability:
    """votes: patterns x rules; counts: how often each pattern occurs; prior: expected share of the positive class.

    Each rule has a distribution of votes in either class. A Dirichlet prior of so many pseudo-votes says that rules
    are better than chance, which settles which class is which; with no patterns the prior is the answer.
    """
    n, rules = votes.shape
    base_pos, base_neg = np.array([0.05, 0.3, 0.65]), np.array([0.65, 0.3, 0.05])
    p, pos, neg = prior, np.tile(base_pos, (rules, 1)), np.tile(base_neg, (rules, 1))
    one_hot = votes[:, :, None] == np.arange(3)
    for _ in range(rounds):
        z = np.log(p / (1 - p)) + np.log(pos / neg)[np.arange(rules), votes].sum(axis=1) if n else np.zeros(0)
        q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        a, b = counts * q, counts * (1 - q)
        pos = np.einsum("i,irv->rv", a, one_hot) + strength * base_pos
        neg = np.einsum("i,irv->rv", b, one_hot) + strength * base_neg
        pos, neg = pos / pos.sum(axis=1, keepdims=True), neg / neg.sum(axis=1, keepdims=True)
        new = float(np.clip((a.sum() + strength * prior) / (counts.sum() + strength), 0.01, 0.99))
        if abs(new - p) < 1e-7:
            break
        p = new
    return Reliability(np.log(pos / neg), float(np.log(p / (1 - p))))
