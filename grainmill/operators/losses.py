"""Row-wise preference losses over log-probabilities that are given as columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import clipped, exp_capped, logsigmoid, sigmoid


@dataclass(frozen=True)
class Pair:
    """Log-probabilities of both sides under the policy and the reference."""

    chosen: Column
    rejected: Column
    ref_chosen: Column
    ref_rejected: Column

    @property
    def gain(self) -> Column:
        return self.chosen - self.ref_chosen

    @property
    def loss(self) -> Column:
        return self.rejected - self.ref_rejected

    @property
    def margin(self) -> Column:
        return (self.chosen - self.rejected) - (self.ref_chosen - self.ref_rejected)


def _softplus(x: Column) -> Column:
    return -logsigmoid(-x)


def divergence_margin(p: Pair, kind: str = "reverse_kl", alpha: float = 0.5) -> Column:
    """The margin under another f-divergence: reverse_kl, js, or alpha."""
    if kind == "alpha":
        return (exp_capped(-alpha * p.loss) - exp_capped(-alpha * p.gain)) / alpha
    if kind == "js":
        return p.margin - (_softplus(p.gain) - _softplus(p.loss))
    if kind == "reverse_kl":
        return p.margin
    raise ValueError(f"unknown divergence {kind!r}")


def _smoothed(x: Column, smoothing: float) -> Column:
    return -(1 - smoothing) * logsigmoid(x) - smoothing * logsigmoid(-x)


def dpo_loss(kind: str, p: Pair, beta: float = 0.1, smoothing: float = 0.0, divergence: str = "reverse_kl", delta: Column | None = None, gap: Column | None = None, tau: float = 0.05, nll: Column | None = None) -> Column:
    """One of the pair losses. bco_pair needs `delta`, the running mean of rewards; aot and aot_pair need `gap`, the sorted
    difference of log-ratios (advantages.sorted_gap); sft needs `nll`."""
    m = divergence_margin(p, divergence)
    z = beta * m
    s = smoothing or 1e-3
    needs = {"bco_pair": delta, "aot": gap, "aot_pair": gap, "sft": nll}
    if kind in needs and needs[kind] is None:
        raise ValueError(f"{kind} needs a further column")
    kinds: dict[str, Callable[[], Column]] = {
        "sigmoid": lambda: _smoothed(z, smoothing),
        "robust": lambda: (-(1 - smoothing) * logsigmoid(z) + smoothing * logsigmoid(-z)) / (1 - 2 * smoothing),
        "exo_pair": lambda: sigmoid(z) * (logsigmoid(z) - math.log(1 - s)) + sigmoid(-z) * (logsigmoid(-z) - math.log(s)),
        "hinge": lambda: F.greatest(F.lit(0.0), 1 - z),
        "ipo": lambda: F.pow(m - 1 / (2 * beta), F.lit(2.0)),
        "bco_pair": lambda: -logsigmoid(beta * p.gain - delta) - logsigmoid(-(beta * p.loss - delta)),
        "sppo_hard": lambda: F.pow(p.gain - 0.5 / beta, F.lit(2.0)) + F.pow(p.loss + 0.5 / beta, F.lit(2.0)),
        "nca_pair": lambda: -logsigmoid(beta * p.gain) - 0.5 * logsigmoid(-beta * p.gain) - 0.5 * logsigmoid(-beta * p.loss),
        "aot": lambda: _smoothed(beta * gap, smoothing),
        "aot_pair": lambda: _smoothed(beta * gap, smoothing),
        "apo_zero": lambda: 1 - sigmoid(beta * p.gain) + sigmoid(beta * p.loss),
        "apo_down": lambda: sigmoid(beta * p.gain) + 1 - sigmoid(beta * (p.gain - p.loss)),
        "discopop": lambda: -logsigmoid(z) * (1 - sigmoid(z / tau)) + F.exp(-z) * sigmoid(z / tau),
        "sft": lambda: nll,
    }
    if kind not in kinds:
        raise ValueError(f"unknown loss {kind!r}")
    return kinds[kind]()


def implicit_reward(policy: Column, reference: Column, beta: float = 0.1) -> Column:
    return beta * (policy - reference)


def reference_free_loss(kind: str, chosen: Column, rejected: Column, beta: float = 0.1, smoothing: float = 0.0, gamma: float = 0.5) -> Column:
    m = chosen - rejected
    kinds = {
        "simpo": lambda: _smoothed(beta * (m - gamma / beta), smoothing),
        "sigmoid": lambda: _smoothed(beta * m, smoothing),
        "hinge": lambda: F.greatest(F.lit(0.0), 1 - beta * m),
        "ipo": lambda: F.pow(m - 1 / (2 * beta), F.lit(2.0)),
    }
    if kind not in kinds:
        raise ValueError(f"unknown loss {kind!r}")
    return kinds[kind]()


def odds_ratio_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    """Of mean log-probabilities below 0."""
    log_odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -beta * logsigmoid(log_odds)


def kto_loss(label: Column, logratio: Column, kl: Column, beta: float = 0.1, desirable: float = 1.0, undesirable: float = 1.0) -> Column:
    """`kl`: the batch's mean log-ratio of mismatched pairs; below 0 it counts 0."""
    z = F.greatest(kl, F.lit(0.0))
    return F.when(label, desirable * (1 - sigmoid(beta * (logratio - z)))).otherwise(undesirable * (1 - sigmoid(beta * (z - logratio))))


def apo_unpaired_loss(label: Column, logratio: Column, beta: float = 0.1) -> Column:
    return F.when(label, 1 - sigmoid(beta * logratio)).otherwise(sigmoid(beta * logratio))


def bco_weight(p: Column, low: float = 0.5, high: float = 10.0) -> Column:
    """Density ratio from a classifier's probability, clamped."""
    return clipped(p / (1 - p + 1e-8), low, high)


def clipped_surrogate(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2, cap: float | None = None) -> Column:
    """Negative clipped objective per token of the importance ratio."""
    r = ratio if cap is None else F.least(ratio, F.lit(float(cap)))
    return -F.least(r * advantage, clipped(ratio, 1 - low, 1 + high) * advantage)


def reduce_tokens(losses: Column, mask: Column) -> tuple[Column, Column]:
    """(sum, count) of an array of token losses under its mask; grpo averages sum/count over rows, bnpo divides the sums,
    dr_grpo divides the sum by rows times the longest length."""
    total = F.aggregate(F.zip_with(losses, mask, lambda x, m: x * m), F.lit(0.0), lambda acc, x: acc + x)
    return total, F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)


def kl_estimate(policy: Column, reference: Column, kind: str = "k1") -> Column:
    d = reference - policy
    return -d if kind == "k1" else F.exp(d) - d - 1


def token_rewards(kl: Column, score: Column, ended: Column, coefficient: float = 0.05, missing_eos: float | None = None) -> Column:
    """Per token -coefficient * kl, and the score at the last one, less a penalty if the completion did not end."""
    final = score if missing_eos is None else F.when(ended, score).otherwise(score - missing_eos)
    n = F.size(kl)
    return F.transform(kl, lambda k, i: -coefficient * k + F.when(i == n - 1, final).otherwise(0.0))
