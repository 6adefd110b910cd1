"""Forward values of policy losses on logged token rows (response_id, mask, old, new, advantage).

Per-token losses are plain expressions; ``aggregate`` sums them per response and
then over the batch, so one shuffle on response_id serves every mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.tokens import BOUND, EPS, clamp


def _parts() -> tuple[Column, Column, Column, Column]:
    """Advantage, new, old and the clamped ratio."""
    new, old = F.col("new"), F.col("old")
    return F.col("advantage"), new, old, F.exp(clamp(new - old, -BOUND, BOUND))


def dual_clip(low: float = 0.2, high: float = 0.2, c: float = 3.0) -> Column:
    """The clipped loss, itself bounded by c times the advantage where that is negative."""
    a, _, _, r = _parts()
    worst = F.greatest(-a * r, -a * clamp(r, 1 - low, 1 + high))
    return F.when(a < 0, F.least(worst, -a * c)).otherwise(worst)


def total_variation(low: float = 0.2, high: float = 0.2, c: float = 20.0) -> Column:
    """Tokens whose probability moved no further than the bound on the side of their advantage."""
    a, new, old, r = _parts()
    moved = F.exp(new) - F.exp(old)
    inside = F.when(a > 0, moved <= high).otherwise(moved >= -low)
    return -a * F.least(r, F.lit(c)) * new * inside.cast("double")


def binary_kl(low: float = 0.2, high: float = 0.2, c: float = 20.0) -> Column:
    """As ``total_variation`` by the Bernoulli divergence; moves back are always inside."""
    a, new, old, r = _parts()
    p, q = F.exp(new), F.exp(old)
    kl = q * (old - new) + (1 - q) * F.log((1 - q + EPS) / (1 - p + EPS))
    inside = F.when(a > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q))
    return -a * F.least(r, F.lit(c)) * new * inside.cast("double")


def soft_gate(tau_up: float = 1.0, tau_down: float = 1.05) -> Column:
    a, _, _, r = _parts()
    tau = F.when(a > 0, tau_up).otherwise(tau_down)
    return -a * 4 / tau / (1 + F.exp(-tau * (r - 1)))


def clipped_weight(low: float = 0.2, high: float = 0.2) -> Column:
    a, new, _, r = _parts()
    return -clamp(r, 1 - low, 1 + high) * a * new


def log_prob() -> Column:
    a, new, _, _ = _parts()
    return -a * new


def value(bound: float = 0.5) -> Column:
    """Half the larger squared error of the value and of the value within ``bound`` of the old one (columns vpred, value, ret)."""
    v, old, ret = F.col("vpred"), F.col("value"), F.col("ret")
    near = F.greatest(F.least(v, old + bound), old - bound)
    return 0.5 * F.greatest((v - ret) * (v - ret), (near - ret) * (near - ret))


def entropy() -> Column:
    """The logged entropy of each token (column ``entropy``)."""
    return F.col("entropy")


def clip_covariance(low: float = 0.2, high: float = 0.2) -> Column:
    """The clipped loss without the tokens that ``banded_covariance`` chose."""
    a, _, _, r = _parts()
    return F.greatest(-a * r, -a * clamp(r, 1 - low, 1 + high)) * F.when(F.col("chosen"), 0.0).otherwise(1.0)


def kl_covariance(coefficient: float = 1.0) -> Column:
    """The plain loss, with the absolute log-ratio added for tokens that ``largest_covariance`` chose."""
    a, new, old, r = _parts()
    return -a * r + F.when(F.col("chosen"), coefficient * F.abs(new - old)).otherwise(0.0)


def weighted(loss: Column) -> Column:
    """A loss times the token's importance weight."""
    return loss * F.col("weight")


def forward_kl(mass: str | None = None) -> Column:
    """Distillation: the logged top-k forward divergence of each token, at least 0."""
    return F.greatest(F.col("teacher_kl"), F.lit(0.0))


def reverse_kl(kind: str = "k3") -> Column:
    """Distillation: a divergence estimate of the student's log-probabilities (``new``) from the teacher's (``teacher``)."""
    d = clamp(F.col("teacher") - F.col("new"), -BOUND, BOUND)
    return {"k1": -d, "abs": F.abs(d), "k2": 0.5 * d * d, "k3": clamp(F.exp(d) - 1 - d, -10, 10)}[kind]


def _seen(x: Column) -> Column:
    """Over the responses with a token under the mask."""
    return F.avg(F.when(F.col("_n") > 0, x))


MODES: dict[str, Callable[[Column, float], Column]] = {
    "token-mean": lambda s, _: F.sum(s) / F.sum("_n"),
    "seq-mean-token-sum": lambda s, _: _seen(s),
    "seq-mean-token-sum-norm": lambda s, horizon: _seen(s) / horizon,
    "seq-mean-token-mean": lambda s, _: _seen(s / (F.col("_n") + EPS)),
}


def aggregate(tokens: DataFrame, losses: dict[str, Column], mode: str | dict[str, str] = "token-mean", horizon: float = 1.0) -> DataFrame:
    """One row with the batch loss of each expression, in one pass; ``mode`` of all
    or of each.  Wholly masked responses count in no sequence mean."""
    modes = dict.fromkeys(losses, mode) if isinstance(mode, str) else mode
    if unknown := set(modes.values()) - set(MODES):
        raise ValueError(f"unknown mode: {sorted(unknown)[0]}")
    m = F.coalesce(F.col("mask"), F.lit(0))
    per = tokens.groupBy("response_id").agg(F.sum(m).alias("_n"), *[F.sum(x * m).alias(f"_s_{k}") for k, x in losses.items()])
    return per.agg(*[MODES[modes[k]](F.col(f"_s_{k}"), horizon).alias(k) for k in losses])


def sequence_ratio(tokens: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Clipped loss by one ratio per response, exp of the mean log-ratio (at most 10): mean over responses of token means, as ``loss``."""
    m = F.coalesce(F.col("mask"), F.lit(0))
    per = tokens.groupBy("response_id").agg(
        F.sum(m).alias("_n"),
        F.sum((F.col("new") - F.col("old")) * m).alias("_d"),
        F.sum(F.when(F.col("advantage") > 0, F.col("advantage")).otherwise(0.0) * m).alias("_up"),
        F.sum(F.when(F.col("advantage") < 0, F.col("advantage")).otherwise(0.0) * m).alias("_down"),
    )
    r = F.exp(F.least(F.col("_d") / F.greatest(F.col("_n"), F.lit(1)), F.lit(10.0)))
    # the larger loss is the smaller ratio where the advantage is positive, the larger one where it is negative
    loss = -F.col("_up") * F.least(r, F.lit(1 + high)) - F.col("_down") * F.greatest(r, F.lit(1 - low))
    return per.agg(F.avg(F.when(F.col("_n") > 0, loss / (F.col("_n") + EPS))).alias("loss"))


def geometric_mean(tokens: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """Mean advantage times the geometric mean of ratios that are clamped against their advantage: plain mean over responses, as ``loss``."""
    m = F.coalesce(F.col("mask"), F.lit(0))
    a, d = F.col("advantage"), F.col("new") - F.col("old")
    bent = F.when(a > 0, F.least(d, F.lit(high))).when(a < 0, F.greatest(d, F.lit(-low))).otherwise(0.0)
    per = tokens.groupBy("response_id").agg(F.sum(m).alias("_n"), F.sum(bent * m).alias("_d"), F.sum(a * m).alias("_a"))
    n = F.col("_n") + EPS
    return per.agg(F.avg(-F.col("_a") / n * F.exp(F.col("_d") / n)).alias("loss"))
