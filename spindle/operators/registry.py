"""Extension points: named functions that users add to.

An advantage estimator maps responses to responses with ``advantage``; a policy
loss is a per-token Column; a reward function maps a DataFrame to one with
``score``; a reward manager turns scores into token rewards; a dataset reads a
path; a sampler gives an order; a generator makes new rows.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import scorers
from spindle.operators import groups, losses


class Registry:
    """Names to functions; a name is taken once, an unknown one raises with those that are known."""

    def __init__(self, kind: str, known: dict[str, Callable]):
        self.kind, self._known = kind, dict(known)

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            if name in self._known and self._known[name] is not f:
                raise ValueError(f"the {self.kind} {name} is there already")
            self._known[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"unknown {self.kind}: {name}; there are {sorted(self._known)}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


ESTIMATORS = Registry(
    "advantage estimator",
    {"grpo": groups.grpo, "grpo_floored": groups.grpo_floored, "rloo": groups.rloo, "rloo_zero": lambda r: groups.rloo(r, False), "opo": groups.opo, "pass_at_k": groups.pass_at_k, "gpg": groups.gpg},
)
POLICY_LOSSES = Registry(
    "policy loss",
    {
        "vanilla": losses.dual_clip, "total_variation": losses.total_variation, "binary_kl": losses.binary_kl, "soft_gate": losses.soft_gate, "clipped_weight": losses.clipped_weight,
        "log_prob": losses.log_prob, "clip_covariance": losses.clip_covariance, "kl_covariance": losses.kl_covariance,
    },
)
DISTILLATION_LOSSES = Registry("distillation loss", {"forward_kl": losses.forward_kl, "reverse_kl": losses.reverse_kl})
DATASETS = Registry("dataset", {})
SAMPLERS = Registry("sampler", {"in_order": lambda rows, seed: rows.withColumn("shuffle_key", F.col("row_id").cast("string"))})
GENERATORS = Registry("generator", {})


@SAMPLERS.register("random")
def random_order(rows: DataFrame, seed: int) -> DataFrame:
    return rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")).cast("binary")))


def load_function(path: str, name: str) -> Callable:
    """A function of a Python file: custom rewards, datasets, estimators."""
    spec = importlib.util.spec_from_file_location("spindle_custom", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def _plain(rows: DataFrame, score: Column) -> DataFrame:
    return rows.withColumn("score", score)


def _overlong(rows: DataFrame, score: Column, most: int = 4096, buffer: int = 512, factor: float = 1.0) -> DataFrame:
    return rows.withColumn("score", score + scorers.overlong_penalty("length", most, buffer, factor))


def _safe(rows: DataFrame, score: Column) -> DataFrame:
    """Scores that could not be had are 0."""
    return rows.withColumn("score", F.coalesce(score, F.lit(0.0)))


REWARD_MANAGERS = Registry("reward manager", {"naive": _plain, "overlong": _overlong, "batch": _plain, "zero_on_error": _safe})


def token_rewards(rows: DataFrame, score: str = "score", length: str = "length") -> DataFrame:
    """``rewards``: the score on the last token, 0 before it; no token, no reward."""
    n = F.greatest(F.col(length).cast("int"), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("rewards", F.transform(places, lambda i: F.when(i == n, F.col(score)).otherwise(0.0)))
