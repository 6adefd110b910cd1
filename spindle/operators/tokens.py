"""Token-level estimators, trust-region masks and weights over token rows.

Rows are tokens (uid, response_id, pos, mask, reward, old, new …), one per place
of a response; ``explode_tokens`` makes them from array columns.  Windows run
over one response, whose length the context bounds; everything over a prompt's
group or the whole batch is an aggregate that is combined before the shuffle.
Null masks count as 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log-ratios are clamped to this bound; divisors are offset by EPS.
BOUND = 20.0
EPS = 1e-8


def explode_tokens(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """One row per place of the arrays, which are as long as the longest (the rest null)."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_t")
    return rows.select(*keys, zipped).select(*keys, "pos", *[F.col(f"_t.{a}").alias(a) for a in arrays])


def _m() -> Column:
    return F.coalesce(F.col("mask"), F.lit(0))


def _each() -> Window:
    return Window.partitionBy("response_id")


def _ahead() -> Window:
    """From the last place down to this one: a running frame, linear in the length."""
    return _each().orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def masked(x: Column) -> Column:
    """The value under the mask, else null: aggregates skip it."""
    return F.when(_m() == 1, x)


def returns(tokens: DataFrame) -> DataFrame:
    """Adds ``returns``: the rewards under the mask from here to the end."""
    return tokens.withColumn("returns", F.sum(F.col("reward") * _m()).over(_ahead()))


def remax(tokens: DataFrame, baseline: str) -> DataFrame:
    """Returns less the greedy response's reward."""
    return returns(tokens).withColumn("advantage", F.col("returns") - F.col(baseline) * _m())


def whiten(tokens: DataFrame, column: str, shift_mean: bool = True) -> DataFrame:
    """Zero mean (unless not ``shift_mean``) and unit sample variance over all tokens under the mask; one row is broadcast."""
    x = masked(F.col(column))
    stats = tokens.agg(F.avg(x).alias("_mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("_var"))
    z = (F.col(column) - F.col("_mean")) / F.sqrt(F.col("_var") + EPS)
    out = z if shift_mean else z + F.col("_mean")
    return tokens.crossJoin(F.broadcast(stats)).withColumn(column, out).drop("_mean", "_var")


def mean_baseline(tokens: DataFrame) -> DataFrame:
    """Response score less its group's mean on every token, whitened over the batch; a group of one has mean 0."""
    scores = tokens.groupBy("uid", "response_id").agg(F.sum("reward").alias("_s"))
    means = scores.groupBy("uid").agg(F.when(F.count("*") > 1, F.avg("_s")).otherwise(0.0).alias("_g"))
    centred = scores.join(means, "uid").select("response_id", (F.col("_s") - F.col("_g")).alias("advantage"))
    out = whiten(tokens.join(centred, "response_id"), "advantage")
    return out.withColumn("advantage", F.col("advantage") * _m())


def several_rewards(tokens: DataFrame, rewards: dict[str, float]) -> DataFrame:
    """Group-normalised scores of each reward column, summed by weight and whitened over the batch."""
    names = list(rewards)
    scores = tokens.groupBy("uid", "response_id").agg(*[F.sum(n).alias(n) for n in names])
    stats = scores.groupBy("uid").agg(
        F.count("*").alias("_n"), *[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("d", F.stddev_samp))]
    )
    alone = F.col("_n") == 1
    parts = [
        (F.col(n) - F.when(alone, 0.0).otherwise(F.col(f"_m_{n}"))) / (F.when(alone, 1.0).otherwise(F.col(f"_d_{n}")) + 1e-6) * w for n, w in rewards.items()
    ]
    total = scores.join(stats, "uid").select("response_id", sum(parts[1:], parts[0]).alias("advantage"))
    out = whiten(tokens.join(total, "response_id"), "advantage")
    return out.withColumn("advantage", F.col("advantage") * _m())


def discounted(rows: DataFrame, gamma: float) -> DataFrame:
    """Arrays ``rewards`` and ``mask`` to ``returns``: the backward sum with discount, started anew before each masked place.

    A recurrence over one array: an Arrow-batched function, linear in the length
    (a fold of expressions would copy its output at every place).  A null array gives null."""

    @F.pandas_udf("array<double>")
    def back(rewards: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for r, m in zip(rewards, masks, strict=True):
            if r is None or m is None:
                out.append(None)
                continue
            now, done = 0.0, [0.0] * len(r)
            for i in range(len(r) - 1, -1, -1):
                done[i] = r[i] + gamma * now
                now = done[i] * m[i]
            out.append(done)
        return pd.Series(out, dtype=object)

    return rows.withColumn("returns", back("rewards", "mask"))


def token_baseline(tokens: DataFrame, weight: str | None = None) -> DataFrame:
    """Variance-weighted baseline per place of a prompt's responses.

    Every token adds 1 - 2p + sum_pi_squared (p = exp(old), times ``weight``
    squared) to its response's running weight W; the baseline of (uid, pos) is
    the W-weighted mean of the returns there.  It is 0 for a prompt with one
    response, and for the longest response beyond the length of the second.
    """
    w = 1 - 2 * F.exp("old") + F.col("sum_pi_squared")
    w = (w * F.col(weight) * F.col(weight) if weight else w) * _m()
    behind = _each().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = returns(tokens).withColumn("_w", F.sum(w).over(behind))
    per = rows.groupBy("uid", "pos").agg((F.sum(F.col("returns") * F.col("_w") * _m()) / (F.sum(F.col("_w") * _m()) + EPS)).alias("_b"))
    lengths = tokens.groupBy("uid", "response_id").agg(F.sum(_m()).alias("_len"))
    top = lengths.groupBy("uid").agg(F.count("*").alias("_n"), F.max("_len").alias("_top"))
    after = (
        lengths.join(top, "uid")
        .groupBy("uid")
        .agg(F.max(F.when(F.col("_len") < F.col("_top"), F.col("_len"))).alias("_second"), F.count_if(F.col("_len") == F.col("_top")).alias("_tops"))
    )
    cut = lengths.join(top, "uid").join(after, "uid")
    tail = F.when(F.col("_n") == 1, 0).when((F.col("_tops") == 1) & (F.col("_len") == F.col("_top")), F.col("_second"))
    limits = cut.select("response_id", tail.alias("_tail"))
    joined = rows.join(per, ["uid", "pos"]).join(limits, "response_id")
    base = F.when(F.col("pos") >= F.col("_tail"), 0.0).otherwise(F.col("_b"))
    return joined.withColumn("advantage", (F.col("returns") - base) * _m()).drop("_w", "_b", "_tail")


def compact(tokens: DataFrame) -> DataFrame:
    """Tokens under the mask alone, their places counted anew: several turns become one run."""
    return tokens.where(_m() == 1).withColumn("pos", F.row_number().over(_each().orderBy("pos")) - 1)


def divergence(kind: str) -> Column:
    """k1, abs, k2 or k3 of the clamped log-ratio of training (``new``) and rollout (``old``)."""
    d = clamp(F.col("new") - F.col("old"), -BOUND, BOUND)
    return {"k1": -d, "abs": F.abs(d), "k2": 0.5 * d * d, "k3": F.exp(d) - 1 - d}[kind]


def kl_penalised(tokens: DataFrame, beta: float, kind: str = "k1", column: str = "reward") -> DataFrame:
    """The reward less beta times the divergence of the policy (``old``) from its reference (``ref``), under the mask."""
    d = clamp(F.col("ref") - F.col("old"), -BOUND, BOUND)
    k = {"k1": -d, "abs": F.abs(d), "k2": 0.5 * d * d, "k3": clamp(F.exp(d) - 1 - d, -10, 10)}[kind]
    return tokens.withColumn("kl", k * _m()).withColumn("penalised", F.col(column) - beta * F.col("kl"))


def adaptive_coefficient(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """Coefficient after each logged step (step, kl, n): a running product of
    1 + clip(kl / target - 1, 0.2) * n / horizon.  One row a training step meets in one task."""
    error = clamp(F.col("kl") / target - 1, -0.2, 0.2)
    log = F.log(1 + error * F.col("n") / horizon)
    run = F.sum(log).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("coefficient", start * F.exp(run))


def softmax_sums(logits: Column | str, picked: Column | str) -> Column:
    """struct(log_prob of the picked place, entropy, sum of squared probabilities) of an array of logits, shifted by its largest."""
    x = F.col(logits) if isinstance(logits, str) else logits
    k = F.col(picked) if isinstance(picked, str) else picked
    shifted = lambda a: F.transform(a, lambda v: v - F.array_max(a))
    add = lambda f: F.aggregate(shifted(x), F.lit(0.0), lambda s, v: s + f(v))
    norm = add(F.exp)
    log_z = F.log(norm)
    entropy = log_z - add(lambda v: v * F.exp(v)) / norm
    return F.struct((F.get(x, k) - F.array_max(x) - log_z).alias("log_prob"), entropy.alias("entropy"), (add(lambda v: F.exp(2 * v)) / (norm * norm)).alias("sum_pi_squared"))


def unpadded(ids: Column | str, mask: Column | str) -> Column:
    """The last ids, as many as the mask has ones."""
    a = F.col(ids) if isinstance(ids, str) else ids
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(n == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.size(a) - n + 1, n))


def covariance(tokens: DataFrame) -> DataFrame:
    """``cov``: advantage and log-probability, each less its mean under the mask (one row is broadcast); null outside the mask."""
    means = tokens.agg(F.avg(masked(F.col("advantage"))).alias("_a"), F.avg(masked(F.col("new"))).alias("_p"), F.sum(_m()).alias("_tokens"))
    out = tokens.crossJoin(F.broadcast(means))
    return out.withColumn("cov", masked((F.col("advantage") - F.col("_a")) * (F.col("new") - F.col("_p")))).drop("_a", "_p")


def _first(rows: DataFrame, order: list[Column], share: float, flag: str) -> DataFrame:
    """The rows with a mark on the first max(1, share * tokens) by an order: the
    cut is found by a top-n of that size, its last key is broadcast."""
    n = int((rows.agg(F.max("_tokens")).first()[0] or 0) * share)
    keys = [f"_o{i}" for i in range(len(order))]
    top = rows.select(*[x.alias(k) for x, k in zip(order, keys, strict=True)], "response_id", "pos").where(f"{keys[0]} is not null")
    chosen = top.orderBy(*keys, "response_id", "pos").limit(max(1, n)).select("response_id", "pos", F.lit(True).alias(flag))
    out = rows.join(chosen, ["response_id", "pos"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out.drop("_tokens")


def largest_covariance(tokens: DataFrame, share: float) -> DataFrame:
    """``chosen``: the tokens of the largest covariance, max(1, share * tokens) of them; ties by place."""
    return _first(covariance(tokens), [-F.col("cov")], share, "chosen")


def banded_covariance(tokens: DataFrame, share: float, low: float, high: float, seed: int) -> DataFrame:
    """``chosen``: as many tokens at random (by a seeded hash) of those with a covariance within the band."""
    rows = covariance(tokens)
    inside = (F.col("cov") > low) & (F.col("cov") < high)
    key = F.when(inside, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("response_id").cast("string"), F.col("pos").cast("string")).cast("binary")))
    return _first(rows, [key], share, "chosen")


def reject(tokens: DataFrame, options: dict[str, tuple[float | None, float]]) -> DataFrame:
    """The mask without tokens outside the trust region, as ``kept_mask``.

    Options are ``token_``, ``seq_sum_``, ``seq_mean_`` or ``seq_max_`` and k1,
    k2 or k3; all have to hold.  Bounds of k1 are ratios (their logarithms
    count; without a lower one it is 1 / upper), of the others an upper bound.
    """
    keep = F.lit(True)
    for name, (low, high) in options.items():
        level, kind = name.rsplit("_", 1)
        x = divergence(kind)
        if level == "token":
            stat = x
        elif level == "seq_sum":
            stat = F.sum(x * _m()).over(_each())
        elif level == "seq_mean":
            stat = F.sum(x * _m()).over(_each()) / (F.sum(_m()).over(_each()) + EPS)
        elif level == "seq_max" and kind != "k1":
            stat = F.coalesce(F.max(masked(x)).over(_each()), F.lit(0.0))
        else:
            raise ValueError(f"unknown option: {name}")
        if kind == "k1":
            keep = keep & stat.between(F.log(F.lit(float(low or 1 / high))), F.log(F.lit(float(high))))
        else:
            keep = keep & (stat <= high)
    return tokens.withColumn("kept_mask", _m() * keep.cast("int"))


def importance_weights(tokens: DataFrame, level: str, upper: float, lower: float | None = None, normalise: bool = False) -> DataFrame:
    """Ratio of training and rollout probabilities per token or response as ``weight``.

    With an upper bound alone weights are cut to it; with both, weights outside
    are 0.  ``normalise`` divides by the batch's mean weight (of tokens, or of
    responses), unless that is 0.
    """
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown level: {level}")
    d = F.col("new") - F.col("old")
    raw = F.exp(clamp(d if level == "token" else F.sum(d * _m()).over(_each()), -BOUND, BOUND)) * _m()
    out = tokens.withColumn("weight", F.least(raw, F.lit(float(upper))) if lower is None else F.when(raw.between(lower, upper), raw).otherwise(0.0))
    if not normalise:
        return out
    one = out.groupBy("response_id").agg(F.avg(masked(F.col("weight"))).alias("weight"), F.max(_m()).alias("mask")) if level == "sequence" else out
    mean = one.agg(F.avg(masked(F.col("weight"))).alias("_mean"))
    scaled = F.when(F.col("_mean") > EPS, F.col("weight") / F.col("_mean")).otherwise(F.col("weight"))
    return out.crossJoin(F.broadcast(mean)).withColumn("weight", scaled).drop("_mean")


def off_policy(tokens: DataFrame) -> DataFrame:
    """Perplexities of both policies, divergences and chi-squared of tokens and responses: one row."""
    d = clamp(F.col("new") - F.col("old"), -BOUND, BOUND)
    per = tokens.where(_m() == 1).groupBy("response_id").agg(
        F.count("*").alias("_n"), F.avg("new").alias("_new"), F.avg("old").alias("_old"), F.sum(F.col("new") - F.col("old")).alias("_d"),
        F.sum(F.col("old") - F.col("new")).alias("_kl"), F.sum(F.exp(d) - d - 1).alias("_k3"), F.sum(F.exp(2 * d)).alias("_sq"),
    )
    total = F.sum("_n")
    return per.agg(
        F.avg(F.exp(-F.col("_new"))).alias("training_ppl"),
        F.avg(-F.col("_new")).alias("training_log_ppl"),
        F.avg(-F.col("_old")).alias("rollout_log_ppl"),
        F.avg(F.col("_new") - F.col("_old")).alias("log_ppl_gap"),
        F.avg(F.exp(F.col("_old") - F.col("_new"))).alias("ppl_ratio"),
        F.avg(F.exp(-F.col("_old"))).alias("rollout_ppl"),
        (F.sum("_kl") / total).alias("kl"),
        (F.sum("_k3") / total).alias("k3_kl"),
        (F.sum("_sq") / total - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clamp(F.col("_d"), -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )


def effective_sample(tokens: DataFrame) -> DataFrame:
    """Mean, least and largest weight under the mask and the effective sample share 1 / mean((w / mean)^2)."""
    w = masked(F.col("weight"))
    return tokens.agg(F.avg(w).alias("mean"), F.min(w).alias("least"), F.max(w).alias("most"), (F.avg(w) * F.avg(w) / F.avg(w * w)).alias("effective"))


def corrected(tokens: DataFrame, weights: dict | None, rejection: dict | None) -> tuple[DataFrame, DataFrame]:
    """(tokens with ``weight`` and the mask after rejection, one row of off-policy
    metrics on the mask before it): weights and rejection come from the same log-ratio."""
    before = off_policy(tokens)
    out = importance_weights(tokens, **weights) if weights else tokens.withColumn("weight", F.lit(1.0))
    out = reject(out, rejection) if rejection else out.withColumn("kept_mask", _m())
    return out.withColumn("mask", F.col("kept_mask")), before.select(*[F.col(c).alias(f"rollout_corr/{c}") for c in before.columns])


def bypassed(tokens: DataFrame) -> DataFrame:
    """The rollout's log-probabilities (``rollout``) in place of the old policy's."""
    return tokens.withColumn("old", F.col("rollout"))
