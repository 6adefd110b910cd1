"""Group-relative estimators: one aggregate per prompt serves all of them.

Rows are responses (uid, response_id, score, length).  Statistics are combined
before the shuffle and joined back on uid, so a prompt with a third of all rows
is no single task: its aggregate is partial and the join's skewed side can be
split.  Standard deviations are sample deviations; groups of one have mean 0
and deviation 1 unless stated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def _with(rows: DataFrame, **stats: Column) -> DataFrame:
    """The rows with the statistics of their group."""
    return rows.join(rows.groupBy("uid").agg(*[x.alias(k) for k, x in stats.items()]), "uid")


def _scored(rows: DataFrame, columns: list[str], advantage: Column) -> DataFrame:
    return rows.withColumn("advantage", advantage).select(*columns, "advantage")


def grpo(rows: DataFrame, by_deviation: bool = True) -> DataFrame:
    out = _with(rows, _n=F.count("*"), _mean=F.avg("score"), _std=F.stddev_samp("score"))
    alone = F.col("_n") == 1
    centred = F.col("score") - F.when(alone, 0.0).otherwise(F.col("_mean"))
    return _scored(out, rows.columns, centred / (F.when(alone, 1.0).otherwise(F.col("_std")) + EPS) if by_deviation else centred)


def grpo_floored(rows: DataFrame) -> DataFrame:
    """The variance is floored before the root."""
    out = _with(rows, _n=F.count("*"), _mean=F.avg("score"), _var=F.var_samp("score"))
    alone = F.col("_n") == 1
    std = F.when(alone, 1.0).otherwise(F.sqrt(F.greatest(F.col("_var"), F.lit(EPS))))
    return _scored(out, rows.columns, (F.col("score") - F.when(alone, 0.0).otherwise(F.col("_mean"))) / (std + EPS))


def rloo(rows: DataFrame, keep_single: bool = True) -> DataFrame:
    """Score against the mean of the others; a group of one keeps its score, or gets 0."""
    out = _with(rows, _n=F.count("*"), _sum=F.sum("score"))
    others = (F.col("_n") * F.col("score") - F.col("_sum")) / F.greatest(F.col("_n") - 1, F.lit(1))
    return _scored(out, rows.columns, F.when(F.col("_n") == 1, F.col("score") if keep_single else F.lit(0.0)).otherwise(others))


def opo(rows: DataFrame) -> DataFrame:
    """Length-weighted baseline; 0 for a group of one."""
    out = _with(rows, _n=F.count("*"), _base=F.sum(F.col("length") * F.col("score")) / F.sum("length"))
    return _scored(out, rows.columns, F.col("score") - F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_base")))


def pass_at_k(rows: DataFrame, by_deviation: bool = False, strict: bool = False) -> DataFrame:
    """Only the best response of a group (the first of equals) gets its lead over
    the second best; ``by_deviation``: over the group's deviation.  A group of one gets 0, or raises (``strict``)."""
    best = F.max(F.struct(F.col("score"), (-F.col("response_id")).alias("_id")))
    out = _with(rows, _n=F.count("*"), _std=F.stddev_samp("score"), _best=best)
    first = -F.col("response_id") == F.col("_best._id")
    second = out.where(~first).groupBy("uid").agg(F.max("score").alias("_second"))
    out = out.join(second, "uid", "left")
    alone = F.raise_error(F.lit("a group of one response")).cast("double") if strict else F.lit(0.0)
    lead = F.col("score") - F.col("_second")
    lead = lead / (F.col("_std") + EPS) if by_deviation else lead
    return _scored(out, rows.columns, F.when(F.col("_n") == 1, alone).when(first, lead).otherwise(0.0))


def gpg(rows: DataFrame) -> DataFrame:
    """Centred scores scaled by batch size over the number of scores that are not 0 (one aggregate row, broadcast)."""
    scale = rows.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("_scale"))
    out = _with(rows, _n=F.count("*"), _mean=F.avg("score")).join(F.broadcast(scale))
    centred = F.col("score") - F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_mean"))
    return _scored(out, rows.columns, centred * F.col("_scale"))


def majority(rows: DataFrame, vote: str) -> DataFrame:
    """Most frequent vote of each group; ties go to the vote seen first, and its first score is the value."""
    votes = rows.groupBy("uid", vote).agg(F.count("*").alias("_n"), F.min(F.struct("response_id", "score")).alias("_first"))
    best = votes.groupBy("uid").agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col("_first"), F.col(vote))).alias("_b"))
    return best.select("uid", F.col(f"_b.{vote}").alias(vote), F.col("_b._first.score").alias("score"), (-F.col("_b._n")).alias("votes"))


def gae(rows: DataFrame, gamma: float, lam: float) -> DataFrame:
    """advantages of token arrays ``rewards``, ``values`` and ``mask``: the
    backward recurrence, carried through masked places (an Arrow-batched function,
    linear in the length).  A null array gives null."""

    @F.pandas_udf("array<double>")
    def back(rewards: pd.Series, values: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for r, v, m in zip(rewards, values, masks, strict=True):
            if r is None or v is None or m is None:
                out.append(None)
                continue
            ahead, last, done = 0.0, 0.0, [0.0] * len(r)
            for i in range(len(r) - 1, -1, -1):
                if m[i] == 1:
                    last = r[i] + gamma * ahead - v[i] + gamma * lam * last
                    ahead = v[i]
                done[i] = last
            out.append(done)
        return pd.Series(out, dtype=object)

    return rows.withColumn("advantages", back("rewards", "values", "mask"))
