"""Aggregates of evaluation runs and logged training signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: str, share: float) -> Column:
    """The value at place floor(share * n) of the sorted values, without
    interpolation: an aggregate of distinct values with their counts, combined
    before the shuffle."""
    # the least value with more than share * n values up to it
    return F.expr(f"percentile_disc({min(1.0, share + 1e-12)!r}) WITHIN GROUP (ORDER BY {values})")


def summary(values: str) -> list[Column]:
    """Sum, mean, median, p90, p99, least and largest value; 0 without any."""
    of = {"sum": F.sum(values), "mean": F.avg(values), "median": nearest_rank(values, 0.5), "p90": nearest_rank(values, 0.9), "p99": nearest_rank(values, 0.99), "min": F.min(values), "max": F.max(values)}
    return [F.coalesce(x.cast("double"), F.lit(0.0)).alias(k) for k, x in of.items()]


def interpolated(values: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> list[Column]:
    """Percentiles with linear interpolation, as tp50, tp95 …"""
    return [F.percentile(values, F.lit(x)).alias(f"tp{round(x * 100)}") for x in shares]


def scores_by_dataset(rows: DataFrame) -> DataFrame:
    """Micro averages of em and f1 per dataset and over all (dataset null)."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return rows.rollup("dataset").agg(mean("em"), mean("f1"), F.count("*").alias("n"))


def macro_average(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("dataset").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"))
    return per.agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.count("*").alias("datasets"))


def reduce_by_name(rows: DataFrame) -> DataFrame:
    """(name, value): names with "max" keep the largest, with "min" the least, others the mean."""
    value = F.when(F.contains("name", F.lit("max")), F.max("value")).when(F.contains("name", F.lit("min")), F.min("value")).otherwise(F.avg("value"))
    return rows.groupBy("name").agg(value.alias("value"))


def slowest(rows: DataFrame, key: str, attributes: list[str], time: str) -> DataFrame:
    """Least, largest and mean time of each key, and the attributes of its slowest row."""
    worst = F.max(F.struct(time, *attributes))
    out = rows.groupBy(key).agg(F.min(time).alias("least"), F.max(time).alias("most"), F.avg(time).alias("mean"), worst.alias("_w"))
    return out.select(key, "least", "most", "mean", *[F.col(f"_w.{a}").alias(f"slowest_{a}") for a in attributes])


def best_of_k(rows: DataFrame, k: int) -> DataFrame:
    """Expected best and worst of k draws with replacement from each group's
    scores, in closed form over its distinct scores and their counts."""
    counts = rows.groupBy("uid", "score").agg(F.count("*").alias("_c"))
    whole = rows.groupBy("uid").agg(F.count("*").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("uid").orderBy("score"))
    held = counts.withColumn("_to", upto).join(whole, "uid")
    n = F.col("_n")

    def share(x: Column) -> Column:
        return F.pow(x / n, F.lit(k))

    best = F.col("score") * (share(F.col("_to")) - share(F.col("_to") - F.col("_c")))
    worst = F.col("score") * (share(n - F.col("_to") + F.col("_c")) - share(n - F.col("_to")))
    return held.groupBy("uid").agg(F.sum(best).alias("best"), F.sum(worst).alias("worst"))


def bootstrap(rows: DataFrame, k: int, draws: int = 1000, seed: int = 42, reduce: str = "max") -> DataFrame:
    """Mean and population deviation over ``draws`` resamples of k scores of each
    uid (with replacement; places are seeded hashes) of their max, min, mean or ``majority`` (the first score of the most frequent ``vote``)."""
    vote = F.col("vote") if reduce == "majority" else F.lit(0)
    # places from 0 within a uid; a prompt's responses are one window
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("uid").orderBy("response_id")) - 1).select("uid", "_at", "score", vote.alias("_vote"))
    sizes = placed.groupBy("uid").agg(F.count("*").alias("_n"))
    picks = sizes.select("uid", "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw")).select("uid", "_n", "_draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("uid").cast("string"), "_draw", "_i").cast("binary")), 1, 8), 16, 10).cast("bigint")
    drawn = picks.withColumn("_at", F.pmod(unit, F.col("_n"))).join(placed, ["uid", "_at"])
    if reduce == "majority":
        votes = drawn.groupBy("uid", "_draw", "_vote").agg(F.count("*").alias("_c"), F.min(F.struct("_i", "score")).alias("_f"))
        top = votes.groupBy("uid", "_draw").agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("_f"))).alias("_t"))
        values = top.select("uid", F.col("_t._f.score").alias("_v"))
    else:
        values = drawn.groupBy("uid", "_draw").agg({"max": F.max, "min": F.min, "mean": F.avg}[reduce]("score").alias("_v"))
    return values.groupBy("uid").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))


def sweep(n: int) -> list[int]:
    """2, 4, 8 … below n, and n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def validation_metrics(rows: DataFrame, n: int, vote: bool = False, draws: int = 200, seed: int = 42) -> DataFrame:
    """(data_source, variable, metric, value): means over prompts of mean@n,
    std@n (population) and of best@k, worst@k and, with votes, maj@k mean and
    std for k = 2, 4 … n.  Rows: data_source, uid, response_id, variable, score[, vote]."""
    keys = ["data_source", "variable"]
    groups = F.struct(*keys, "uid")
    held = rows.withColumn("_g", groups)
    base = held.groupBy("_g").agg(F.avg("score").alias(f"mean@{n}"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias(f"std@{n}"))
    parts = [base.select("_g", F.explode(F.create_map(*[x for m in (f"mean@{n}", f"std@{n}") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))]
    one = held.select(F.to_json("_g").alias("uid"), "_g", "response_id", "score", *(["vote"] if vote else []))
    names = one.select("uid", "_g").distinct()
    for k in sweep(n):
        for name, kind in (("best", "max"), ("worst", "min"), *([("maj", "majority")] if vote else [])):
            found = bootstrap(one.drop("_g"), k, draws, seed, kind).join(names, "uid")
            parts.append(found.select("_g", F.explode(F.create_map(F.lit(f"{name}@{k}/mean"), F.col("mean"), F.lit(f"{name}@{k}/std"), F.col("std"))).alias("metric", "value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy(F.col("_g.data_source").alias("data_source"), F.col("_g.variable").alias("variable"), "metric").agg(F.avg("value").alias("value"))


def routed(metrics: DataFrame) -> DataFrame:
    """``section`` of validation metrics: val-core for the core variable (acc if
    its source has it, else reward) at the largest n, of mean, best and maj alone; else val-aux."""
    core = F.max(F.when(F.col("variable") == "acc", 1).otherwise(0)).over(Window.partitionBy("data_source"))
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    most = F.max("_n").over(Window.partitionBy("data_source", "variable"))
    wanted = F.col("metric").rlike(r"^(mean@\d+|(best|maj)@\d+/mean)$")
    mine = F.col("variable") == F.when(F.col("_acc") == 1, "acc").otherwise("reward")
    marked = metrics.withColumn("_n", n).withColumn("_acc", core)
    return marked.withColumn("section", F.when(mine & wanted & (F.col("_n") == most), "val-core").otherwise("val-aux")).drop("_n", "_acc")


def run_counters(rows: DataFrame) -> DataFrame:
    """One row of counts over records (success, em, f1, abort_reason, judge: true, false or null)."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if("em").alias("em"), F.count_if(F.col("f1") == 0).alias("zero_f1"),
        F.count_if(F.col("abort_reason").isNotNull()).alias("aborted"), F.count_if("judge").alias("judge_pass"), F.count_if(~F.col("judge")).alias("judge_fail"),
        F.count_if(F.col("judge").isNull()).alias("judge_unknown"), F.coalesce(F.avg(F.when(F.col("success"), F.col("f1"))), F.lit(0.0)).alias("kept_f1"),
    )


def time_share(part: str, whole: str) -> Column:
    """Share of a time in another, 0 where there is none."""
    return F.coalesce(F.try_divide(F.sum(part), F.sum(whole)), F.lit(0.0))


def data_metrics(tokens: DataFrame, responses: DataFrame, limit: int) -> DataFrame:
    """One row: score, reward, advantage, return and value (mean, max, min over
    tokens under the mask or over responses), lengths, share cut at ``limit``,
    share aborted (no token) and the variance that values explain of returns."""
    m = F.coalesce(F.col("mask"), F.lit(0)) == 1
    kinds = {"mean": F.avg, "max": F.max, "min": F.min}
    gap = F.when(m, F.col("ret") - F.col("value"))
    per_token = [f(F.when(m, F.col(c))).alias(f"{c}/{k}") for c in ("advantage", "ret", "value") for k, f in kinds.items()]
    explained = 1 - F.var_samp(gap) / (F.var_samp(F.when(m, F.col("ret"))) + 1e-5)
    a = tokens.agg(*per_token, explained.alias("explained_variance"))
    used = F.col("response_length") > 0
    per_row = [f(F.when(used, F.col(c))).alias(f"{c}/{k}") for c in ("score", "reward") for k, f in kinds.items()]
    lengths = [f(F.col(c)).alias(f"{c}/{k}") for c in ("response_length", "prompt_length") for k, f in kinds.items()]
    cut = F.avg((F.col("response_length") == limit).cast("double")).alias("response_length/clip_ratio")
    b = responses.agg(*per_row, *lengths, cut, F.avg((~used).cast("double")).alias("aborted_ratio"))
    return a.crossJoin(b)  # one row each


def timings(stages: DataFrame, responses: DataFrame) -> DataFrame:
    """(stage, seconds, per_token_ms): generation counts response tokens, other stages all; stages without tokens get null."""
    counted = ("gen", "ref", "values", "adv", "update_critic", "update_actor")
    sums = responses.agg(F.sum("response_length").alias("_r"), (F.sum("response_length") + F.sum("prompt_length")).alias("_all"))
    tokens = F.when(F.col("stage") == "gen", F.col("_r")).when(F.col("stage").isin(*counted), F.col("_all"))
    return stages.crossJoin(F.broadcast(sums)).select("stage", "seconds", F.try_divide(F.col("seconds") * 1000, tokens).alias("per_token_ms"))


def throughput(responses: DataFrame, seconds: float, devices: int) -> DataFrame:
    total = F.sum(F.col("response_length") + F.col("prompt_length"))
    return responses.agg(total.alias("total_tokens"), F.lit(float(seconds)).alias("seconds"), (total / (seconds * devices)).alias("throughput"))


def variance_proxies(tokens: DataFrame, gradient_norm: float | None = None, weight: str | None = None) -> DataFrame:
    """Squared gradient norm, power E[A^2 W], noise above it, E[A^2] and E[W]; W sums 1 - 2p + sum_pi_squared."""
    m = F.coalesce(F.col("mask"), F.lit(0))
    w = 1 - 2 * F.exp("old") + F.col("sum_pi_squared")
    ratio = F.col(weight) if weight else F.lit(1.0)
    per = tokens.groupBy("response_id").agg(
        (F.sum(F.col("advantage") * m) / (F.sum(m) + 1e-8)).alias("_a"), F.sum(w * m).alias("_w"), F.sum(w * ratio * ratio * m).alias("_wr"), (F.sum(ratio * m) / (F.sum(m) + 1e-8)).alias("_r")
    )
    power = F.avg(F.col("_r") * F.col("_r") * F.col("_a") * F.col("_a") * F.greatest(F.col("_w"), F.lit(0.0)))
    signal = 0.0 if gradient_norm is None else gradient_norm**2
    noise = F.lit(0.0) if gradient_norm is None else F.when(F.count("*") > 1, F.greatest(F.lit(0.0), (power - signal) / (F.count("*") - 1))).otherwise(0.0)
    return per.agg(F.lit(signal).alias("signal"), power.alias("power"), noise.alias("noise"), F.avg(F.col("_a") * F.col("_a")).alias("a_squared"), F.avg("_wr").alias("w"))


def across_ranks(rows: DataFrame) -> DataFrame:
    """(name, value) of typed metrics logged by every rank (rank, step, name, kind,
    value): mean and sum are averaged over ranks first, min and max taken over all; ranks with other numbers of values raise."""
    counts = rows.groupBy("name", "rank").agg(F.count("*").alias("_c")).groupBy("name").agg(F.count_distinct("_c").alias("_k"))
    checked = counts.where(F.coalesce(F.assert_true(F.col("_k") == 1, F.lit("ranks with other numbers of values")).isNull(), F.lit(True)))
    steps = rows.groupBy("name", "kind", "step").agg(F.avg("value").alias("_avg"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    value = F.when(F.col("kind") == "sum", F.sum("_avg")).when(F.col("kind") == "min", F.min("_min")).when(F.col("kind") == "max", F.max("_max")).otherwise(F.avg("_avg"))
    return steps.join(checked, "name").groupBy("name", "kind").agg(value.alias("value"))


#: Metrics with a rule of their own over several steps.
STEP_RULES = {
    "time_sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}


def over_steps(rows: DataFrame) -> DataFrame:
    """(name, value) of metrics logged by step: named rules, then the first word that the name holds decides, else the mean."""
    name, low = F.col("name"), F.lower("name")

    def holds(*words: str) -> Column:
        return low.rlike("|".join(words))

    kind = F.lit("avg")
    for k, test in reversed([("sum", holds("timing_s/")), ("avg", holds("mean", "avg", "average")), ("max", holds("max")), ("min", holds("min")), ("sum", holds("sum", "total"))]):
        kind = F.when(test, k).otherwise(kind)
    for k, names in STEP_RULES.items():
        kind = F.when(name.isin(*names), "sum" if k == "time_sum" else k).otherwise(kind)
    sums = rows.groupBy("name").agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.max_by("value", "step").alias("last"))
    value = F.col("avg")
    for k in ("sum", "max", "min", "last"):
        value = F.when(kind == k, F.col(k)).otherwise(value)
    return sums.select("name", kind.alias("kind"), value.alias("value"))


def imbalance(rows: DataFrame, parts: int, size: int, balanced: str) -> DataFrame:
    """Least, largest and spread of the summed lengths of contiguous parts, and of the parts in ``balanced``."""
    chunks = rows.groupBy(F.floor(F.col("row_id") / -(-size // parts)).alias("_p")).agg(F.sum("length").alias("_s"))
    other = rows.groupBy(balanced).agg(F.sum("length").alias("_s"))

    def ends(df: DataFrame, tail: str) -> DataFrame:
        return df.agg(F.min("_s").alias(f"min{tail}"), F.max("_s").alias(f"max{tail}"), (F.max("_s") - F.min("_s")).alias(f"spread{tail}"))

    mean = rows.agg((F.sum("length") / parts).alias("mean"))
    return ends(chunks, "").crossJoin(ends(other, "_balanced")).crossJoin(mean)  # one row each


def rejection_metrics(tokens: DataFrame, stat: Column, low: float | None, high: float) -> DataFrame:
    """Mean, extremes and shares out of bounds of a statistic under the mask, its
    deviation within bounds, and the share of tokens and responses rejected (``kept_mask``)."""
    m = F.coalesce(F.col("mask"), F.lit(0)) == 1
    x = F.when(m, F.col("_x"))
    bound = F.when(m, F.least(F.greatest(x, F.lit(float("-inf") if low is None else low)), F.lit(high)))
    held = tokens.withColumn("_x", stat)
    per = held.groupBy("response_id").agg(F.max(F.when(m & (F.col("kept_mask") == 0), 1).otherwise(0)).alias("_hit"), F.count_if(m).alias("_m"))
    rows = held.agg(
        F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), F.avg((x > high).cast("double")).alias("high"), F.avg((x < (low if low is not None else float("-inf"))).cast("double")).alias("low"),
        F.coalesce(F.stddev_pop(bound), F.lit(0.0)).alias("std"), F.avg(F.when(m, (F.col("kept_mask") == 0).cast("double"))).alias("rejected_tokens"),
    )
    return rows.crossJoin(per.where("_m > 0").agg(F.avg(F.col("_hit").cast("double")).alias("rejected_responses")))  # one row each


def version_spans(rows: DataFrame) -> DataFrame:
    """Responses generated across parameter versions (start_version, end_version): how many, their share, the widest span."""
    span = F.col("end_version") - F.col("start_version")
    return rows.agg(F.count_if(span > 0).alias("partial"), F.avg((span > 0).cast("double")).alias("share"), F.max(span).alias("widest"), F.count_distinct("end_version").alias("versions"))


def masked_mean(values: str, mask: str) -> Column:
    pairs = F.zip_with(values, mask, lambda v, m: F.when(m == 1, v).otherwise(0.0))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return total / (F.aggregate(mask, F.lit(0.0), lambda s, x: s + x) + 1e-8)


def ppo_clip_loss(old: str, new: str, advantages: str, low: float = 0.2, high: float = 0.2) -> Column:
    """Per-token clipped policy loss of logged log-probabilities."""
    ratio = F.zip_with(new, old, lambda a, b: F.exp(F.least(F.greatest(a - b, F.lit(-20.0)), F.lit(20.0))))
    return F.zip_with(ratio, advantages, lambda r, a: F.greatest(-a * r, -a * F.least(F.greatest(r, F.lit(1 - low)), F.lit(1 + high))))


def kl_k3(new: str, old: str) -> Column:
    """Per-token k3 estimate of the divergence, clamped."""
    def one(a: Column, b: Column) -> Column:
        d = F.least(F.greatest(b - a, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(d) - d - 1, F.lit(-10.0)), F.lit(10.0))

    return F.zip_with(new, old, one)
