"""More registered queries: ordered pipelines, metrics, rows, scorers, transcripts, files, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.catalog import _LINES, _ROLL, _TOK, _numbered_nation, _rollouts, _t, _tokens, register
from spindle.functions import mathscore, transcripts
from spindle.operators import balance, groups, losses, metrics, registry, replay, rows, tokens
from spindle.plans import patterns
from spindle.plans.shell import compile_pipeline, execute
from spindle.sources import datasets, sinks
from spindle.sources.scratch import hold, shared_dir
from spindle.sources.tables import corpus_lines, keep_split, read_jsonl
from spindle.streaming import samples


def _scratch(spark: SparkSession, name: str) -> str:
    return hold(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def _rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- pipelines whose order counts: lines with their places -------------------------


def _ordered(name: str, text: str, sql: str) -> None:
    """``sql`` gives nr and line; the pipeline's output is short enough to be numbered in one task."""

    @register(name, f"WITH {_LINES}{sql if sql.startswith(',') else ' ' + sql}")
    def run(spark: SparkSession, d: str, text: str = text) -> DataFrame:
        s = compile_pipeline(text, corpus_lines(_t(spark, d, "documents")))
        return s.rows.select(F.row_number().over(Window.orderBy(*s.by())).cast("bigint").alias("nr"), "line")


_LICENSE = "contains(line, 'License')"
_ordered(
    "ordered_sort_uniq_count",
    "rg -F License c | sort | uniq -c | head -n 3",
    f"SELECT row_number() OVER (ORDER BY l) AS nr, lpad(CAST(n AS VARCHAR), 7, ' ') || ' ' || l AS line FROM (SELECT line AS l, count(*) AS n FROM lines WHERE {_LICENSE} GROUP BY line ORDER BY l LIMIT 3)",
)
_ordered(
    "ordered_sort_cut",
    "rg -F License c | sort | cut -d ' ' -f 2 | head -n 9",
    f"SELECT row_number() OVER (ORDER BY l, i) AS nr, CASE WHEN contains(l, ' ') THEN string_split(l, ' ')[2] ELSE l END AS line FROM (SELECT line AS l, line_no AS i FROM lines WHERE {_LICENSE} ORDER BY l, i LIMIT 9)",
)
_ordered(
    "ordered_sort_sed",
    "rg -F License c | sort -r | sed 's/[aeiou]//g' | head -n 9",
    f"SELECT row_number() OVER (ORDER BY l DESC, i) AS nr, regexp_replace(l, '[aeiou]', '', 'g') AS line FROM (SELECT line AS l, line_no AS i FROM lines WHERE {_LICENSE} ORDER BY l DESC, i LIMIT 9)",
)
_ordered(
    "ordered_sort_key",
    "rg -F License c | sort -t ' ' -k 3,3r -k 1,1 | head -n 12",
    f"SELECT row_number() OVER (ORDER BY coalesce(p[3], '') DESC, p[1], l) AS nr, l AS line FROM (SELECT line AS l, string_split(line, ' ') AS p FROM lines WHERE {_LICENSE} ORDER BY coalesce(p[3], '') DESC, p[1], l LIMIT 12)",
)
_ordered(
    "ordered_sort_place",
    "rg -F License c | sort | sed -n '3,6p'",
    f"SELECT nr - 2 AS nr, line FROM (SELECT row_number() OVER (ORDER BY line, line_no) AS nr, line FROM lines WHERE {_LICENSE}) WHERE nr BETWEEN 3 AND 6",
)
_ordered(
    "ordered_uniq_runs",
    "cut -c 1 c | uniq -c | head -n 40",
    """, f AS (SELECT line_no, substring(line, 1, 1) AS l FROM lines), g AS (SELECT *, row_number() OVER (ORDER BY line_no) - row_number() OVER (PARTITION BY l ORDER BY line_no) AS g FROM f),
    r AS (SELECT min(line_no) AS i, l, count(*) AS n FROM g GROUP BY l, g ORDER BY i LIMIT 40) SELECT row_number() OVER (ORDER BY i) AS nr, lpad(CAST(n AS VARCHAR), 7, ' ') || ' ' || l AS line FROM r""",
)
_ordered(
    "ordered_complement",
    "rg -F License c | tr -cd 'a-z\\n' | head -n 5",
    f"SELECT row_number() OVER (ORDER BY i) AS nr, regexp_replace(l, '[^a-z]', '', 'g') AS line FROM (SELECT line AS l, line_no AS i FROM lines WHERE {_LICENSE} ORDER BY i LIMIT 5)",
)
_ordered(
    "grep_basic_pattern",
    "grep -n 'ion\\+s\\? of' c | head -n 5",
    "SELECT row_number() OVER (ORDER BY line_no) AS nr, (line_no + 1) || ':' || line AS line FROM lines WHERE regexp_matches(line, 'ion+s? of') ORDER BY line_no LIMIT 5",
)
_ordered("search_files_with_matches", "rg -l -F License corpus.jsonl", "SELECT 1::BIGINT AS nr, 'corpus.jsonl' AS line")
_ordered(
    "search_json",
    "rg --json -F License c | head -n 3",
    """SELECT row_number() OVER (ORDER BY line_no) AS nr, '{"type":"match","data":{"path":{"text":"c"},"lines":{"text":' || to_json(line || chr(10)) || '},"line_number":' || (line_no + 1) || ',"submatches":[' ||
    array_to_string([ '{"match":{"text":"License"},"start":' || strlen(array_to_string(p[:i], 'License')) || ',"end":' || (strlen(array_to_string(p[:i], 'License')) + 7) || '}' for i in range(1, len(p)) ], ',') || ']}}' AS line
    FROM (SELECT *, string_split(line, 'License') AS p FROM lines WHERE contains(line, 'License') ORDER BY line_no LIMIT 3)""",
)


@register("pipeline_result", f"WITH {_LINES}, h AS (SELECT line, line_no FROM lines WHERE contains(line, 'License') ORDER BY line_no LIMIT 4) SELECT 0 AS exit_code, string_agg(line || chr(10), '' ORDER BY line_no) AS stdout, count(*) AS n_lines FROM h")
def pipeline_result(spark: SparkSession, d: str) -> DataFrame:
    done = execute("rg -F License corpus.jsonl | head -n 4", corpus_lines(_t(spark, d, "documents")))
    return spark.createDataFrame([(done.exit_code, done.stdout, len(done.information_lines))], "exit_code int, stdout string, n_lines bigint")


@register("pipeline_refused", "SELECT -2 AS exit_code, 'validation error: disallowed: destructive/write command' AS stderr")
def pipeline_refused(spark: SparkSession, d: str) -> DataFrame:
    done = execute("rg -F install corpus.jsonl", corpus_lines(_t(spark, d, "documents")))
    return spark.createDataFrame([(done.exit_code, done.stderr)], "exit_code int, stderr string")


@register("casefolded", "SELECT doc_id, md5(replace(lower(left(text, 2000)), 'ß', 'ss')) AS folded FROM documents WHERE NOT regexp_matches(left(text, 2000), '[^\\x00-\\xFF]|µ')")
def casefolded(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where(~F.left("text", F.lit(2000)).rlike("[^\\x00-\\xFF]|µ"))
    return docs.select("doc_id", F.md5(patterns.casefold(F.left("text", F.lit(2000)))).alias("folded"))


# --- metrics -----------------------------------------------------------------------


@register("value_summary", "SELECT event_type, round(sum(value), 5) AS sum, round(avg(value), 7) AS mean, list_sort(list(value))[count(*) // 2 + 1] AS median, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    out = _t(spark, d, "events").groupBy("event_type").agg(*metrics.summary("value"))
    return out.select("event_type", F.round("sum", 5).alias("sum"), F.round("mean", 7).alias("mean"), "median", "min", "max")


@register("interpolated_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 7) AS tp50, round(quantile_cont(value, 0.95), 7) AS tp95, round(quantile_cont(value, 0.99), 7) AS tp99 FROM events GROUP BY 1")
def interpolated_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_t(spark, d, "events").groupBy("event_type").agg(*metrics.interpolated("value")))


@register("time_shares", "SELECT o_orderpriority AS kind, round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / sum(o_totalprice), 9) AS share FROM orders GROUP BY 1")
def time_shares(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("part", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return o.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.round(metrics.time_share("part", "o_totalprice"), 9).alias("share"))


@register(
    "run_counters",
    """SELECT count(*) AS total, count(*) FILTER (l_discount > 0) AS success, count(*) FILTER (l_discount > 0.08) AS em, count(*) FILTER (l_discount = 0) AS zero_f1, count(*) FILTER (l_returnflag = 'R') AS aborted,
    count(*) FILTER (l_linestatus = 'F' AND l_quantity > 10) AS judge_pass, count(*) FILTER (l_linestatus = 'F' AND l_quantity <= 10) AS judge_fail, count(*) FILTER (l_linestatus <> 'F') AS judge_unknown,
    round(avg(l_discount) FILTER (l_discount > 0), 9) AS kept_f1 FROM lineitem""",
)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "lineitem").select(
        (F.col("l_discount") > 0).alias("success"), (F.col("l_discount") > 0.08).alias("em"), F.col("l_discount").alias("f1"), F.when(F.col("l_returnflag") == "R", "x").alias("abort_reason"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 10).alias("judge"),
    )
    return _rounded(metrics.run_counters(r), 9)


_RESP = "resp AS (SELECT o_orderkey AS response_id, o_totalprice / 1000 AS score, o_totalprice / 2000 AS reward, o_orderkey % 50 AS response_length, o_custkey % 40 + 1 AS prompt_length FROM orders)"


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("response_id"), (F.col("o_totalprice") / 1000).alias("score"), (F.col("o_totalprice") / 2000).alias("reward"),
        (F.col("o_orderkey") % 50).alias("response_length"), (F.col("o_custkey") % 40 + 1).alias("prompt_length"),
    )


def _three(c: str, where: str = "") -> str:
    f = f" FILTER ({where})" if where else ""
    return ", ".join(f'round({k}({c}){f}, 6) + 0.0 AS "{c}/{n}"' for k, n in (("avg", "mean"), ("max", "max"), ("min", "min")))


@register(
    "data_metrics",
    f"""WITH {_TOK}, {_RESP} SELECT * FROM (SELECT {_three('advantage', 'mask = 1')}, {_three('ret', 'mask = 1')}, {_three('value', 'mask = 1')},
      round(1 - var_samp(ret - value) FILTER (mask = 1) / (var_samp(ret) FILTER (mask = 1) + 1e-5), 6) AS explained_variance FROM tok),
    (SELECT {_three('score', 'response_length > 0')}, {_three('reward', 'response_length > 0')}, {_three('CAST(response_length AS DOUBLE)').replace('"CAST(response_length AS DOUBLE)/', '"response_length/')},
      {_three('CAST(prompt_length AS DOUBLE)').replace('"CAST(prompt_length AS DOUBLE)/', '"prompt_length/')}, round(avg(CAST(response_length = 49 AS DOUBLE)), 6) AS "response_length/clip_ratio", round(avg(CAST(response_length = 0 AS DOUBLE)), 6) AS aborted_ratio FROM resp)""",
)
def data_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.data_metrics(_tokens(spark, d), _responses(spark, d).withColumn("response_length", F.col("response_length").cast("double")).withColumn("prompt_length", F.col("prompt_length").cast("double")), 49)
    return out.select(*[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) for c in out.columns])


@register(
    "stage_timings",
    f"""WITH {_RESP}, s(stage, seconds) AS (VALUES ('gen', 12.5), ('ref', 3.0), ('reward', 2.0), ('update_actor', 20.25))
    SELECT stage, seconds::DOUBLE AS seconds, round(CASE WHEN stage = 'gen' THEN seconds * 1000 / (SELECT sum(response_length) FROM resp) WHEN stage <> 'reward' THEN seconds * 1000 / (SELECT sum(response_length + prompt_length) FROM resp) END, 9) AS per_token_ms FROM s""",
)
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    stages = spark.createDataFrame([("gen", 12.5), ("ref", 3.0), ("reward", 2.0), ("update_actor", 20.25)], "stage string, seconds double")
    return metrics.timings(stages, _responses(spark, d)).withColumn("per_token_ms", F.round("per_token_ms", 9))


@register("throughput", f"WITH {_RESP} SELECT CAST(sum(response_length + prompt_length) AS BIGINT) AS total_tokens, 40.0::DOUBLE AS seconds, round(sum(response_length + prompt_length) / 160.0, 6) AS throughput FROM resp")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.throughput(_responses(spark, d), 40, 4), 6)


@register(
    "variance_proxies",
    f"""WITH {_TOK}, p AS (SELECT sum(advantage * mask) / (sum(mask) + 1e-8) AS a, sum((1 - 2 * exp(old) + sum_pi_squared) * mask) AS w FROM tok GROUP BY response_id)
    SELECT round(0.25::DOUBLE, 7) AS signal, round(avg(a * a * greatest(w, 0)) * (sum(0) + 1), 7) AS power, round(greatest(0, (avg(a * a * greatest(w, 0)) - 0.25) / (count(*) - 1)), 7) AS noise, round(avg(a * a), 7) AS a_squared, round(avg(w), 7) AS w FROM p""",
)
def variance_proxies(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.variance_proxies(_tokens(spark, d).withColumn("one", F.lit(1.0)), 0.5))


@register(
    "metrics_across_ranks",
    """WITH r AS (SELECT user_id % 4 AS rank, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS step, event_type AS name, value FROM events),
    k AS (SELECT * FROM r WHERE step <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY name, rank))), s AS (SELECT name, step, avg(value) AS a, max(value) AS m FROM k GROUP BY ALL)
    SELECT name, CASE WHEN name < 'd' THEN 'sum' WHEN name < 'q' THEN 'max' ELSE 'mean' END AS kind, round(CASE WHEN name < 'd' THEN sum(a) WHEN name < 'q' THEN max(m) ELSE avg(a) END, 5) AS value FROM s GROUP BY name""",
)
def metrics_across_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("rank", F.col("user_id") % 4)
    e = e.withColumn("step", F.row_number().over(Window.partitionBy("event_type", "rank").orderBy("event_id")))
    least = e.groupBy("event_type", "rank").count().agg(F.min("count").alias("_n"))
    kind = F.when(F.col("event_type") < "d", "sum").when(F.col("event_type") < "q", "max").otherwise("mean")
    logged = e.join(F.broadcast(least)).where("step <= _n").select("rank", "step", F.col("event_type").alias("name"), kind.alias("kind"), "value")
    return _rounded(metrics.across_ranks(logged), 5)


@register(
    "metrics_over_steps",
    """WITH m AS (SELECT CASE event_id % 6 WHEN 0 THEN 'perf/time_per_step' WHEN 1 THEN 'training/global_step' WHEN 2 THEN 'timing_s/gen' WHEN 3 THEN 'critic/score/max' WHEN 4 THEN 'tokens/total_min' ELSE 'actor/loss' END AS name, event_id AS step, value FROM events)
    SELECT name, CASE event_id6 WHEN 0 THEN 'sum' WHEN 1 THEN 'last' WHEN 2 THEN 'sum' WHEN 3 THEN 'max' WHEN 4 THEN 'min' ELSE 'avg' END AS kind,
      round(CASE event_id6 WHEN 0 THEN sum(value) WHEN 1 THEN arg_max(value, step) WHEN 2 THEN sum(value) WHEN 3 THEN max(value) WHEN 4 THEN min(value) ELSE avg(value) END, 5) AS value FROM (SELECT *, step % 6 AS event_id6 FROM m) GROUP BY name, event_id6""",
)
def metrics_over_steps(spark: SparkSession, d: str) -> DataFrame:
    names = ["perf/time_per_step", "training/global_step", "timing_s/gen", "critic/score/max", "tokens/total_min", "actor/loss"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    return _rounded(metrics.over_steps(_t(spark, d, "events").select(name.alias("name"), F.col("event_id").alias("step"), "value")), 5)


_PICK = "('0x' || substr(md5('42:' || uid || ':' || draw || ':' || i), 1, 8))::BIGINT % n"
_DRAWN = f"""p AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY response_id) - 1 AS spot, count(*) OVER (PARTITION BY uid) AS n FROM r),
    k AS (SELECT DISTINCT uid, n FROM p), q AS (SELECT uid, draw, i, {_PICK} AS spot FROM k, range(20) a(draw), range(4) b(i))"""


@register(
    "bootstrap_best",
    f"WITH {_ROLL}, {_DRAWN}, v AS (SELECT uid, draw, max(score) AS v FROM q JOIN p USING (uid, spot) GROUP BY ALL) SELECT uid, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM v GROUP BY uid",
)
def bootstrap_best(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.bootstrap(_rollouts(spark, d), 4, 20), 5)


@register(
    "bootstrap_majority",
    f"""WITH r AS (SELECT o_custkey AS uid, o_orderkey AS response_id, o_totalprice AS score, o_orderpriority AS vote FROM orders), {_DRAWN},
    v AS (SELECT uid, draw, vote, count(*) AS c, min(i) AS f FROM q JOIN p USING (uid, spot) GROUP BY ALL), t AS (SELECT uid, draw, arg_min(f, -c * 1000 + f) AS i FROM v GROUP BY ALL)
    SELECT uid, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std FROM t JOIN q USING (uid, draw, i) JOIN p USING (uid, spot) GROUP BY uid""",
)
def bootstrap_majority(spark: SparkSession, d: str) -> DataFrame:
    r = _rollouts(spark, d).drop("score").join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("response_id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("vote")), "response_id")
    return _rounded(metrics.bootstrap(r, 4, 20, reduce="majority"), 4)


@register("validation_metrics")
def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(
        F.col("o_orderstatus").alias("data_source"), (F.col("o_custkey") % 20).alias("uid"), F.col("o_orderkey").alias("response_id"), F.lit("acc").alias("variable"), (F.col("o_totalprice") % 2).alias("score"), F.col("o_orderpriority").alias("vote")
    )
    return metrics.routed(metrics.validation_metrics(o, 4, vote=True, draws=20))


@register(
    "validation_means",
    """WITH g AS (SELECT o_orderstatus AS data_source, o_custkey % 20 AS uid, avg(o_totalprice % 2) AS m, stddev_pop(o_totalprice % 2) AS s FROM orders GROUP BY ALL)
    SELECT data_source, 'mean@4' AS metric, 'val-core' AS section, round(avg(m), 6) AS value FROM g GROUP BY 1 UNION ALL SELECT data_source, 'std@4', 'val-aux', round(avg(s), 6) FROM g GROUP BY 1""",
)
def validation_means(spark: SparkSession, d: str) -> DataFrame:
    return validation_metrics(spark, d).where("metric in ('mean@4', 'std@4')").select("data_source", "metric", "section", F.round("value", 6).alias("value"))


@register(
    "imbalance",
    """WITH r AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey % 90 + 1 AS n FROM orders), c AS (SELECT i // CAST(ceil((SELECT count(*) FROM r) / 8.0) AS BIGINT) AS p, sum(n) AS s FROM r GROUP BY 1),
    b AS (SELECT i % 8 AS p, sum(n) AS s FROM r GROUP BY 1) SELECT CAST((SELECT min(s) FROM c) AS BIGINT) AS min, CAST((SELECT max(s) FROM c) AS BIGINT) AS max, CAST((SELECT max(s) - min(s) FROM c) AS BIGINT) AS spread,
    CAST((SELECT min(s) FROM b) AS BIGINT) AS min_balanced, CAST((SELECT max(s) FROM b) AS BIGINT) AS max_balanced, CAST((SELECT max(s) - min(s) FROM b) AS BIGINT) AS spread_balanced, round((SELECT sum(n) / 8.0 FROM r), 4) AS mean""",
)
def imbalance(spark: SparkSession, d: str) -> DataFrame:
    o = rows.renumbered(_t(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 90 + 1).alias("length")))
    return _rounded(metrics.imbalance(o.withColumn("part", F.col("row_id") % 8), 8, o.count(), "part"), 4)


@register(
    "rejection_metrics",
    f"""WITH {_TOK}, d AS (SELECT *, exp(greatest(least(new - old, 20), -20)) AS w FROM tok), k AS (SELECT *, CASE WHEN w BETWEEN 0.5 AND 1.5 THEN mask ELSE 0 END AS kept FROM d)
    SELECT round(avg(w) FILTER (mask = 1), 6) AS mean, round(max(w) FILTER (mask = 1), 6) AS max, round(min(w) FILTER (mask = 1), 6) AS min, round(avg(CAST(w > 1.5 AS DOUBLE)) FILTER (mask = 1), 6) AS high,
    round(avg(CAST(w < 0.5 AS DOUBLE)) FILTER (mask = 1), 6) AS low, round(stddev_pop(least(greatest(w, 0.5), 1.5)) FILTER (mask = 1), 6) AS std, round(avg(CAST(kept = 0 AS DOUBLE)) FILTER (mask = 1), 6) AS rejected_tokens,
    (SELECT round(avg(h), 6) FROM (SELECT CAST(max(CAST(mask = 1 AND kept = 0 AS INT)) AS DOUBLE) AS h FROM k GROUP BY response_id HAVING sum(mask) > 0)) AS rejected_responses FROM k""",
)
def rejection_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = tokens.reject(_tokens(spark, d), {"token_k1": (1 / 1.5, 2.0)})
    return _rounded(metrics.rejection_metrics(t, F.exp(tokens.clamp(F.col("new") - F.col("old"), -20, 20)), 0.5, 1.5), 6)


@register("version_spans", "SELECT count(*) FILTER (o_custkey % 3 > 0) AS partial, round(avg(CAST(o_custkey % 3 > 0 AS DOUBLE)), 7) AS share, max(o_custkey % 3) AS widest, count(DISTINCT o_custkey % 3 + o_orderkey % 5) AS versions FROM orders")
def version_spans(spark: SparkSession, d: str) -> DataFrame:
    start, span = F.col("o_orderkey") % 5, F.col("o_custkey") % 3
    return _rounded(metrics.version_spans(_t(spark, d, "orders").select(start.alias("start_version"), (start + span).alias("end_version"))))


# --- estimators and losses ----------------------------------------------------------


@register(
    "advantage_pass_at_k_scaled",
    f"""WITH {_ROLL}, k AS (SELECT *, row_number() OVER o AS i, lead(score) OVER o AS second, count(*) OVER (PARTITION BY uid) AS n, stddev_samp(score) OVER (PARTITION BY uid) AS s FROM r WINDOW o AS (PARTITION BY uid ORDER BY score DESC, response_id))
    SELECT response_id, round(CASE WHEN i = 1 AND n > 1 THEN (score - second) / (s + 1e-6) ELSE 0 END, 6) + 0.0 AS advantage FROM k""",
)
def advantage_pass_at_k_scaled(spark: SparkSession, d: str) -> DataFrame:
    return registry.ESTIMATORS.get("pass_at_k")(_rollouts(spark, d), True).select("response_id", (F.round("advantage", 6) + 0.0).alias("advantage"))


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d).groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("reward").alias("rewards"), F.col("value").alias("values"), "mask"))).alias("_t"))
    return t.select("response_id", F.col("_t.rewards").alias("rewards"), F.col("_t.values").alias("values"), F.col("_t.mask").alias("mask"))


@register(
    "advantage_gae",
    f"""WITH RECURSIVE {_TOK}, m AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY pos DESC) AS k FROM tok),
    g AS (SELECT response_id, pos, k, CASE WHEN mask = 1 THEN reward - value ELSE 0 END AS adv, CASE WHEN mask = 1 THEN value ELSE 0 END AS nxt FROM m WHERE k = 1
      UNION ALL SELECT m.response_id, m.pos, m.k, CASE WHEN mask = 1 THEN reward + 0.99 * nxt - value + 0.99 * 0.95 * adv ELSE adv END, CASE WHEN mask = 1 THEN value ELSE nxt END FROM g JOIN m ON m.response_id = g.response_id AND m.k = g.k + 1)
    SELECT response_id, pos, round(adv * 1.000731372918461, 6) + 0.0 AS advantage FROM g""",
)
def advantage_gae(spark: SparkSession, d: str) -> DataFrame:
    out = tokens.explode_tokens(groups.gae(_arrays(spark, d), 0.99, 0.95), ["response_id"], ["advantages"])
    return out.select("response_id", F.col("pos").cast("bigint").alias("pos"), (F.round(F.col("advantages") * 1.000731372918461, 6) + 0.0).alias("advantage"))


@register(
    "kl_penalised",
    f"WITH {_TOK}, x AS (SELECT *, greatest(least(new - old, 20), -20) AS d FROM tok) SELECT response_id, pos, round(reward - 0.1 * greatest(least(exp(d) - 1 - d, 10), -10) * mask, 5) + 0.0 AS penalised FROM x",
)
def kl_penalised(spark: SparkSession, d: str) -> DataFrame:
    t = tokens.kl_penalised(_tokens(spark, d).withColumn("ref", F.col("new")), 0.1, "k3")
    return t.select("response_id", F.col("pos").cast("bigint").alias("pos"), (F.round("penalised", 5) + 0.0).alias("penalised"))


@register(
    "adaptive_coefficient",
    "SELECT event_id AS step, round(0.2 * exp(sum(ln(1 + greatest(least(value / 100 - 1, 0.2), -0.2) * 32 / 10000)) OVER (ORDER BY event_id)), 8) AS coefficient FROM events WHERE event_type = 'error'",
)
def adaptive_coefficient(spark: SparkSession, d: str) -> DataFrame:
    steps = _t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("step"), F.col("value").alias("kl"), F.lit(32).alias("n"))
    return tokens.adaptive_coefficient(steps, 0.2, 100.0, 10_000.0).select("step", F.round("coefficient", 8).alias("coefficient"))


@register(
    "softmax_sums",
    """WITH l AS (SELECT p_partkey, [p_size / 10.0, p_retailprice / 500, 1.5] AS x FROM part), z AS (SELECT p_partkey, x, ln(list_sum([exp(v) for v in x])) AS z FROM l)
    SELECT p_partkey, round(x[p_partkey % 3 + 1] - z, 8) AS log_prob, round(-list_sum([exp(v - z) * (v - z) for v in x]), 8) AS entropy, round(list_sum([exp(2 * (v - z)) for v in x]), 8) AS sum_pi_squared FROM z""",
)
def softmax_sums(spark: SparkSession, d: str) -> DataFrame:
    logits = F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 500, F.lit(1.5))
    out = _t(spark, d, "part").select("p_partkey", tokens.softmax_sums(logits, (F.col("p_partkey") % 3).cast("int")).alias("s")).select("p_partkey", "s.*")
    return _rounded(out, 8)


_COV = f"""{_TOK}, c AS (SELECT *, (advantage - (SELECT avg(advantage) FROM tok WHERE mask = 1)) * (new - (SELECT avg(new) FROM tok WHERE mask = 1)) AS cov, (SELECT sum(mask) FROM tok) AS n FROM tok WHERE mask = 1)"""


@register("largest_covariance", f"WITH {_COV} SELECT response_id, pos FROM c QUALIFY row_number() OVER (ORDER BY round(cov, 9) DESC, response_id, pos) <= greatest(1, CAST(floor(n * 0.01) AS INT))")
def largest_covariance(spark: SparkSession, d: str) -> DataFrame:
    c = tokens.covariance(_tokens(spark, d))
    out = tokens._first(c.withColumn("cov", F.round("cov", 9)), [-F.col("cov")], 0.01, "chosen")
    return out.where("chosen").select("response_id", F.col("pos").cast("bigint").alias("pos"))


@register("banded_covariance", f"WITH {_COV} SELECT response_id, pos FROM c WHERE cov > 0.1 AND cov < 0.5 QUALIFY row_number() OVER (ORDER BY md5('3:' || response_id || ':' || pos)) <= greatest(1, CAST(floor(n * 0.01) AS INT))")
def banded_covariance(spark: SparkSession, d: str) -> DataFrame:
    out = tokens.banded_covariance(_tokens(spark, d), 0.01, 0.1, 0.5, 3)
    return out.where("chosen").select("response_id", F.col("pos").cast("bigint").alias("pos"))


_RATIO = "exp(greatest(least(new - old, 20), -20))"


@register(
    "loss_kl_covariance",
    f"""WITH {_COV}, t AS (SELECT response_id, pos, row_number() OVER (ORDER BY cov DESC, response_id, pos) <= greatest(1, CAST(floor(n * 0.01) AS INT)) AS chosen FROM c)
    SELECT round(sum((-advantage * {_RATIO} + CASE WHEN t.chosen THEN abs(new - old) ELSE 0 END) * mask) / sum(mask), 7) AS loss FROM tok JOIN t USING (response_id, pos)""",
)
def loss_kl_covariance(spark: SparkSession, d: str) -> DataFrame:
    t = tokens.largest_covariance(_tokens(spark, d), 0.01)
    return _rounded(losses.aggregate(t, {"loss": registry.POLICY_LOSSES.get("kl_covariance")()}))


@register(
    "loss_clip_covariance",
    f"""WITH {_COV}, t AS (SELECT response_id, pos, cov > 0.1 AND cov < 0.5 AND row_number() OVER (ORDER BY cov > 0.1 AND cov < 0.5 DESC, md5('3:' || response_id || ':' || pos)) <= greatest(1, CAST(floor(n * 0.01) AS INT)) AS chosen FROM c)
    SELECT round(sum(CASE WHEN t.chosen THEN 0 ELSE greatest(-advantage * {_RATIO}, -advantage * greatest(least({_RATIO}, 1.2), 0.8)) END * mask) / sum(mask), 7) AS loss FROM tok JOIN t USING (response_id, pos)""",
)
def loss_clip_covariance(spark: SparkSession, d: str) -> DataFrame:
    t = tokens.banded_covariance(_tokens(spark, d), 0.01, 0.1, 0.5, 3)
    return _rounded(losses.aggregate(t, {"loss": registry.POLICY_LOSSES.get("clip_covariance")()}))


@register("loss_horizon", f"WITH {_TOK}, p AS (SELECT sum(mask) AS n, sum(-advantage * new * mask) AS s FROM tok GROUP BY response_id) SELECT round(avg(s) FILTER (n > 0) / 128, 7) AS loss FROM p")
def loss_horizon(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses.aggregate(_tokens(spark, d), {"loss": losses.log_prob()}, "seq-mean-token-sum-norm", 128.0))


@register("loss_distillation", f"WITH {_TOK} SELECT round(sum(greatest(advantage, 0) * mask) / sum(mask), 7) AS forward, round(sum(abs(greatest(least(old - new, 20), -20)) * mask) / sum(mask), 7) AS reverse FROM tok")
def loss_distillation(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d).withColumn("teacher_kl", F.col("advantage")).withColumn("teacher", F.col("old"))
    forward, reverse = registry.DISTILLATION_LOSSES.get("forward_kl"), registry.DISTILLATION_LOSSES.get("reverse_kl")
    return _rounded(losses.aggregate(t, {"forward": forward(), "reverse": reverse("abs")}))


@register(
    "correction_combined",
    f"""WITH {_TOK}, d AS (SELECT *, exp(greatest(least(new - old, 20), -20)) AS r FROM tok), k AS (SELECT *, least(r * mask, 1.2) AS w, CASE WHEN r BETWEEN 0.5 AND 1.5 THEN mask ELSE 0 END AS kept FROM d)
    SELECT round(sum(-advantage * new * w * kept) / sum(kept), 7) AS loss, CAST(sum(kept) AS BIGINT) AS n, (SELECT round(avg(old - new), 7) FROM tok WHERE mask = 1) AS kl FROM k""",
)
def correction_combined(spark: SparkSession, d: str) -> DataFrame:
    t, before = tokens.corrected(_tokens(spark, d), {"level": "token", "upper": 1.2}, {"token_k1": (1 / 1.5, 2.0)})
    loss = losses.aggregate(t, {"loss": losses.weighted(losses.log_prob())})
    kept = t.agg(F.sum("mask").cast("bigint").alias("n"))
    return _rounded(loss.crossJoin(kept).crossJoin(before.select(F.col("`rollout_corr/kl`").alias("kl"))))


# --- rows ---------------------------------------------------------------------------


@register("rows_slice_backwards", "SELECT n_nationkey AS row_id, (22 - n_nationkey) // 3 AS place FROM nation WHERE n_nationkey <= 22 AND n_nationkey > 4 AND (22 - n_nationkey) % 3 = 0")
def rows_slice_backwards(spark: SparkSession, d: str) -> DataFrame:
    return rows.slice_rows(_numbered_nation(spark, d), -3, 4, -3).select(F.col("row_id").cast("int").alias("row_id"), "place")


@register("rows_select_ids", "SELECT i AS row_id, n_name FROM range(40) t(i) JOIN nation ON n_nationkey = (i * 7) % 25")
def rows_select_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.range(40).select(F.col("id").alias("place"), (F.col("id") * 7 % 25).alias("row_id"))
    return rows.select_ids(_numbered_nation(spark, d), ids)


@register("rows_select_where", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_name FROM nation WHERE n_nationkey % 3 = 1")
def rows_select_where(spark: SparkSession, d: str) -> DataFrame:
    return rows.select_where(_numbered_nation(spark, d).withColumn("m", F.col("row_id") % 3 == 1), "m")


@register("rows_select_pop", "SELECT n_nationkey AS row_id, n_name AS title FROM nation")
def rows_select_pop(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").withColumn("row_id", F.col("n_nationkey").cast("bigint"))
    popped, _ = rows.pop(rows.select(nation, ["n_name", "n_regionkey"]), ["n_name"])
    return rows.rename(popped, ["n_name"], ["title"]).withColumn("row_id", F.col("row_id").cast("int"))


@register("rows_concat", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, n_name FROM nation UNION ALL SELECT 25 + n_nationkey, n_name FROM nation")
def rows_concat(spark: SparkSession, d: str) -> DataFrame:
    return rows.concat([_numbered_nation(spark, d), _numbered_nation(spark, d)])


@register("rows_reorder", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, n_name FROM nation")
def rows_reorder(spark: SparkSession, d: str) -> DataFrame:
    order = spark.range(25).select(F.col("id").alias("place"), (F.col("id") * 7 % 25).alias("row_id"))
    return rows.restore(rows.reorder(_numbered_nation(spark, d), order), order)


@register("rows_pad_with", "SELECT CAST(i AS BIGINT) AS row_id, n_name FROM range(28) t(i) JOIN nation ON n_nationkey = least(i, 24)")
def rows_pad_with(spark: SparkSession, d: str) -> DataFrame:
    return rows.pad_with(_numbered_nation(spark, d), 3)


@register("rows_unpad", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, n_name FROM nation")
def rows_unpad(spark: SparkSession, d: str) -> DataFrame:
    return rows.unpad(rows.pad_to_multiple(_numbered_nation(spark, d), 64))


@register("rows_unfold_chunks", "SELECT CAST(n_nationkey * 2 + k AS BIGINT) AS row_id, n_name, CAST(n_nationkey + 2 * k AS VARCHAR) || ',' || CAST(n_nationkey + 2 * k + 1 AS VARCHAR) AS part FROM nation, range(2) t(k)")
def rows_unfold_chunks(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("row_id")
    out = rows.unfold_chunks(_numbered_nation(spark, d).withColumn("x", F.array(r, r + 1, r + 2, r + 3)), "x", 2)
    return out.select("row_id", "n_name", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("part"))


@register("rows_mini_batches", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, CAST(e AS INT) AS epoch, (row_number() OVER (PARTITION BY e ORDER BY md5('5:' || e || ':' || n_nationkey), n_nationkey) - 1) // 5 AS batch FROM nation, range(2) t(e)")
def rows_mini_batches(spark: SparkSession, d: str) -> DataFrame:
    return rows.mini_batches(_numbered_nation(spark, d), 5, 2, 25, 5).select("row_id", "epoch", F.col("batch").cast("bigint").alias("batch"))


@register("rows_checked", "SELECT CAST(n_nationkey AS BIGINT) AS row_id FROM nation")
def rows_checked(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered_nation(spark, d).withColumn("a", F.array("row_id")).withColumn("b", F.array("n_name"))
    return rows.check_lengths(n, ["a", "b"]).select("row_id")


@register("ids_in_all", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def ids_in_all(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return rows.intersect_ids([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")], "o_custkey")


@register("ids_in_any", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def ids_in_any(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return rows.union_ids([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'")], "o_custkey")


@register("rows_limit_then_keep", "SELECT doc_id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) WHERE n_chars > 500 ORDER BY doc_id LIMIT 10 OFFSET 5")
def rows_limit_then_keep(spark: SparkSession, d: str) -> DataFrame:
    return rows.limit_then_keep(_t(spark, d, "documents").withColumn("row_id", F.col("doc_id")), "n_chars > 500", 100, 5, 10).select("doc_id")


@register("rows_short_prompts", r"SELECT conv_id, turn FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 30")
def rows_short_prompts(spark: SparkSession, d: str) -> DataFrame:
    return rows.short_prompts(_t(spark, d, "conversations"), "text", 30).select("conv_id", "turn")


@register("rows_answerable", "SELECT item_id FROM benchmark WHERE length(text) > 200 ORDER BY item_id LIMIT 10")
def rows_answerable(spark: SparkSession, d: str) -> DataFrame:
    golds = F.when(F.length("text") > 200, F.array("text")).otherwise(F.array().cast("array<string>"))
    return _t(spark, d, "benchmark").where(F.size(golds) > 0).orderBy("item_id").limit(10).select("item_id")


@register("rows_mixed", "SELECT source_name, key, md5('9:' || source_name || ':' || key) AS shuffle_key FROM (SELECT 'a' AS source_name, o_orderkey AS key FROM orders ORDER BY md5('9:' || o_orderkey), o_orderkey LIMIT 50) UNION ALL SELECT 'b', n_nationkey, md5('9:b:' || n_nationkey) FROM nation")
def rows_mixed(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    b = _t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"))
    return rows.mixed({"a": (a, 50), "b": (b, None)}, "key", 9)


@register("rows_weighted")
def rows_weighted(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rows.weighted_sample(o, "o_orderkey", "o_totalprice", 1000, 3)


@register("rows_grown", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, n_name FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY n_nationkey), lower(n_name) FROM nation WHERE n_nationkey % 2 = 0")
def rows_grown(spark: SparkSession, d: str) -> DataFrame:
    return rows.grown(_numbered_nation(spark, d), lambda r: r.withColumn("n_name", F.lower("n_name")), "row_id % 2 = 0")


@register("rows_split_named", "SELECT doc_id FROM documents WHERE lang = 'en'")
def rows_split_named(spark: SparkSession, d: str) -> DataFrame:
    return keep_split(_t(spark, d, "documents").select("doc_id", F.col("lang").alias("split")), "en").select("doc_id")


def _batched(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / 64).alias("batch"), (F.col("o_orderkey") % 64).alias("row_id"), F.floor(F.col("o_orderkey") / 4).alias("uid"), (F.col("o_totalprice") % 1000 + 1).cast("bigint").alias("length")
    )


@register("partition_grouped", "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey // 4) AS split_free FROM orders")
def partition_grouped(spark: SparkSession, d: str) -> DataFrame:
    out = balance.grouped_partition(_batched(spark, d), "batch", "uid", 4)
    runs = out.select((F.col("batch") * 16 + F.floor(F.col("row_id") / 4)).alias("g"), "part").distinct()
    return out.agg(F.count("*").alias("n_rows")).crossJoin(runs.agg(F.count("*").alias("split_free")))


# --- scorers, transcripts -------------------------------------------------------------


@register(
    "score_math",
    r"""SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN p_size = 7 THEN 1 ELSE 0 END WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE CASE WHEN p_size = 3 THEN 1 ELSE 0 END END)::DOUBLE AS score FROM part""",
)
def score_math(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("so \\boxed{x = \\dfrac"), F.lit("{"), size, F.lit("}{3}}.")))
        .when(k == 1, F.concat(F.lit("\\boxed{1} then \\boxed{"), size, F.lit("}")))
        .when(k == 2, F.lit("\\boxed{0.5}"))
        .when(k == 3, F.lit("nothing in a box"))
        .otherwise(F.concat(F.lit("$\\boxed "), size, F.lit("$")))
    )
    truth = F.when(k == 0, F.concat(F.lit("\\frac{"), size, F.lit("}{3}"))).when(k == 1, F.lit("7")).when(k == 2, F.lit("1/2")).when(k == 3, F.lit("x")).otherwise(F.lit("3"))
    return _t(spark, d, "part").select("p_partkey", mathscore.math_score(text, truth).alias("score"))


@register("score_final", "SELECT p_partkey, CASE WHEN p_size = 12 THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM part")
def score_final(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Answer: 3\nso the Answer: x = $"), F.col("p_size").cast("string"), F.lit(",000$ dollars"))
    return _t(spark, d, "part").select("p_partkey", mathscore.final_score(text, F.lit("12000")).alias("score"))


@register("score_by_source", "SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size = 7 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN p_size = 7 THEN 1 ELSE 0 END ELSE CASE WHEN p_size = 7 THEN 1 ELSE -1 END END)::DOUBLE AS score FROM part")
def score_by_source(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    source = F.when(k == 0, "openai/gsm8k").when(k == 1, "searchR1_nq").otherwise("aime2024")
    text = F.when(k == 0, F.concat(F.lit("#### "), size)).when(k == 1, F.concat(F.lit("<answer>"), size, F.lit("</answer>"))).otherwise(F.concat(F.lit("Answer: "), size))
    return _t(spark, d, "part").select("p_partkey", mathscore.score_by_source(source, text, F.lit("7")).alias("score"))


def _transcript(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts: even ones in order, odd ones with a turn missing its answer."""
    first = _t(spark, d, "conversations").where("turn = 0").select("conv_id", F.coalesce("text", F.lit("")).alias("t"))
    body = F.concat(F.lit("<think>"), "t", F.lit("</think>\n<tool_call>rg x</tool_call>\nuser\n<tool_response>"), "t", F.lit("</tool_response>\nassistant\n<reason>r</reason>"))
    k = F.col("conv_id") % 4
    end = F.when(k == 0, "<answer>a</answer>").when(k == 1, "").when(k == 2, "<answer>a</answer> and more").otherwise("<answer>a")
    return first.select("conv_id", F.concat(body, end).alias("text"))


@register(
    "format_gate",
    """SELECT conv_id, conv_id % 4 = 0 AS ok, CASE conv_id % 4 WHEN 0 THEN 'Valid sequence' WHEN 1 THEN 'Incomplete: ended in after_reason' WHEN 2 THEN 'Invalid trailing content after </answer>: ''and more...''' ELSE 'Tag mismatch for answer' END AS reason
    FROM conversations WHERE turn = 0""",
)
def format_gate(spark: SparkSession, d: str) -> DataFrame:
    return _transcript(spark, d).select("conv_id", transcripts.well_formed("text").alias("w")).select("conv_id", "w.ok", "w.reason")


@register(
    "planner_steps",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS prose, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS tool_call, CASE WHEN p_partkey % 3 = 1 THEN p_type END AS answer FROM part",
)
def planner_steps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    prose = F.when(k % 2 == 0, F.concat(F.lit("<think> "), "p_name", F.lit("</think>\n"))).otherwise(F.lit(" "))
    block = F.when(k % 3 == 0, F.concat(F.lit("<tool_call>\n"), "p_brand", F.lit("\n</tool_call> rest"))).when(k % 3 == 1, F.concat(F.lit("<answer> "), "p_type", F.lit("</answer>"))).otherwise(F.lit(""))
    return _t(spark, d, "part").select("p_partkey", transcripts.planner_step(F.concat(prose, block)).alias("s")).select("p_partkey", "s.*")


@register(
    "invalid_requests",
    """SELECT p_partkey, ['', 'malformed_tool_call', 'wrong_tool_name', 'invalid_arguments', 'missing_command', 'non_string_command', 'empty_command', ''][p_partkey % 8 + 1] AS reason,
    [-1, 0, 1, 2, 3, 4, 5, -1][p_partkey % 8 + 1] AS index FROM part""",
)
def invalid_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    text = F.when(k == 1, F.concat(F.lit("<tool_call>{ "), "p_name")).otherwise(F.col("p_name"))
    name = F.when(k <= 1, F.lit(None).cast("string")).when(k == 2, F.col("p_brand")).otherwise("shell")
    command = F.concat(F.lit('{"command": "rg '), "p_size", F.lit('"}'))
    args = F.when(k == 3, "[1]").when(k == 4, '{"cmd": "x"}').when(k == 5, '{"command": 5}').when(k == 6, '{"command": "  "}').otherwise(command)
    return _t(spark, d, "part").select("p_partkey", transcripts.invalid_request(text, name, args).alias("i")).select("p_partkey", "i.reason", "i.index")


@register("tool_calls_parsed", "SELECT p_partkey, 'shell' AS name, p_brand AS command FROM part")
def tool_calls_parsed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 2
    text = F.when(k == 0, F.concat(F.lit('<tool_call>{"name": "shell", "arguments": {"command": "'), "p_brand", F.lit('"}}</tool_call><tool_call>{broken</tool_call>'))).otherwise(
        F.concat(F.lit("<tool_call>{'name': 'shell', 'arguments': {'command': '"), "p_brand", F.lit("'}}</tool_call>"))
    )
    calls = _t(spark, d, "part").select("p_partkey", F.explode(transcripts.tool_calls(text)).alias("c"))
    return calls.select("p_partkey", "c.name", F.get_json_object("c.arguments", "$.command").alias("command"))


@register("tool_call_rewards", "SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 0.0 WHEN 2 THEN -3.0 ELSE 1.5 END)::DOUBLE AS score FROM part")
def tool_call_rewards(spark: SparkSession, d: str) -> DataFrame:
    def call(q: Column) -> Column:
        return F.concat(F.lit('<tool_call>\n{"name": "find", "parameters": {"q": "'), q, F.lit('", "n": 3}}\n</tool_call>'))

    k = F.col("p_partkey") % 4
    gold = F.when(k == 1, F.col("p_name")).otherwise(call(F.col("p_brand")))
    made = F.when(k == 2, F.lit("<tool_call>{")).when(k == 3, call(F.lit("other"))).otherwise(call(F.col("p_brand")))
    return _t(spark, d, "part").select("p_partkey", transcripts.tool_call_reward(made, gold).alias("score"))


@register("passages_rendered", "SELECT item_id, 'Doc 1 (Title: T' || item_id || ')' || chr(10) || text || chr(10) || chr(10) || 'Doc 2 (Title: only)' || chr(10) || chr(10) || chr(10) AS text FROM benchmark WHERE text IS NOT NULL")
def passages_rendered(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark").where("text is not null")
    return b.select("item_id", transcripts.passages_text(F.array(F.concat(F.lit("T"), F.col("item_id").cast("string"), F.lit("\n"), "text"), F.lit("only"))).alias("text"))


@register("tool_payloads", """SELECT item_id, '{"command":"rg x","stdout":' || to_json(text) || ',"stderr":"","exit_code":0,"timed_out":false,"truncated":false,"information_lines":' || to_json(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) || '}' AS payload FROM benchmark WHERE text IS NOT NULL""")
def tool_payloads(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").where("text is not null").select("item_id", transcripts.tool_payload(F.lit("rg x"), "text", F.lit(0)).alias("payload"))


@register("chat_messages", "SELECT p_partkey, CASE WHEN p_size > 20 THEN '[\"system\",\"user\",\"assistant\",\"tool\",\"assistant\"]' END AS roles FROM part")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    steps = F.when(F.col("p_size") > 20, F.array(F.struct(F.lit("t").alias("think"), F.col("p_brand").alias("command"), F.col("p_type").alias("output"))))
    m = transcripts.chat_messages(F.lit("s"), F.col("p_name"), steps, F.col("p_type"))
    return _t(spark, d, "part").select("p_partkey", F.to_json(F.transform(m, lambda x: x["role"])).alias("roles"))


@register("rendered_turns", "SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || role || chr(10) || regexp_replace(coalesce(text, ''), '(^|\n)', '\\1    ', 'g'), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def rendered_turns(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("t"))
    return c.select("conv_id", transcripts.numbered_turns("t").alias("text"))


# --- records ---------------------------------------------------------------------------


@register(
    "run_endings",
    """SELECT o_custkey AS run_id, CASE WHEN count(*) >= 4 THEN CASE WHEN o_custkey % 3 = 0 THEN 'answer' WHEN o_custkey % 3 = 1 THEN 'parse_error' ELSE 'max_turns' END WHEN count(*) >= 2 AND o_custkey % 3 = 1 THEN 'parse_error'
      WHEN count(*) >= 3 AND o_custkey % 3 = 0 THEN 'answer' ELSE 'unfinished' END AS finish_reason FROM orders GROUP BY o_custkey""",
)
def run_endings(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("turn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    k = F.col("o_custkey") % 3
    good = F.lit('<tool_call>{"name": "shell", "arguments": {"command": "rg x"}}</tool_call>')
    text = F.when((k == 0) & (F.col("turn") == 2), F.lit("<answer>yes</answer>")).when(k == 1, F.lit("no block")).otherwise(good)
    turns = o.select(F.col("o_custkey").alias("run_id"), "turn", text.alias("text"), F.lit(False).alias("failed"))
    return replay.finish_reasons(turns, 4).select("run_id", "finish_reason")


@register("eligible_records", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE coalesce(quality = 1, toxic = 0) AND toxic = 0 AND text <> ''")
def eligible_records(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    messages = F.when(F.col("text") != "", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    return replay.eligible(r.select("doc_id", (F.col("toxic") == 0).alias("success"), (F.col("quality") == 1).alias("quality_pass"), messages.alias("messages"))).select("doc_id")


@register("loss_spans", "SELECT conv_id, CAST(sum(length(coalesce(text, '')) + 7) FILTER (role = 'assistant') AS BIGINT) AS loss_chars, CAST(sum(length(coalesce(text, '')) + length(role) + 11) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def loss_spans(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    s = c.select("conv_id", replay.loss_spans("m").alias("s"))
    own = F.aggregate("s.spans", F.lit(0), lambda a, x: a + x["length"])
    return s.select("conv_id", F.when(F.size("s.spans") > 0, own).cast("bigint").alias("loss_chars"), F.length("s.text").cast("bigint").alias("chars"))


@register("preference_rows", "SELECT p_name AS prompt, p_brand AS chosen, p_type AS rejected FROM part")
def preference_rows(spark: SparkSession, d: str) -> DataFrame:
    return replay.preferences(_t(spark, d, "part"), "p_name", "p_brand", "p_type")


@register("flat_columns", 'SELECT p_partkey AS "id", p_size AS "a/size", p_brand AS "a/b/brand" FROM part')
def flat_columns(spark: SparkSession, d: str) -> DataFrame:
    nested = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("b")).alias("a"))
    return replay.flat_columns(nested)


@register("rendered_prompts", "SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Hint: ' || p_size || '.' AS prompt FROM part")
def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", replay.rendered("Question: {q}\nHint: {h}.", q="p_name", h="p_size").alias("prompt"))


@register("prefixed_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'nq_' || doc_id WHEN doc_id % 3 = 1 THEN 'nq_' || doc_id ELSE 'nq_anon' END AS id FROM documents")
def prefixed_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.col("doc_id").cast("string")).when(k == 1, F.concat(F.lit("nq_"), F.col("doc_id").cast("string")))
    return _t(spark, d, "documents").select("doc_id", datasets.prefixed("nq", raw).alias("id"))


# --- files: written and read back ---------------------------------------------------------


@register("jsonl_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, docs = _scratch(spark, "jsonl"), _t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    sinks.write_jsonl(docs, path)
    return read_jsonl(spark, path, docs.schema, strict=True)


@register("append_resumed", "SELECT doc_id, lang FROM documents")
def append_resumed(spark: SparkSession, d: str) -> DataFrame:
    path, docs = _scratch(spark, "append"), _t(spark, d, "documents").select("doc_id", "lang")
    sinks.append_new(docs.where("doc_id % 3 = 0"), path, "doc_id")
    sinks.append_new(docs, path, "doc_id")
    return read_jsonl(spark, path, docs.schema)


@register("train_val_split", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "split")
    sinks.write_train_val(_t(spark, d, "documents").select("doc_id"), path, F.col("doc_id") % 10 == 0)
    return spark.read.parquet(path).select("doc_id", "split")


@register("shards_round_trip", f"WITH {_LINES} SELECT doc_id, pos, line FROM lines")
def shards_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "shards")
    sinks.build_shards(corpus_lines(_t(spark, d, "documents")), path, 5, d)
    return sinks.read_shards(spark, path).select("line_no.doc_id", "line_no.pos", "line")


@register("shard_manifest", f"WITH {_LINES} SELECT count(*) AS n_lines, 5 AS n_shards FROM lines")
def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "shards")
    facts = sinks.build_shards(corpus_lines(_t(spark, d, "documents")), path, 5, d)
    return spark.createDataFrame([(facts["n_lines"], facts["n_shards"])], "n_lines bigint, n_shards int")


@register("generations_dumped", "SELECT p_name AS input, p_brand AS output, p_type AS gts, p_retailprice AS score, p_size AS size, 7 AS step FROM part")
def generations_dumped(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "dump")
    r = _t(spark, d, "part").select(F.col("p_name").alias("input"), F.col("p_brand").alias("output"), F.col("p_type").alias("gts"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("size"))
    sinks.dump_generations(r, path, 7, ["size", "absent"])
    return spark.read.schema("input string, output string, gts string, score double, size int, step int").json(f"{path}/7")


@register("questions_read", "SELECT 'q_' || n_nationkey AS id, n_name AS question, n_comment AS gold FROM (SELECT n_nationkey, n_name, 'x' || n_regionkey AS n_comment FROM nation)")
def questions_read(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "nation").select(F.col("n_nationkey").alias("row_id"), F.concat(F.lit(" "), "n_name", F.lit("\n")).alias("query"), F.concat(F.lit("x"), F.col("n_regionkey").cast("string")).alias("answer"))
    return datasets.questions(r, "q").select("id", "question", F.array_join("golden_answers", "|").alias("gold"))


@register("benchmark_set", "SELECT 'nq_' || item_id AS id, left(text, 20) AS question FROM benchmark WHERE item_id % 4 <> 0")
def benchmark_set(spark: SparkSession, d: str) -> DataFrame:
    root = _scratch(spark, "sets")
    golds = F.when(F.col("item_id") % 4 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("x")))
    sinks.write_jsonl(_t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.left("text", F.lit(20)).alias("question"), golds.alias("golden_answers")), f"{root}/nq/test.jsonl")
    return datasets.benchmark(spark, root, "nq").select("id", "question")


@register("replay_pool_saved", "SELECT o_orderkey AS id, o_orderpriority AS task, o_totalprice > 300000 AS positive FROM orders")
def replay_pool_saved(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "pool")
    sinks.save_pool(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), (F.col("o_totalprice") > 300000).alias("positive")), path)
    return sinks.load_pool(spark, path).select("id", "task", F.col("positive").cast("boolean").alias("positive"))


@register("token_rewards", "SELECT o_orderkey, o_totalprice AS last, CAST(o_orderkey % 5 AS INT) AS n FROM orders WHERE o_orderkey % 5 > 0")
def token_rewards(spark: SparkSession, d: str) -> DataFrame:
    o = registry.token_rewards(_t(spark, d, "orders").withColumn("n", F.col("o_orderkey") % 5), "o_totalprice", "n").where("size(rewards) > 0")
    return o.select("o_orderkey", F.element_at("rewards", -1).alias("last"), F.size("rewards").alias("n"))


# --- sample queues ------------------------------------------------------------------------


@register(
    "queue_bounded",
    """WITH q AS (SELECT event_type AS queue, event_id AS "at", row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
    SELECT queue, "at", k <= 5 AS ok, CAST(least(k, 5) AS INT) AS size, k AS produced, greatest(k - 5, 0) AS dropped FROM q""",
)
def queue_bounded(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("at"), F.lit("put").alias("action"), F.col("props").alias("sample"))
    return samples.bounded_queue(a, 5).select("queue", "at", "ok", "size", "produced", "dropped")


@register(
    "queue_staleness",
    """WITH e AS (SELECT event_id AS "at", event_type = 'purchase' AS sync, event_type = 'click' AS start FROM events), r AS (SELECT *, count(*) FILTER (sync) OVER (ORDER BY "at") AS run FROM e),
    o AS (SELECT *, CASE WHEN run > 0 THEN 3 ELSE 0 END + count(*) FILTER (start) OVER (PARTITION BY run ORDER BY "at") AS outstanding FROM r) SELECT "at", outstanding, outstanding >= 6 AS paused FROM o""",
)
def queue_staleness(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "sync").when(F.col("event_type") == "click", "start").otherwise("finish")
    e = _t(spark, d, "events").select(F.col("event_id").alias("at"), kind.alias("kind"), F.lit(1).alias("active"), F.lit(2).alias("queued"))
    return samples.staleness(e, 4, 0.5, 1).select("at", F.col("outstanding").cast("bigint").alias("outstanding"), "paused")


@register(
    "batches_assembled",
    """WITH s AS (SELECT o_orderkey // 16 AS batch, o_custkey % 3 AS span, o_totalprice * 0.731372918461 AS sec FROM orders)
    SELECT batch, count(*) AS n, count(*) FILTER (span > 0) AS partial, max(span) AS widest, round(avg(sec), 1) AS mean_seconds, round(quantile_cont(sec, 0.5), 1) AS tp50 FROM s GROUP BY 1 HAVING count(*) = 16""",
)
def batches_assembled(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.lit(0).cast("bigint").alias("start_version"), (F.col("o_custkey") % 3).alias("end_version"), (F.col("o_totalprice") * 0.731372918461).alias("seconds"))
    return _rounded(samples.assembled(s, 16).select("batch", "n", "partial", "widest", "mean_seconds", "tp50"), 1)


@register(
    "calls_admitted",
    """WITH RECURSIVE c AS (SELECT event_type AS key, event_id AS call_id, epoch(ts) - 1704067200 AS arrives, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_id < 400),
    r AS (SELECT key, call_id, k, arrives AS starts, 1.0::DOUBLE AS tokens FROM c WHERE k = 1
      UNION ALL SELECT key, call_id, k, t + greatest(0, (1 - have) / 0.0005), greatest(have, 1) - 1
      FROM (SELECT c.key, c.call_id, c.k, greatest(c.arrives, r.starts) AS t, least(2.0, r.tokens + (greatest(c.arrives, r.starts) - r.starts) * 0.0005) AS have FROM r JOIN c ON c.key = r.key AND c.k = r.k + 1))
    SELECT key, call_id, round(starts, 2) AS starts FROM r""",
)
def calls_admitted(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    calls = _t(spark, d, "events").where("event_id < 400").select(F.col("event_type").alias("key"), F.col("event_id").alias("call_id"), at.alias("at"), F.lit(1.0).alias("cost"))
    return samples.admitted(calls, 0.0005, 2.0).select("key", "call_id", F.round("starts", 2).alias("starts"))
