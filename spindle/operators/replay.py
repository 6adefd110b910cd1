"""Recorded agent runs replayed: how they ended, what training may use of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions import scorers


def finish_reasons(turns: DataFrame, most_turns: int) -> DataFrame:
    """(run_id, finish_reason, turns, parse_errors, answer) of recorded turns
    (run_id, turn, text, failed): the first of an answer, an API error, a second
    parse error in a row or the turn cap ends a run."""
    t = turns.where(F.col("turn") < most_turns).withColumn("_p", scorers.assistant_turn("text"))
    w = Window.partitionBy("run_id").orderBy("turn")
    bad = F.col("_p.error").isNotNull()
    t = t.withColumn("_bad", bad).withColumn("_before", F.coalesce(F.lag("_bad").over(w), F.lit(False)))
    ends = F.when(F.col("failed"), "api_error").when(F.col("_p.answer").isNotNull(), "answer").when(F.col("_bad") & F.col("_before"), "parse_error")
    t = t.withColumn("_end", ends)
    first = F.min(F.when(F.col("_end").isNotNull(), F.struct("turn", "_end", F.col("_p.answer").alias("answer"))))
    out = t.groupBy("run_id").agg(first.alias("_f"), F.count("*").alias("_n"), F.collect_list(F.when(F.col("_bad"), F.col("turn"))).alias("_errors"))
    last = F.coalesce(F.col("_f.turn"), F.lit(most_turns))
    reason = F.coalesce("_f._end", F.when(F.col("_n") >= most_turns, "max_turns").otherwise("unfinished"))
    return out.select("run_id", reason.alias("finish_reason"), F.least(F.col("_n"), last + 1).alias("turns"), F.size(F.filter("_errors", lambda x: x <= last)).alias("parse_errors"), F.col("_f.answer").alias("answer"))


def abort_reason(decomposition: Column | str, steps: Column | str, answer: Column | str) -> Column:
    """Why a generation record holds no usable trajectory; null if it does."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    d, s, a = c(decomposition), c(steps), c(answer)
    return (
        F.when(d.isNull() | (F.size(d) == 0), "decomposition_failed")
        .when(s.isNull() | (F.size(s) == 0), "no_steps")
        .when(F.exists(s, lambda x: scorers.empty_output(x["output"])), "empty_tool_output")
        .when(F.coalesce(a, F.lit("")) == "", "no_answer")
    )


def eligible(records: DataFrame) -> DataFrame:
    """Records for fine-tuning: success, quality passed (success if it was not judged) and messages."""
    return records.where(F.col("success") & F.coalesce("quality_pass", "success") & F.col("messages").isNotNull() & (F.size("messages") > 0))


def loss_spans(messages: Column | str, open_: str = "<|{}|>", close: str = "<|end|>") -> Column:
    """struct(text, spans of struct(start, length)) of formatted messages: the loss is on what assistants say and on the end after it."""
    m = F.col(messages) if isinstance(messages, str) else messages
    head, tail = open_.split("{}")
    parts = F.transform(m, lambda t: F.struct(F.concat(F.lit(head), t["role"], F.lit(tail)).alias("head"), F.concat(F.coalesce(t["content"], F.lit("")), F.lit(close)).alias("body"), (t["role"] == "assistant").alias("own")))
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, p: s + F.length(p["head"]) + F.length(p["body"]))
    spans = F.filter(F.transform(parts, lambda p, i: F.struct((before(i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"), p["own"].alias("own"))), lambda s: s["own"])
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"])), "")
    return F.struct(text.alias("text"), F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("spans"))


def preferences(rows: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """prompt, chosen and rejected; rows without one of them go."""
    return rows.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")).dropna()


def flat_columns(rows: DataFrame, separator: str = "/") -> DataFrame:
    """All nested fields as columns named by their path."""

    def walk(schema, path: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = [*path, f.name]
            if f.dataType.typeName() == "struct":
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return out

    return rows.select(*walk(rows.schema, []))


def rendered(template: str, **columns: str) -> Column:
    """A text with {name} replaced by columns; nulls are empty."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(F.col(columns[name]).cast("string"), F.lit("")))
    return F.concat(*parts)
