"""Quality rules: base statistics and a learned decision list.

Everything that touches documents is a Spark SQL expression over one row, so
no row is shuffled.  A decision list is learned on the driver from the
statistics of a bounded number of labelled documents by sequential covering:
rules for the class "bad" are grown condition by condition (information gain),
pruned on held-back rows, and kept while they stay precise; the list becomes
one nested conditional expression.

Defined results: a null text has no words, so it fails the base rules; empty
and blank texts likewise.  Rows repeated in the input are repeated in the
output.  A text is one row of arrays: its length is bounded by what Spark takes as a string (2 GB),
by nothing here.  Labels that are null, or whose document is missing, are not used; if
no usable label of each class exists, the list is empty and keeps everything
that the base rules keep.  Input columns are never needed by name except
``doc_id`` and ``text``; others are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \\u0009\\u000a\\u000b\\u000c\\u000d"
#: Low bits of a packed trigram that hold its place; longer texts take structs.
_PLACES = (1 << 24) - 1

MAX_FIT_ROWS = 20_000

FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
}


def base_stats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and the statistics of each document."""
    df = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_t"))
    df = df.withColumn("_b", F.expr(f"btrim(_t, '{_SPACE}')"))
    df = df.withColumn("_w", F.expr(r"if(_b = '', cast(array() as array<string>), split(_b, '[\\x09-\\x0D ]+'))"))
    df = df.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> btrim(x, '{_SPACE}') <> '')"))
    # array(...) binds its element once; a column named inside a lambda could be computed for every element
    df = df.withColumn(
        "_h",
        F.expr(
            "if(size(_w) < 4, cast(array() as array<bigint>), transform(array(_w), w ->"
            " transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))[0])"
        ),
    )
    # equal trigrams are neighbours in the order of (hash, place): packed into one integer as long as places fit, as structs beyond
    packed = f"""
        transform(
            array(struct(_h as h, sort_array(transform(_h, (x, i) -> (x & ~{_PLACES}L) | i)) as p)),
            s -> size(array_distinct(flatten(transform(
                filter(s.p, (x, k) ->
                    coalesce(s.h[int(x & {_PLACES}L)] = s.h[int(get(s.p, k + 1) & {_PLACES}L)], false)
                    or coalesce(s.h[int(x & {_PLACES}L)] = s.h[int(get(s.p, k - 1) & {_PLACES}L)], false)),
                x -> transform(array(int(x & {_PLACES}L)), i -> array(i, i + 1, i + 2))[0]))))
          )[0]
    """
    wide = """
        transform(
            array(sort_array(transform(_h, (x, i) -> struct(x as h, i as i)))),
            p -> size(array_distinct(flatten(transform(
                filter(p, (x, k) -> coalesce(x.h = get(p, k + 1).h, false) or coalesce(x.h = get(p, k - 1).h, false)),
                x -> array(x.i, x.i + 1, x.i + 2)))))
          )[0]
    """
    repeat = f"if(size(_h) < 2 or size(array_distinct(_h)) = size(_h), 0, if(size(_h) <= {_PLACES}, {packed}, {wide}))"
    return df.select(
        "doc_id",
        *keep,
        F.expr("bigint(size(_w))").alias("n_words"),
        F.expr(f"bigint(length(translate(_t, '{_SPACE}', '')))").alias("word_chars"),
        F.expr("bigint(length(_t) - length(translate(_t, '#*$%&|<>', '')))").alias("n_symbols"),
        F.expr("bigint(size(_l) - size(array_distinct(_l)))").alias("n_dup_lines"),
        F.expr(f"bigint({repeat})").alias("n_repeat_words"),
        F.expr("bigint(size(_l))").alias("n_lines"),
        F.expr("bigint(size(array_distinct(_w)))").alias("n_distinct_words"),
        F.expr("bigint(regexp_count(_t, '[A-Z]'))").alias("n_upper"),
        F.expr("bigint(length(_t) - length(translate(_t, '!?', '')))").alias("n_marks"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the document is bad.  A condition: (feature, '<=' or '>', threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.conditions)

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.conditions)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    if not p1 or not p0:
        return -1.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _best_condition(rows: list[tuple[dict, int]], names: list[str]):
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    best = (1e-9, None)
    for f in names:
        order = sorted(rows, key=lambda r: r[0][f])
        p = n = 0
        for i in range(len(order) - 1):
            p, n = p + order[i][1], n + 1 - order[i][1]
            a, b = order[i][0][f], order[i + 1][0][f]
            if a == b:
                continue
            cut = (a + b) / 2
            cut = cut if a <= cut < b else a
            for op, x, y in (("<=", p, n), (">", p0 - p, n0 - n)):
                if (g := _gain(p0, n0, x, y)) > best[0]:
                    best = (g, (f, op, cut))
    return best[1]


def learn(rows: list[tuple[dict, int]], max_rules: int = 16, max_conditions: int = 4, precision: float = 0.9) -> list[Rule]:
    """Sequential covering: ``rows`` are (features, 1 if bad).  Every third row is held back for pruning."""
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = rows[::3]
    names, rules = list(FEATURES), []
    while len(rules) < max_rules and any(y for _, y in grow):
        left, conditions = grow, []
        while len(conditions) < max_conditions and any(not y for _, y in left):
            if (c := _best_condition(left, names)) is None:
                break
            conditions.append(c)
            left = [r for r in left if Rule((c,)).holds(r[0])]
        if not conditions:
            break

        def worth(k: int) -> float:
            hit = [y for x, y in prune if Rule(tuple(conditions[:k])).holds(x)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        k = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(conditions[:k]))
        hit = [y for x, y in prune if rule.holds(x)] + [y for x, y in grow if rule.holds(x)]
        if not hit or sum(hit) < precision * len(hit) or sum(hit) < 3:
            break
        rules.append(rule)
        grow = [r for r in grow if not rule.holds(r[0])]
        prune = [r for r in prune if not rule.holds(r[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> list[Rule]:
    """Learn the list from at most ``max_fit_rows`` labelled documents (those
    with the smallest hashes of doc_id; a documented bound of the fit only)."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .select("doc_id", F.col("quality").cast("int").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_quality")
        .limit(max_fit_rows)
    )
    stats = base_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ("_quality",))
    names = ["n_words", "n_repeat_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct_words", "n_upper", "n_marks"]
    found = sorted(stats.select("doc_id", "_quality", *names).collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), tuple(r)))
    rows = []
    for r in found:
        if r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]:
            continue
        w, c = r["n_words"], max(r["word_chars"], 1)
        shares = (w, c / w, r["n_symbols"] / c, r["n_dup_lines"] / max(r["n_lines"], 1), r["n_repeat_words"] / w, r["n_distinct_words"] / w, r["n_upper"] / c, r["n_marks"] / c)
        rows.append((dict(zip(FEATURES, map(float, shares), strict=True)), 1 - r["_quality"]))
    return learn(rows)


def verdict(rules: list[Rule]) -> Column:
    """False if a base rule or a learned rule rejects the document: one ordered conditional."""
    out = F.when(base_failed(), F.lit(False))
    for r in rules:
        out = out.when(F.expr(r.sql()), F.lit(False))
    return out.otherwise(F.lit(True))


def kept_rows(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The verdict is a column that depends on no task but is not taken for
    deterministic, so that the optimizer leaves the filter above the statistics:
    pushed below, it would compute each statistic once for every rule."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("_document"))
    judged = base_stats(whole, ("_document",)).select("_document", (verdict(rules) & (F.spark_partition_id() >= 0)).alias("_kept"))
    return judged.where("_kept").select("_document.*")


def assess(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, base verdict and verdict of each document."""
    return base_stats(docs).select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))
