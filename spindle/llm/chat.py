"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role become one block, and blocks are concatenated:

    ### role: text<next/>text</turn>\\n

Control strings and backslashes inside roles and texts are written as
backslash escapes, so no control string is left in them and the texts can be
read back exactly.  ``loss_spans`` are the (start, length) code point ranges of
the assistant texts in ``formatted``.

Defined results: a null role or text is empty.  Turns sort by turn (null
first), then role, then text; repeated rows are turns of their own.  A null
conv_id is a conversation like any other.  A conversation is one row of output
and is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPES = [("###", "h"), ("</turn>", "t"), ("<next/>", "n"), (": ", "c")]


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escaped(column: str) -> str:
    """SQL for the escaped text."""
    out = f"replace({column}, {_quote(chr(92))}, {_quote(chr(92) * 2)})"
    for s, c in _ESCAPES:
        out = f"replace({out}, {_quote(s)}, {_quote(chr(92) + c)})"
    return out


def unescaped(column: str) -> str:
    """SQL for the text behind an escaped one: backslash pairs part it, what is between holds single escapes."""
    inner = "x"
    for s, c in _ESCAPES:
        inner = f"replace({inner}, {_quote(chr(92) + c)}, {_quote(s)})"
    return f"array_join(transform(split({column}, {_quote(chr(92) * 4)}), x -> {inner}), {_quote(chr(92))})"


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation."""
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_turns"))
    pieces = sorted_.select(
        "conv_id",
        F.expr(
            f"""transform(array(_turns), a -> transform(a, (t, i) -> struct(
                if(i > 0 and coalesce(get(a, i - 1).role = t.role, false), '<next/>',
                   concat(if(i > 0, '</turn>\\n', ''), '### ', {escaped("t.role")}, ': ')) as head,
                {escaped("t.text")} as body,
                t.role = 'assistant' as loss)))[0]"""
        ).alias("_pieces"),
    )
    return pieces.select(
        "conv_id",
        F.expr("concat(array_join(transform(_pieces, p -> concat(p.head, p.body)), ''), '</turn>\\n')").alias("formatted"),
        F.expr(
            """aggregate(_pieces,
                named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
                (s, p) -> named_struct(
                    'at', s.at + length(p.head) + length(p.body),
                    'spans', if(p.loss, concat(s.spans, array(named_struct('start', s.at + length(p.head), 'length', bigint(length(p.body))))), s.spans)),
                s -> s.spans)"""
        ).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and losses (texts under the loss mask), from the formatted text and its spans alone."""
    blocks = formatted.select(
        "conv_id",
        "formatted",
        F.expr("filter(split(formatted, '</turn>\\n'), b -> b <> '')").alias("_blocks"),
        F.expr(f"transform(loss_spans, s -> {unescaped('substring(formatted, int(s.start + 1), int(s.length))')})").alias("losses"),
    )
    return blocks.select(
        "conv_id",
        "formatted",
        F.expr(
            f"""flatten(transform(_blocks, b -> transform(
                split(substring(b, locate(': ', b) + 2), '<next/>'),
                x -> struct({unescaped("substring(b, 5, locate(': ', b) - 5)").replace("x ->", "y ->").replace("replace(x,", "replace(y,")} as role,
                            {unescaped("x").replace("x ->", "y ->").replace("replace(x,", "replace(y,")} as text))))"""
        ).alias("turns"),
        "losses",
    )
