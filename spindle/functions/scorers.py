"""Scorers and text parsers of answers, tool calls and tool outputs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions.answers import _c, contains_answer, exact_match, overlap, strip

#: Fixed values.
CLIP_CHARS = 300
STRICT_NUMBER = r"#### (-?[0-9.,]+)"
ANY_NUMBER = r"(-?[0-9.,]+)"
EMPTY_OUTPUTS = ("[empty output]", "[no stdout]", "[command timed out", "[ToolError")
SHELL_TOOL = "shell"


def _s(text: Column | str) -> Column:
    return F.coalesce(_c(text), F.lit(""))


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def last_number(text: Column | str, strict: bool = True) -> Column:
    """The number after the last marker (its commas removed), or the last number; null without one."""
    end = F.right(_s(text), F.lit(CLIP_CHARS))
    if strict:
        return F.replace(_last(F.regexp_extract_all(end, F.lit(STRICT_NUMBER), F.lit(1))), F.lit(","))
    found = F.regexp_extract_all(end, F.lit(ANY_NUMBER), F.lit(1))
    # only full stops found: the first of them, as nothing better comes
    return F.coalesce(_last(F.filter(found, lambda x: x != ".")), F.try_element_at(found, F.lit(1)))


def number_score(text: Column | str, truth: Column | str, strict: bool = True, format_score: float = 0.0, score: float = 1.0) -> Column:
    found = last_number(text, strict)
    return F.when(found.isNull(), 0.0).when(found == _c(truth), score).otherwise(format_score)


def _blocks(text: Column | str) -> Column:
    return F.regexp_extract_all(_s(text), F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))


def tagged_answer(text: Column | str) -> Column:
    """The last <answer> block, trimmed; null without one."""
    return strip(_last(_blocks(text)))


def _count(text: Column | str, tag: str) -> Column:
    return F.size(F.split(_s(text), tag)) - 1


def tagged_score(text: Column | str, golds: Column | str, substring: bool = False, format_score: float = 0.0, score: float = 1.0, plain: bool = False) -> Column:
    """Exact match of the last block; a quarter if the text has over ten opening or closing tags.  ``substring``: a gold within the block is enough.

    ``plain``: blocks are counted, not tags, and words are compared as ``answer_tokens`` has them then.
    """
    answer = _last(_blocks(text)) if plain else tagged_answer(text)
    if substring:
        hit, won = contains_answer(answer, golds, plain), F.lit(score)
    else:
        many = F.size(_blocks(text)) > 10 if plain else (_count(text, "<answer>") > 10) | (_count(text, "</answer>") > 10)
        hit, won = exact_match(answer, golds, guard_empty=False, plain=plain), F.when(many, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(hit, won).otherwise(format_score)


def first_tag(text: Column | str, name: str) -> Column:
    """The first block of a tag, trimmed; null without one."""
    found = F.regexp_extract_all(_s(text), F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1))
    return strip(F.get(found, F.lit(0)))


def assistant_turn(text: Column | str) -> Column:
    """struct(command, answer, error) of a turn: the first of a tool call and an answer counts."""
    t = _s(text)
    call_at, answer_at = (F.regexp_instr(t, F.lit(rf"(?s)<{n}>.*?</{n}>")) for n in ("tool_call", "answer"))
    call = first_tag(t, "tool_call")
    is_answer = (answer_at > 0) & ((call_at == 0) | (answer_at < call_at))
    parsed = F.try_parse_json(call)
    kind = F.schema_of_variant(parsed)
    name, args = F.try_variant_get(parsed, "$.name", "string"), F.try_variant_get(parsed, "$.arguments", "variant")
    args_kind = F.schema_of_variant(args)
    command = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.arguments.command", "variant")) == "STRING", strip(F.try_variant_get(parsed, "$.arguments.command", "string")))
    error = (
        F.when(t == "", "empty response")
        .when((call_at == 0) & (answer_at == 0), "no tool call or answer")
        .when(is_answer, F.lit(None))
        .when(parsed.isNull(), "tool call is not JSON")
        .when(~kind.startswith("OBJECT"), "tool call is not an object")
        .when(F.coalesce(name, F.lit("")) != SHELL_TOOL, "unknown tool")
        .when(args_kind.isNotNull() & ~args_kind.startswith("OBJECT") & (args_kind != "VOID"), "arguments are not an object")
        .when(F.coalesce(command, F.lit("")) == "", "no command")
    )
    return F.struct(F.when(error.isNull() & ~is_answer, command).alias("command"), F.when(is_answer, first_tag(t, "answer")).alias("answer"), error.alias("error"))


def empty_output(text: Column | str) -> Column:
    """Blank, or with one of the marks of a failed call."""
    bare = strip(_s(text))
    hit = bare == ""
    for mark in EMPTY_OUTPUTS:
        hit = hit | bare.contains(mark)
    return hit


def mentions(text: Column | str, forms: Column | str) -> Column:
    """An output that is not empty holds one of the forms, whatever the case."""
    return ~empty_output(text) & F.exists(_c(forms), lambda f: (strip(f) != "") & F.contains(F.lower(_s(text)), F.lower(f)))


def truncated(text: Column | str, most: int, side: str) -> Column:
    """At most ``most`` characters of the left or right end, or half of each, with a mark."""
    t, half = _s(text), most // 2
    cut = {
        "left": F.concat(F.left(t, F.lit(most)), F.lit("...(truncated)")),
        "right": F.concat(F.lit("(truncated)..."), F.right(t, F.lit(most))),
        "middle": F.concat(F.left(t, F.lit(half)), F.lit("...(truncated)..."), F.right(t, F.lit(half))),
    }[side]
    return F.when(F.length(t) > most, cut).otherwise(t)


def multiset_match(a: Column | str, b: Column | str) -> Column:
    """Shared elements, counted as often as in both, over all: equal lists 1, one of them empty 0."""
    x, y = _c(a), _c(b)
    both = overlap(x, y)
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(x == y, 1.0).when(empty, 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def overlong_penalty(length: Column | str, most: int, buffer: int, factor: float) -> Column:
    """What is taken off for each token within the last ``buffer`` of ``most`` and beyond."""
    over = _c(length) - (most - buffer)
    return F.least(-over / buffer * factor, F.lit(0.0))


def warm_up(step: Column | str, steps: int) -> Column:
    """Share of a penalty at a step: 1 if there is no warm-up or the step is unknown."""
    if steps <= 0:
        return F.lit(1.0)
    return F.when(_c(step).isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(step) / steps)))


def composed_reward(score: Column | str, penalty: Column | str, invalid: Column | str, well_formed: Column | str, mode: str = "additive", validation: Column | None = None) -> Column:
    """0 for an invalid request or bad format, else the score with its penalty; validation rows keep the score."""
    s, p = _c(score), F.coalesce(_c(penalty), F.lit(0.0))
    if validation is not None:
        p = F.when(validation, 0.0).otherwise(p)
    joined = {"additive": s - p, "additive_clamped": F.greatest(s - p, F.lit(0.0)), "multiplicative": s * (1 - p)}[mode]
    return F.when(_c(invalid) | ~_c(well_formed), 0.0).otherwise(joined)


def eos_mask(ids: Column | str, eos: int) -> Column:
    """1 up to and with the first end id, then 0."""
    at = F.array_position(_c(ids), F.lit(eos))
    return F.transform(_c(ids), lambda x, i: ((at == 0) | (i < at)).cast("int"))


def fit_length(ids: Column | str, length: int, pad: int, left_pad: bool = True, cut: str = "left") -> Column:
    """Exactly ``length`` ids: padded on one side; longer ones lose their left or right end or their middle, or raise (``error``)."""
    a = _c(ids)
    n, half = F.size(a), length // 2
    filler = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0)))
    short = {
        "left": F.slice(a, F.greatest(n - length, F.lit(0)) + 1, F.lit(length)),
        "right": F.slice(a, 1, length),
        "middle": F.when(n > length, F.concat(F.slice(a, 1, half), F.slice(a, n - (length - half) + 1, F.lit(length - half)))).otherwise(a),
        "error": F.when(n > length, F.raise_error(F.lit(f"more than {length} ids"))).otherwise(a),
    }[cut]
    return F.concat(filler, short) if left_pad else F.concat(short, filler)
