"""Scorers of mathematical answers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions.answers import _c, bound
from spindle.functions.scorers import CLIP_CHARS, _last, _s

#: What the final-answer form replaces and removes, in this order.
SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    (r"\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
REMOVED_EXPRESSIONS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits",
    "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}",
    "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]
#: Data sources by scorer.
SOURCES = {
    "gsm8k": ["openai/gsm8k"],
    "math": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"],
    "final": ["math_dapo", "math", "math_dapo_reasoning"],
    "geometry": ["hiyouga/geometry3k"],
    "search": ["searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"],
}


def _without(x: Column, parts: list[str]) -> Column:
    for p in parts:
        x = F.replace(x, F.lit(p), F.lit(""))
    return x


def closing_brace(text: Column) -> Column:
    """Place (from 1) of the brace that closes the first one opened, or null."""
    marks = F.split(text, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        ends = a["end"].isNull() & (c == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), (a["at"] + 1).alias("at"), F.when(ends, a["at"] + 1).otherwise(a["end"]).alias("end"))

    return F.aggregate(marks, start, step, lambda a: a["end"])


def boxed_answer(text: Column | str) -> Column:
    """What the last \\boxed holds: up to its closing brace, or after "\\boxed " up to a dollar sign; null without one."""

    def braced(tail: Column) -> Column:
        inner = bound(closing_brace(tail), lambda end: F.when(end.isNotNull(), F.substring(tail, F.lit(2), end - 2)))
        return F.when(F.startswith(tail, F.lit("{")), inner)

    def found(t: Column) -> Column:
        spaced = F.substring_index(F.substring_index(t, "\\boxed ", -1), "$", 1)
        return F.when(t.contains("\\boxed "), spaced).when(t.contains("\\boxed"), bound(F.substring_index(t, "\\boxed", -1), braced))

    return bound(_s(text), found)


_WHOLE = "(0|-?[1-9][0-9]*)"


def _braced(x: Column) -> Column:
    """\\frac1b and \\frac12 with their braces (a single sign after \\frac leaves the text
    as it is), 0.5 and a/b as fractions; null if nothing follows a \\frac."""
    both = F.regexp_replace(F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    fixed = F.when(x.rlike(r"\\frac[^{](?=\\frac|$)"), x).otherwise(both)
    slashed = bound(fixed, lambda y: F.when(y == "0.5", F.lit("\\frac{1}{2}")).otherwise(F.regexp_replace(y, f"^{_WHOLE}/{_WHOLE}$", r"\\frac{$1}{$2}")))
    return F.when(~x.rlike(r"\\frac(?=\\frac|$)"), slashed)


def _rooted(x: Column) -> Column:
    """\\sqrt3 with its braces and no spaces; null if nothing follows a \\sqrt."""
    bare = F.replace(F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    return F.when(~x.rlike(r"\\sqrt(?=\\sqrt|$)"), bound(bare, _braced))


def _named(x: Column) -> Column:
    """Without a short name before the one "=", and with the zero before a leading point."""
    led = F.when(F.startswith(x, F.lit(".")), F.concat(F.lit("0"), x)).otherwise(x)

    def right(y: Column) -> Column:
        sides = F.split(y, "=")
        return F.when((F.size(sides) == 2) & (F.length(F.get(sides, F.lit(0))) <= 2), F.get(sides, F.lit(1))).otherwise(y)

    return F.when(x == "", F.lit("")).otherwise(bound(bound(led, right), _rooted))


def math_form(text: Column | str) -> Column:
    """The form in which answers are compared; null if the text cannot be brought into it."""
    x = _without(_c(text), ["\n", "\\!"])
    x = F.replace(x, F.lit("\\\\"), F.lit("\\"))
    x = F.regexp_replace(x, "[td]frac", "frac")
    x = _without(x, ["\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"])

    def unitless(y: Column) -> Column:
        z = _without(F.substring_index(y, "\\text{ ", 1), ["\\\\%", "\\%"])
        z = F.replace(F.replace(z, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
        return F.when(F.size(F.split(y, r"\\text\{ ")) <= 2, bound(z, _named))

    return bound(x, unitless)


def math_equal(a: Column | str, b: Column | str) -> Column:
    """Equal forms; texts without a form are compared as they are."""
    forms = F.struct(math_form(a).alias("x"), math_form(b).alias("y"))
    return bound(forms, lambda f: F.when(f["x"].isNull() | f["y"].isNull(), _c(a) == _c(b)).otherwise(f["x"] == f["y"]))


def math_score(text: Column | str, truth: Column | str) -> Column:
    """1 if the last boxed answer equals the truth, else 0."""
    return F.coalesce(math_equal(boxed_answer(text), truth), F.lit(False)).cast("double")


def final_form(text: Column | str) -> Column:
    """The form of a final answer: what follows the last "=", without units and TeX shells."""
    x = F.substring_index(_c(text), "=", -1)
    for before, after in SUBSTITUTIONS:
        x = F.replace(x, F.lit(before), F.lit(after))
    x = _without(x, REMOVED_EXPRESSIONS)
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for shell in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, rf"\\{shell}\{{(.*?)\}}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(x, "frac([^{])(.)", "frac{$1}{$2}")
    x = F.regexp_replace(x, "sqrt([^{])", "sqrt{$1}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    x = bound(x, lambda y: F.when(y.rlike("^,*[0-9][0-9,]*$"), F.replace(y, F.lit(","), F.lit(""))).otherwise(y))
    return F.trim(x, F.lit(" \t\n\r\x0b\x0c"))


def final_answer(text: Column | str) -> Column:
    """The form of what follows the last "Answer:" of the text's end."""
    end = F.right(_s(text), F.lit(CLIP_CHARS))
    return final_form(F.coalesce(_last(F.regexp_extract_all(end, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))), F.lit("[INVALID]")))


def final_score(text: Column | str, truth: Column | str, boxed: bool = False) -> Column:
    """1 or -1; ``boxed``: the boxed answer of the last 100 characters is compared as it is."""
    if boxed:
        hit = boxed_answer(F.right(_s(text), F.lit(100))) == _c(truth)
    else:
        hit = final_answer(text) == final_form(truth)
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(-1.0)


def geometry_score(text: Column | str, truth: Column | str, format_score: float = 0.1) -> Column:
    """The answer (by ``math_equal``, not by symbolic algebra) and the format "thoughts, then a box"."""
    right = F.coalesce(math_equal(boxed_answer(text), truth), F.lit(False)).cast("double")
    shape = _s(text).rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")
    return (1 - format_score) * right + format_score * shape


def score_by_source(source: Column | str, text: Column | str, truth: Column | str) -> Column:
    """The score of the source's own scorer; an unknown source raises."""
    from spindle.functions import scorers

    s = _c(source)
    return (
        F.when(s.isin(*SOURCES["gsm8k"]), scorers.number_score(text, truth))
        .when(s.isin(*SOURCES["math"]), math_score(text, truth))
        .when(s.isin(*SOURCES["final"]) | s.startswith("aime"), final_score(text, truth))
        .when(s.isin(*SOURCES["geometry"]), geometry_score(text, truth))
        .when(s.isin(*SOURCES["search"]), scorers.tagged_score(text, F.array(_c(truth))))
        .otherwise(F.raise_error(F.concat(F.lit("no scorer for the source "), F.coalesce(s, F.lit("null")))).cast("double"))
    )
