"""Answer scoring as Column expressions (built-in functions and lambdas only)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCT = string.punctuation


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without the white space at both ends, line feeds too."""
    return F.trim(_c(x), F.lit(" \t\n\r\x0b\x0c"))


def answer_tokens(text: Column | str, plain: bool = False) -> Column:
    """Lower case, no ASCII punctuation, no articles, split on white space.

    ``plain``: letter by letter (no final sigma, no letter becomes two), and split on ASCII white space without the vertical tab, as RE2 has it.
    """
    given = F.coalesce(_c(text), F.lit(""))
    bare = F.translate(F.lower(F.translate(given, "\u03a3\u0130", "\u03c3i") if plain else given), _PUNCT, "")
    return F.filter(F.split(bare, r"[\t\n\f\r ]+" if plain else r"(?U)\s+"), lambda t: (t != "") & ~t.isin("a", "an", "the"))


def normalize_answer(text: Column | str, plain: bool = False) -> Column:
    return F.array_join(answer_tokens(text, plain), " ")


def normalize_answer_by_word(text: Column | str) -> Column:
    """Articles are removed at word boundaries, not as tokens: they differ beside non-ASCII apostrophes."""
    bare = F.translate(F.lower(F.coalesce(_c(text), F.lit(""))), _PUNCT, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def exact_match(prediction: Column | str, golds: Column | str, guard_empty: bool = True, plain: bool = False) -> Column:
    """Any gold equals the prediction; an empty prediction matches nothing if guarded.  ``plain``: as in ``answer_tokens``."""
    hit = F.exists(_c(golds), lambda g: normalize_answer(g, plain) == normalize_answer(prediction, plain))
    return F.when(F.coalesce(_c(prediction), F.lit("")) == "", F.lit(False)).otherwise(hit) if guard_empty else hit


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(
        F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))
    )


def token_f1(prediction: Column | str, golds: Column | str) -> Column:
    """Best token F1 over the golds: both empty 1, one empty 0."""
    p = answer_tokens(prediction)

    def one(g: Column) -> Column:
        t = answer_tokens(g)
        both = overlap(p, t)
        empty = (F.size(p) == 0) | (F.size(t) == 0)
        return F.when(empty, (F.size(p) == F.size(t)).cast("double")).otherwise(F.lit(2.0) * both / (F.size(p) + F.size(t)))

    return F.coalesce(F.array_max(F.transform(_c(golds), one)), F.lit(0.0))


def contains_answer(prediction: Column | str, golds: Column | str, plain: bool = False) -> Column:
    return F.exists(_c(golds), lambda g: F.contains(normalize_answer(prediction, plain), normalize_answer(g, plain)))


def last_answer(text: Column | str) -> Column:
    """The last <answer> block, else the last line that is not blank."""
    blocks = F.regexp_extract_all(_c(text), F.lit(r"(?s)<answer>\s*(.*?)\s*</answer>"), F.lit(1))
    rest = F.regexp_replace(_c(text), r"(?s)<(tool_call|tool_response|think)>.*?</\1>", "")
    lines = F.filter(F.split(rest, "\n"), lambda x: strip(x) != "")
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), strip(F.try_element_at(lines, F.lit(-1))), F.lit(""))


def length_penalty(length: Column | str, most: float, strength: float, shape: str) -> Column:
    t = F.least(_c(length).cast("double"), F.lit(float(most))) / max(most, 1)
    shapes = {
        "linear": strength * t,
        "quadratic": strength * t * t,
        "exponential": strength * (F.exp(t) - 1) / (F.exp(F.lit(1.0)) - 1),
        "cosine": strength * (1 - F.cos(F.lit(3.141592653589793) * t)) / 2,
    }
    return shapes[shape]


def hash_share(key: Column | str) -> Column:
    """A stable number in [0, 1] from the key's SHA-1, for splits that never move."""
    return F.conv(F.substring(F.sha1(_c(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


#: Answers too general to be looked for in a text.
GENERIC_ANSWERS = (
    "yes", "no", "true", "false",
    "both", "all", "none", "neither", "either", "every", "any", "some",
    "many", "most", "few", "more", "less",
    "same", "different",
    "one", "two", "three", "four", "five",
    "first", "second", "third", "fourth",
    "left", "right", "top", "bottom", "middle",
)


def generic_answer(text: Column | str, words: tuple[str, ...] = GENERIC_ANSWERS) -> Column:
    bare = F.rtrim(F.lower(strip(F.coalesce(_c(text), F.lit("")))), F.lit(".!?,;:"))
    return (F.length(bare) < 3) | bare.isin(*words)


def boolean_answer(golds: Column | str) -> Column:
    """Any of the golds is yes, no, true or false."""
    return F.exists(_c(golds), lambda g: F.rtrim(F.lower(strip(g)), F.lit(".!?")).isin("yes", "no", "true", "false"))
