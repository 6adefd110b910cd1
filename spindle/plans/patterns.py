"""Patterns of the line programs as Java regular expressions, and case folding."""

from __future__ import annotations

import re
import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLASSES = {"alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{Nd}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s\x0B", "blank": r" \t", "punct": r"\p{Punct}", "xdigit": "0-9A-Fa-f", "cntrl": r"\p{Cntrl}"}


def _bracket(p: str, i: int) -> tuple[str, int]:
    """A POSIX bracket expression that begins at ``i``, and the place after it."""
    j, out = i + 1, "["
    if p[j : j + 1] == "^":
        out, j = "[^", j + 1
    first = True
    while j < len(p) and (p[j] != "]" or first):
        first = False
        if m := re.match(r"\[:(\w+):\]", p[j:]):
            if m[1] not in _CLASSES:
                raise ValueError(f"no class [:{m[1]}:]")
            out += _CLASSES[m[1]]
            j += len(m[0])
        else:
            out += "\\" + p[j] if p[j] in "[]\\&^" else p[j]
            j += 1
    if j >= len(p):
        raise ValueError(f"[ without ]: {p}")
    return out + "]", j + 1


def posix(p: str, extended: bool) -> str:
    """A basic or extended POSIX expression (as in grep and sed) in Java's dialect."""
    out, i = "", 0
    swapped = "+?(){}|"
    while i < len(p):
        c = p[i]
        if c == "[":
            part, i = _bracket(p, i)
            out += part
            continue
        if c == "\\" and i + 1 < len(p):
            d = p[i + 1]
            i += 2
            if d in "<>":
                out += r"\b(?=\w)" if d == "<" else r"\b(?<=\w)"
            elif not extended and d in swapped:
                out += d
            elif d.isalnum():
                out += "\\" + d
            else:
                out += re.escape(d)
            continue
        begins = not out or out.endswith(("(", "|"))
        if not extended and (c in swapped or c == "*" and (begins or out == "^")):
            out += "\\" + c
        elif not extended and c == "^" and not begins:
            out += r"\^"
        elif not extended and c == "$" and i + 1 < len(p) and p[i + 1 : i + 3] not in (r"\)", r"\|"):
            out += r"\$"
        else:
            out += c
        i += 1
    return out


def plain(p: str) -> str:
    """A literal text as an expression."""
    return re.sub(r"([\\.^$*+?()\[\]{}|])", r"\\\1", p)


@cache
def _folded() -> dict[str, list[str]]:
    """Characters whose simple case folding is not their lower case, by that folding."""
    out: dict[str, list[str]] = {}
    for c, f in _full().items():
        if len(f) == 1:
            out.setdefault(f, []).append(c)
    return out


@cache
def _full() -> dict[str, str]:
    """Characters with a full folding other than their lower case."""
    return {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if c.casefold() != c.lower()}


def folded_contains(line: Column, pattern: str) -> Column:
    """The line contains the literal pattern under simple case folding."""
    own = "".join(c.casefold() if len(c.casefold()) == 1 else c.lower() for c in pattern)
    for c in sorted(set(own)):
        for other in _folded().get(c, []):
            line = F.replace(line, F.lit(other), F.lit(c))
    if "i" in own:
        line = F.replace(line, F.lit("\u0130"), F.lit("\0"))  # folds to itself, but its lower case begins with an i
    return F.lower(line).contains(own)


def casefold(text: Column) -> Column:
    """Full Unicode case folding.  Texts without a character that may need it take
    the short way; the others are folded letter by letter through a map of fixed size."""
    folds = F.create_map(*[F.lit(x) for c, f in _full().items() for x in (c, f)])
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(folds, c), c))
    # in Latin-1 only two characters have a folding of their own
    return F.when(text.rlike("[\u00b5\u00df\u0100-\U0010ffff]"), F.lower(F.array_join(each, ""))).otherwise(F.lower(text))
