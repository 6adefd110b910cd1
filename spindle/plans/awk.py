"""A subset of awk compiled to expressions.

``[pattern] [{ print … }]``, ``{ s += $k } END { print s }``, ``{ n++ } END {
print n }`` and ``END { print NR }``; patterns are ``/re/``, ``!/re/`` and
comparisons of ``$k``, ``NR``, ``NF`` or ``length`` with a number or string.
Everything else raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERM = r"(?:\$\d+|NR|NF|length(?:\(\$\d+\))?|\"(?:[^\"\\]|\\.)*\"|-?\d+(?:\.\d+)?)"


_LOOKS = r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"


class UnsupportedProgram(ValueError):
    """The text is not a program of this subset."""


@dataclass(frozen=True)
class Program:
    #: None: every line.
    where: Column | None
    #: The printed line, or with ``total`` the one row at the end.
    line: Column
    total: bool
    numbered: bool


def _fields(sep: str | None) -> Column:
    if sep is None:
        return F.filter(F.split("line", r"\s+"), lambda x: x != "")
    return F.split("line", re.escape(sep) if len(sep) == 1 else sep)


def _field(k: int, sep: str | None) -> Column:
    # an empty line has no field, also with a separator
    return F.col("line") if k == 0 else F.coalesce(F.get(_fields(sep), F.lit(k - 1)), F.lit(""))


def _number(x: Column) -> Column:
    """The leading number of a text, else 0."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def _text(term: str, sep: str | None) -> Column:
    if term.startswith("$"):
        return _field(int(term[1:]), sep)
    if term == "NR":
        return F.col("nr").cast("string")
    if term == "NF":
        return F.when(F.col("line") == "", 0).otherwise(F.size(_fields(sep))).cast("string")
    if term.startswith("length"):
        m = re.search(r"\d+", term)
        return F.length(_field(int(m[0]) if m else 0, sep)).cast("string")
    if term.startswith('"'):
        return F.lit(re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), term[1:-1]))
    return F.lit(term)


def _shown(x: Column) -> Column:
    """A number as awk prints it: whole ones in full, others with six digits."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(short)


def _compared(x: Column, op: str, y: Column) -> Column:
    return {"==": x == y, "!=": x != y, "<=": x <= y, ">=": x >= y, "<": x < y, ">": x > y}[op]


def _pattern(text: str, sep: str | None) -> Column:
    if m := re.fullmatch(r"(!?)/((?:[^/\\]|\\.)*)/", text):
        hit = F.col("line").rlike(m[2].replace("\\/", "/"))
        return ~hit if m[1] else hit
    if m := re.fullmatch(rf"({_TERM})\s*(==|!=|<=|>=|<|>|~|!~)\s*({_TERM}|/(?:[^/\\]|\\.)*/)", text):
        left, op, right = m[1], m[2], m[3]
        if "~" in op:
            hit = _text(left, sep).rlike(right.strip("/"))
            return ~hit if op == "!~" else hit
        x, y = _text(left, sep), _text(right, sep)
        as_text = _compared(x, op, y)
        if left.startswith('"') or right.startswith('"'):
            return as_text
        # fields that do not look like numbers compare as texts
        return F.when(x.rlike(_LOOKS) & y.rlike(_LOOKS), _compared(_number(x), op, _number(y))).otherwise(as_text)
    raise UnsupportedProgram(f"awk pattern: {text}")


def _printed(text: str, sep: str | None) -> Column:
    if not text:
        return F.col("line")
    rows = []
    for item in re.findall(rf"(?:{_TERM}|\s|[^,\s])+", text) if "," in text else [text]:
        terms = re.findall(_TERM, item)
        if re.sub(rf"{_TERM}|\s", "", item) or not terms:
            raise UnsupportedProgram(f"awk print: {text}")
        rows.append(F.concat(*[_text(t, sep) for t in terms]))
    return F.concat_ws(" ", *rows)


def compile_awk(script: str, sep: str | None = None) -> Program:
    body = script.strip()
    number = "NR" in re.sub(r'"(?:[^"\\]|\\.)*"|/(?:[^/\\]|\\.)*/', "", body)
    if re.fullmatch(r"END\s*\{\s*print\s+NR;?\s*\}", body):
        return Program(None, F.count("*").cast("string"), True, False)
    if m := re.fullmatch(r"(.*?)\{\s*(\w+)\s*(?:(\+\+)|\+=\s*(" + _TERM + r"));?\s*\}\s*END\s*\{\s*print\s+(\w+)(\s*\+\s*0)?;?\s*\}", body):
        if m[2] != m[5]:
            raise UnsupportedProgram("awk: another variable is printed")
        total = F.count("*").cast("double") if m[3] else F.sum(_number(_text(m[4], sep)))
        # a variable never set is printed as nothing, unless 0 is added
        none = F.lit("0" if m[6] else "")
        where = _pattern(m[1].strip(), sep) if m[1].strip() else None
        return Program(where, F.when(F.count("*") > 0, _shown(total)).otherwise(none), True, number)
    if m := re.fullmatch(r"(.*?)\{\s*print\s*(.*?);?\s*\}", body):
        where = _pattern(m[1].strip(), sep) if m[1].strip() else None
        return Program(where, _printed(m[2].strip(), sep), False, number)
    if "{" not in body and body:
        return Program(_pattern(body, sep), F.col("line"), False, number)
    raise UnsupportedProgram(f"awk: {script}")
