"""Read-only text pipelines (``rg … | sort | uniq | head``) compiled to DataFrames.

A pipeline is parsed to stages, validated, and compiled stage by stage over a
table (line_no, line).  ``line_no`` orders the lines: an integer, or the struct
(doc_id, pos) of ``corpus_lines``.  A stream carries its order as columns:
``line_no``, or after ``sort`` the hidden keys ``_k0``, ``_k1`` … that later
stages keep while they change ``line``.  Nothing runs until the result is asked
for, but for places in a sorted stream (``sort | sed -n 3p``), which are read
from a written copy.

Single-file shell semantics are the rule: a filter chain is one conjunction,
``head`` a top-n, ``wc`` an aggregate, ``uniq`` collapses neighbours only.  A
flag that a program here does not know is refused, never ignored.
"""

from __future__ import annotations

import fnmatch
import json
import re
import shlex
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindle.plans import patterns
from spindle.plans.awk import UnsupportedProgram, compile_awk
from spindle.sources.scratch import written

PROGRAMS = ("rg", "grep", "cat", "ls", "find", "head", "tail", "wc", "sort", "uniq", "cut", "tr", "sed", "awk")
#: Context lines around a hit, at most.
MOST_CONTEXT = 1000
MOST_CHARS = 2000
#: Documents (or runs of 65,536 line numbers) a block: one row a block meets in one task.
_BLOCK_BITS = 16
#: Lines a block when neighbours are compared, so that no window holds the whole corpus.
_PLACES = 1 << 20

#: Words and constructs that are refused wherever they stand (fixed values).
REFUSED = [
    (r"\bsed\b[^|]*\s-(?:[a-zA-Z]*i|-in-place)\b", "sed -i / --in-place"),
    (r"\b(?:awk|gawk)\b[^|]*\s-i\s+inplace\b", "awk -i inplace"),
    (r"\b(?:awk|gawk)\b[^|]*\s--in-place\b", "awk --in-place"),
    (r"\bfind\b[^|]*\s-delete\b", "find -delete"),
    (r"\bfind\b[^|]*\s-exec(?:dir)?\b", "find -exec / -execdir"),
    (r"\b(?:awk|gawk)\b[^|]*\bsystem\s*\(", "awk system() call"),
    (r"\b(?:awk|gawk)\b[^|]*\bprintf?\b[^|]*>\s*[\"']", "awk print > file"),
    (r"\b(?:awk|gawk)\b[^|]*\|\s*[\"']", "awk pipe-to-shell-command"),
    (r"\bsed\b[^|]*'\s*e\s+", "sed 'e' (execute shell) command"),
    (r"\b(?:rm|mv|cp|dd|chmod|chown|chgrp|truncate|install|tee|ln)\b", "destructive/write command"),
]

#: Long options by program: the short flag, or None for those without effect here.
_SEARCH_LONG = {
    "fixed-strings": "F", "ignore-case": "i", "word-regexp": "w", "line-regexp": "x", "invert-match": "v", "count": "c", "only-matching": "o",
    "max-count": "m", "regexp": "e", "case-sensitive": "s", "smart-case": "S", "line-number": "n", "no-line-number": "N", "after-context": "A",
    "before-context": "B", "context": "C", "files-with-matches": "l", "files-without-match": "L", "with-filename": "H", "no-filename": "h",
    "extended-regexp": "E", "basic-regexp": "G", "json": "J", "no-config": None, "mmap": None, "no-mmap": None, "line-buffered": None, "no-messages": None,
    "no-heading": None, "text": None, "color": None, "colour": None,
}
_LONG = {
    "rg": _SEARCH_LONG,
    "grep": _SEARCH_LONG,
    "head": {"lines": "n"},
    "tail": {"lines": "n"},
    "wc": {"lines": "l", "words": "w", "bytes": "c", "chars": "m", "max-line-length": "L"},
    "sort": {"reverse": "r", "numeric-sort": "n", "unique": "u", "ignore-case": "f", "key": "k", "field-separator": "t", "stable": "s", "ignore-leading-blanks": "b"},
    "uniq": {"count": "c", "repeated": "d", "unique": "u", "ignore-case": "i"},
    "cut": {"delimiter": "d", "fields": "f", "characters": "c", "bytes": "b", "only-delimited": "s"},
    "tr": {"delete": "d", "squeeze-repeats": "s", "complement": "c"},
    "sed": {"regexp-extended": "E", "quiet": "n", "silent": "n", "expression": "e"},
    "awk": {"field-separator": "F"},
    "cat": {"number": "n"},
    "ls": {},
    "find": {},
}
#: (flags with a value, flags without one) of each program.
_SHORT = {
    "rg": ("emABC", "FivwxcnosSNlLHhEGJIUa"),
    "grep": ("emABC", "FivwxcnosSNlLHhEGa"),
    "head": ("n", "q"),
    "tail": ("n", "q"),
    "wc": ("", "lwcmL"),
    "sort": ("kt", "rnufsb"),
    "uniq": ("", "cdui"),
    "cut": ("dfcb", "s"),
    "tr": ("", "dscC"),
    "sed": ("e", "nEr"),
    "awk": ("F", ""),
    "cat": ("", "nu"),
    "ls": ("", "1aR"),
}


class UnsupportedPipeline(ValueError):
    """The text is not a pipeline of this language."""


def parse(text: str) -> list[list[str]]:
    """Stages as argument lists.  Within double quotes ``$`` and a digit is an
    empty argument, as in a shell without arguments; other expansions are refused."""
    if "\n" in text:
        raise UnsupportedPipeline("newlines not allowed in command")
    if len(text) > MOST_CHARS:
        raise UnsupportedPipeline("command too long")
    for pattern, name in REFUSED:
        if re.search(pattern, text):
            raise UnsupportedPipeline(f"disallowed: {name}")
    bare = re.sub(r"'[^']*'|\"[^\"]*\"", "", text)
    for x in ("`", "$(", "&&", "||", ";", ">", "<"):
        if x in bare:
            raise UnsupportedPipeline(f"disallowed shell construct: {x!r}")
    out = []
    for part in text.split("|"):
        if not part.strip():
            raise UnsupportedPipeline("empty pipeline segment")
        try:
            argv = shlex.split(expanded(part))
        except ValueError as e:
            raise UnsupportedPipeline(f"could not parse segment: {e}") from e
        program = argv[0].rsplit("/", 1)[-1] if argv else ""
        if program not in PROGRAMS:
            raise UnsupportedPipeline(f"command {program!r} not in whitelist")
        out.append([program, *argv[1:]])
    return out


def expanded(part: str) -> str:
    """What a shell makes of ``$`` outside single quotes before it cuts words."""
    out, quote, i = "", "", 0
    while i < len(part):
        c = part[i]
        if c == "\\" and quote != "'" and i + 1 < len(part):
            out += part[i : i + 2]
            i += 2
            continue
        if c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        elif quote != "'" and c == "`":
            raise UnsupportedPipeline("disallowed shell construct: '`'")
        elif quote != "'" and c == "$" and i + 1 < len(part):
            if part[i + 1].isdigit():
                i += 2
                continue
            if part[i + 1].isalpha() or part[i + 1] in "_({@*#?!-":
                raise UnsupportedPipeline("variables are not expanded")
        out += c
        i += 1
    return out


@dataclass(frozen=True)
class Stream:
    rows: DataFrame
    #: (column, descending) of the stream's order.
    order: tuple[tuple[str, bool], ...] = (("line_no", False),)
    #: Equal lines are neighbours.
    grouped: bool = False
    #: Every line of every document is still there.
    raw: bool = False
    #: The last program was a search: no row is exit code 1.
    search: bool = False
    name: str = "corpus.jsonl"
    files: dict[str, DataFrame] = field(default_factory=dict)

    def by(self, backwards: bool = False) -> list[Column]:
        return [F.col(c).desc() if down != backwards else F.col(c).asc() for c, down in self.order]

    @property
    def keys(self) -> list[str]:
        return [c for c, _ in self.order]

    @property
    def sorted(self) -> bool:
        return self.order != (("line_no", False),)

    def kept(self, line: Column, **changes) -> Stream:
        """The same rows with another line."""
        return replace(self, rows=self.rows.withColumn("line", line), grouped=False, **changes)

    def single(self, line: Column) -> Stream:
        """One row: an aggregate."""
        return Stream(self.rows.agg(line.alias("line")).select(F.lit(0).cast("bigint").alias("line_no"), "line"), name=self.name, files=self.files)


def _flags(argv: list[str], program: str) -> tuple[dict[str, str | bool], list[str]]:
    """Flags, short (clustered or not) and long, and the other arguments."""
    values, switches = _SHORT[program]
    flags: dict[str, str | bool] = {}
    rest, i = [], 0

    def put(name: str, value: str | bool) -> None:
        flags[name] = f"{flags[name]}\n{value}" if name in "ek" and name in flags else value

    while i < len(argv):
        a = argv[i]
        if a == "--":
            rest += argv[i + 1 :]
            break
        if a.startswith("--"):
            name, has, value = a[2:].partition("=")
            if name not in _LONG[program]:
                raise UnsupportedPipeline(f"{program}: --{name}")
            short = _LONG[program][name]
            if short and short in values:
                if not has:
                    i += 1
                    if i >= len(argv):
                        raise UnsupportedPipeline(f"--{name} needs a value")
                    value = argv[i]
                put(short, value)
            elif short:
                put(short, True)
        elif a.startswith("-") and len(a) > 1:
            j = 1
            while j < len(a):
                if a[j] in values:
                    value = a[j + 1 :]
                    if not value:
                        i += 1
                        if i >= len(argv):
                            raise UnsupportedPipeline(f"-{a[j]} needs a value")
                        value = argv[i]
                    put(a[j], value)
                    break
                if a[j] not in switches:
                    raise UnsupportedPipeline(f"{program}: -{a[j]}")
                put(a[j], True)
                j += 1
        else:
            rest.append(a)
        i += 1
    return flags, rest


def _number(text: str | bool) -> int:
    if not isinstance(text, str) or not re.fullmatch(r"\d+", text):
        raise UnsupportedPipeline(f"not a number: {text}")
    return int(text)


def _java(p: str, program: str, flags: dict) -> str:
    try:
        return p if program == "rg" else patterns.posix(p, "E" in flags)
    except ValueError as e:
        raise UnsupportedPipeline(str(e)) from e


def _grep(s: Stream, argv: list[str], program: str) -> Stream:
    flags, rest = _flags(argv, program)
    if "e" in flags:
        found = str(flags["e"]).split("\n")
    else:
        if not rest:
            raise UnsupportedPipeline("no pattern")
        found, rest = rest[:1], rest[1:]
    s = _open(s, rest)
    # -s is "case-sensitive" for rg, "no messages" for grep
    fold = "i" in flags or (program == "rg" and "S" in flags and "s" not in flags and not any(c.isupper() for p in found for c in p))
    line = F.col("line")
    tests, bodies = [], []
    for p in found:
        literal = "F" in flags or not re.search(r"[\\.^$*+?()\[\]{}|]", p)
        body = patterns.plain(p) if literal else _java(p, program, flags)
        if "x" in flags:
            body = f"^(?:{body})$"
        elif "w" in flags:
            body = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"
        body = f"(?iu){body}" if fold else body
        bodies.append(f"(?:{body})")
        if literal and not {"w", "x"} & set(flags):
            tests.append(patterns.folded_contains(line, p) if fold else line.contains(p))
        elif literal and "x" in flags and not fold:
            tests.append(line == p)
        else:
            tests.append(line.rlike(body))
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    hit = ~hit if "v" in flags else hit
    if {"A", "B", "C"} & set(flags):
        if {"c", "o", "m", "l", "L", "J", "H"} & set(flags):
            raise UnsupportedPipeline("context lines go with neither -c, -o, -m, -l, -L, -H nor --json")
        after, before = (_number(flags.get(k, flags.get("C", "0"))) for k in "AB")
        return _context(s, hit, before, after, "n" in flags)
    counting = {"l", "L", "c"} & set(flags)
    numbers = "n" in flags and "N" not in flags and not counting
    if numbers or "J" in flags:
        s = replace(numbered(s), raw=False)
    rows = s.rows.where(hit)
    if "m" in flags:
        rows = rows.orderBy(*s.by()).limit(_number(flags["m"]))
    out = replace(s, rows=rows, raw=False, search=True)
    if {"l", "L"} & set(flags):
        any_ = F.count("*") > 0
        shown = rows.agg((any_ if "l" in flags else ~any_).alias("_any")).where("_any").select(F.lit(0).cast("bigint").alias("line_no"), F.lit(s.name).alias("line"))
        return Stream(shown, search=True, name=s.name, files=s.files)
    prefix = [F.lit(s.name)] if "H" in flags and "h" not in flags else []
    if "c" in flags:
        if "o" in flags and program == "rg":
            raise UnsupportedPipeline("rg -c -o counts matches")
        return replace(out.single(F.concat_ws(":", *prefix, F.count("*").cast("string"))), search=True)
    if "J" in flags:
        if program != "rg" or {"o", "v"} & set(flags):
            raise UnsupportedPipeline("--json: rg without -o and -v")
        return _json(out, "|".join(bodies))
    if "o" in flags:
        if "v" in flags:
            raise UnsupportedPipeline("-o with -v prints nothing")
        texts = F.filter(F.regexp_extract_all(line, F.lit("|".join(bodies)), F.lit(0)), lambda x: x != "")
        place = f"_at{len(out.order)}"
        rows = out.rows.select(*_others(out.rows), F.posexplode(texts).alias(place, "line"))
        out = replace(out, rows=rows, order=(*out.order, (place, False)))
    if numbers:
        prefix.append(F.col("nr").cast("string"))
    if prefix:
        out = replace(out.kept(F.concat_ws(":", *prefix, "line")), search=True)
    return replace(out, rows=out.rows.drop("nr"))


def _others(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != "line"]


def _json(s: Stream, body: str) -> Stream:
    """One message of the type "match" a line; the summary messages are left out."""
    text = F.concat("line", F.lit("\n"))
    pieces = F.regexp_extract_all("line", F.lit(f"(?s)(.*?)({body})"), F.lit(1))
    hits = F.regexp_extract_all("line", F.lit(f"(?s)(.*?)({body})"), F.lit(2))
    pairs = F.filter(F.arrays_zip(pieces.alias("gap"), hits.alias("hit")), lambda x: x["hit"] != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:struct<text:string>,start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.octet_length(x["gap"])
        end = begin + F.octet_length(x["hit"])
        one = F.struct(F.struct(x["hit"].alias("text")).alias("match"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    found = F.aggregate(pairs, start, step, lambda a: a["out"])
    data = F.struct(F.struct(F.lit(s.name).alias("text")).alias("path"), F.struct(text.alias("text")).alias("lines"), F.col("nr").alias("line_number"), found.alias("submatches"))
    return replace(s.kept(F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data")))), search=True)


def _open(s: Stream, names: list[str]) -> Stream:
    """The named tables, one after the other, where a catalogue of tables is given."""
    names = [n for n in names if n != "-"]
    if not names:
        return s
    if not s.files:
        return replace(s, name=names[0])
    if missing := [n for n in names if n not in s.files]:
        raise UnsupportedPipeline(f"{missing[0]}: no such file")
    if len(names) == 1:
        return replace(s, rows=s.files[names[0]].select("line_no", "line"), name=names[0], raw=True)
    parts = [s.files[n].select(F.lit(i).alias("_file"), "line_no", "line") for i, n in enumerate(names)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return replace(s, rows=rows, order=(("_file", False), ("line_no", False)), name=names[0])


def numbered(s: Stream) -> Stream:
    """The stream with ``nr``, the place of each line from 1.

    In the corpus' own order: counts per document, summed over blocks of 65,536
    documents, of which one row each meets in one task.  In another order: the
    sorted stream is written, and one count per written partition is collected.
    """
    rows = s.rows
    if s.sorted:
        ordered = rows.orderBy(*s.by()).withColumn("_place", F.monotonically_increasing_id())
        kept = written(ordered, "sorted")
        counts = kept.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
        before, total = [], 0
        for r in counts:
            before.append((r["_part"], total))
            total += r["n"]
        starts = kept.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
        out = kept.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(starts), "_part")
        nr = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        return replace(s, rows=out.withColumn("nr", nr).drop("_part", "_place", "_before"), order=(("nr", False),))
    if isinstance(rows.schema["line_no"].dataType, StructType):
        rows = rows.withColumn("_doc", F.coalesce("line_no.doc_id", F.lit(-(1 << 63)))).withColumn("_pos", F.col("line_no.pos"))
    else:
        rows = rows.withColumn("_doc", F.shiftright("line_no", _BLOCK_BITS)).withColumn("_pos", F.col("line_no"))
    docs = rows.groupBy("_doc").agg(F.count("*").alias("_n")).withColumn("_block", F.shiftright("_doc", _BLOCK_BITS))
    inner = docs.withColumn("_within", F.sum("_n").over(Window.partitionBy("_block").orderBy("_doc")) - F.col("_n"))
    blocks = docs.groupBy("_block").agg(F.sum("_n").alias("_all"))
    blocks = blocks.select("_block", (F.sum("_all").over(Window.orderBy("_block")) - F.col("_all")).alias("_outer"))
    starts = inner.join(blocks, "_block").select("_doc", (F.col("_within") + F.col("_outer")).alias("_before"))
    if s.raw and isinstance(s.rows.schema["line_no"].dataType, StructType):
        place = F.col("_pos") + 1
    else:
        place = F.row_number().over(Window.partitionBy("_doc").orderBy("_pos"))
    out = rows.withColumn("_k", place).join(starts, "_doc").withColumn("nr", (F.col("_k") + F.col("_before")).cast("bigint"))
    return replace(s, rows=out.drop("_doc", "_pos", "_k", "_before"))


def _context(s: Stream, hit: Column, before: int, after: int, with_numbers: bool) -> Stream:
    """Hits with their neighbours, ``--`` between runs that do not touch."""
    if max(before, after) > MOST_CONTEXT:
        raise UnsupportedPipeline(f"at most {MOST_CONTEXT} context lines")
    s = numbered(s)
    rows = s.rows.withColumn("_hit", hit)
    near = rows.where("_hit").select(F.explode(F.sequence(F.col("nr") - before, F.col("nr") + after)).alias("nr")).distinct()
    shown = rows.join(near, "nr")
    first = shown.agg(F.min("nr").alias("_first"))
    touched = near.select((F.col("nr") + 1).alias("nr"), F.lit(True).alias("_touched"))
    marked = shown.join(touched, "nr", "left").join(F.broadcast(first))
    line = F.concat(F.col("nr").cast("string"), F.when(F.col("_hit"), ":").otherwise("-"), "line") if with_numbers else F.col("line")
    opens = F.col("_touched").isNull() & (F.col("nr") > F.col("_first")) & F.lit(before + after > 0)
    out = marked.select("line_no", "nr", F.posexplode(F.when(opens, F.array(F.lit("--"), line)).otherwise(F.array(line))).alias("_at", "line"))
    return replace(s, rows=out, order=(("nr", False), ("_at", False)), grouped=False, raw=False, search=True)


def _awk(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "awk")
    if not rest:
        raise UnsupportedPipeline("awk: a program, and -F at most")
    s = _open(s, rest[1:])
    try:
        p = compile_awk(rest[0], str(flags["F"]) if "F" in flags else None)
    except UnsupportedProgram as e:
        raise UnsupportedPipeline(str(e)) from e
    s = numbered(s) if p.numbered else s
    rows = s.rows if p.where is None else s.rows.where(p.where)
    if p.total:
        return replace(s, rows=rows).single(p.line)
    out = replace(s, rows=rows, raw=False).kept(p.line)
    return out if "nr" in out.keys else replace(out, rows=out.rows.drop("nr"))


def _head(s: Stream, argv: list[str]) -> Stream:
    n, argv = _count(argv, "head")
    if n.startswith(("-", "+")):
        raise UnsupportedPipeline("head: all but the last lines")
    s = _open(s, argv)
    return replace(s, rows=s.rows.orderBy(*s.by()).limit(_number(n)), raw=False)


def _count(argv: list[str], program: str) -> tuple[str, list[str]]:
    """The number of lines (with its sign) and the other arguments."""
    argv = ["-n" + a[1:] if re.fullmatch(r"-\d+", a) else a for a in argv]
    flags, rest = _flags(argv, program)
    return str(flags.get("n", "10")), rest


def _tail(s: Stream, argv: list[str]) -> Stream:
    n, argv = _count(argv, "tail")
    s = _open(s, argv)
    if n.startswith("+"):
        s = numbered(s)
        out = replace(s, rows=s.rows.where(F.col("nr") >= _number(n[1:])), raw=False)
        return out if "nr" in out.keys else replace(out, rows=out.rows.drop("nr"))
    return replace(s, rows=s.rows.orderBy(*s.by(backwards=True)).limit(_number(n.lstrip("-"))), raw=False)


def _wc(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "wc")
    s = _open(s, rest)
    words = F.size(F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    of = {
        "l": F.count("*"),
        "w": F.coalesce(F.sum(words), F.lit(0)),
        "m": F.coalesce(F.sum(F.length("line") + 1), F.lit(0)),
        "c": F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)),
        "L": F.coalesce(F.max(_width()), F.lit(0)),
    }
    return s.single(F.concat_ws(" ", *[of[k].cast("string") for k in "lwmcL" if k in flags or not flags and k in "lwc"]))


def _width() -> Column:
    """Columns of a line with tab stops every eight."""
    parts = F.split("line", "\t")
    stops = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(0), lambda a, x: (F.floor((a + F.length(x)) / 8) * 8 + 8).cast("int"))
    return stops + F.length(F.element_at(parts, -1))


def _sort_key(spec: str, flags: dict) -> tuple[Column, bool]:
    """A key and whether it falls; ``2``, ``2,3``, ``2n``, ``2,2nr``."""
    line = F.col("line")
    m = re.fullmatch(r"(\d+)([bfnr]*)(?:,(\d+)([bfnr]*))?", spec) if spec else None
    if spec and (not m or m[1] == "0"):
        raise UnsupportedPipeline(f"sort -k {spec}")
    own = set((m[2] or "") + (m[4] or "")) if m else set()
    opts = own or set(flags) & set("bfnr")
    key = line
    if m:
        first, last = int(m[1]), int(m[3]) if m[3] else 1 << 30
        if "t" in flags:
            sep = str(flags["t"]).replace("\\t", "\t")
            if len(sep) != 1:
                raise UnsupportedPipeline("sort -t: one character")
            key = F.array_join(F.slice(F.split(line, patterns.plain(sep)), first, max(0, min(last, 1 << 30) - first + 1)), sep)
        else:
            parts = F.regexp_extract_all(line, F.lit(r"[ \t]*[^ \t]+"), F.lit(0))
            key = F.array_join(F.slice(parts, first, max(0, last - first + 1)), "")
    if "b" in opts:
        key = F.regexp_replace(key, r"^[ \t]+", "")
    if "f" in opts:
        key = F.translate(key, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if "n" in opts:
        key = F.coalesce(F.regexp_extract(key, r"^[ \t]*(-?\d*(?:\.\d*)?)", 1).try_cast("double"), F.lit(0.0))
    return key, "r" in opts


def _sort(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "sort")
    s = _open(s, rest)
    specs = str(flags["k"]).split("\n") if "k" in flags else [""]
    found = [_sort_key(x, flags) for x in specs]
    base = sum(c.startswith("_k") for c in s.rows.columns)
    names = [f"_k{base + i}" for i in range(len(found))]
    order = [(n, down) for n, (_, down) in zip(names, found, strict=True)]
    if "u" in flags:
        if any(down for _, down in s.order):
            s = numbered(s)
        first = F.struct(*s.keys)
        rows = s.rows.withColumns(dict(zip(names, [k for k, _ in found], strict=True)))
        rows = rows.groupBy(*names).agg(F.min_by("line", first).alias("line"), F.min("line_no").alias("line_no"))
        return Stream(rows, tuple(order), True, name=s.name, files=s.files)
    rows = s.rows.withColumns(dict(zip(names, [k for k, _ in found], strict=True)))
    if "s" in flags:
        return replace(s, rows=rows, order=(*order, *s.order), grouped=False, raw=False, search=False)
    if names and not (specs == [""] and not set(flags) & set("bfn")):
        last = f"_k{base + len(names)}"
        rows = rows.withColumn(last, F.col("line"))
        order.append((last, "r" in flags))
    return replace(s, rows=rows, order=tuple(order), grouped=True, raw=False, search=False)


def _uniq(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "uniq")
    s = _open(s, rest)
    if s.grouped and "i" not in flags:
        groups = s.rows.groupBy("line", *s.keys).agg(F.count("*").alias("_n"))
        if "line_no" not in s.keys:
            groups = groups.withColumn("line_no", F.lit(0).cast("bigint"))
        out = replace(s, rows=groups, raw=False, search=False)
    else:
        out = _runs(s, F.lower("line") if "i" in flags else F.col("line"))
    rows = out.rows
    if "d" in flags:
        rows = rows.where("_n > 1")
    if "u" in flags:
        rows = rows.where("_n = 1")
    if "c" in flags:
        rows = rows.withColumn("line", F.concat_ws(" ", F.lpad(F.col("_n").cast("string"), 7, " "), "line"))
    return replace(out, rows=rows.drop("_n"), grouped=not {"c"} & set(flags) and out.grouped)


def _runs(s: Stream, key: Column) -> Stream:
    """Runs of neighbours with one key: the first line and ``_n``.  Neighbours
    are compared within blocks of places; a row a block tells the next its last key."""
    s = numbered(s)
    rows = s.rows.withColumn("_key", key).withColumn("_block", F.floor((F.col("nr") - 1) / _PLACES))
    last = rows.groupBy("_block").agg(F.max_by("_key", "nr").alias("_last"))
    edge = last.select((F.col("_block") + 1).alias("_block"), F.col("_last").alias("_edge"))
    w = Window.partitionBy("_block").orderBy("nr")
    marked = rows.join(edge, "_block", "left").withColumn("_prev", F.when(F.row_number().over(w) == 1, F.col("_edge")).otherwise(F.lag("_key").over(w)))
    marked = marked.withColumn("_new", F.when((F.col("nr") == 1) | ~F.col("_key").eqNullSafe(F.col("_prev")), 1).otherwise(0))
    starts = marked.groupBy("_block").agg(F.sum("_new").alias("_s"))
    offsets = starts.select("_block", (F.sum("_s").over(Window.orderBy("_block")) - F.col("_s")).alias("_o"))
    run = marked.withColumn("_in", F.sum("_new").over(w)).join(offsets, "_block").withColumn("_run", F.col("_in") + F.col("_o"))
    out = run.groupBy("_run").agg(F.min_by(F.struct("line_no", "line"), "nr").alias("_f"), F.count("*").alias("_n"))
    return replace(s, rows=out.select("_run", "_n", "_f.line_no", "_f.line"), order=(("_run", False),), grouped=False, raw=False, search=False)


def _ranges(text: str) -> list[tuple[int, int]]:
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"(\d*)(-?)(\d*)", part)
        if not m or not (m[1] or m[3]) or m[1] == "0" or m[3] == "0":
            raise UnsupportedPipeline(f"cut: {text}")
        low = int(m[1] or 1)
        out.append((low, int(m[3]) if m[3] else (1 << 30 if m[2] else low)))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(out):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _cut(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "cut")
    s = _open(s, rest)
    if sum(k in flags for k in "fcb") != 1:
        raise UnsupportedPipeline("cut: one of -f and -c")
    if "b" in flags:
        raise UnsupportedPipeline("cut -b")
    picked = _ranges(str(flags.get("f", flags.get("c", ""))))
    if "c" in flags:
        return s.kept(F.concat(*[F.substring("line", low, high - low + 1) for low, high in picked]), raw=False, search=False)
    delim = str(flags.get("d", "\t"))
    if len(delim) != 1:
        raise UnsupportedPipeline("cut -d: one character")
    parts = F.split("line", patterns.plain(delim))
    cut = F.array_join(F.concat(*[F.slice(parts, low, high - low + 1) for low, high in picked]), delim)
    whole = F.col("line").contains(delim)
    out = replace(s, rows=s.rows.where(whole)) if "s" in flags else s
    return out.kept(F.when(whole, cut).otherwise(F.col("line")), raw=False, search=False)


def _set(text: str) -> str:
    out, i = [], 0
    names = {"upper": "A-Z", "lower": "a-z", "digit": "0-9", "alpha": "A-Za-z", "alnum": "0-9A-Za-z", "space": "\t-\r ", "blank": "\t ", "punct": "!-/:-@[-`{-~"}
    text = re.sub(r"\[:(\w+):\]", lambda m: names.get(m[1], m[0]), text)
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            c = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b"}.get(text[i], text[i])
        elif i + 2 < len(text) and text[i + 1] == "-":
            if ord(c) > ord(text[i + 2]):
                raise UnsupportedPipeline(f"tr: range {text[i : i + 3]}")
            out += map(chr, range(ord(c), ord(text[i + 2]) + 1))
            i += 3
            continue
        out.append(c)
        i += 1
    return "".join(out)


def _tr(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "tr")
    sets = [_set(x) for x in rest]
    wanted = 1 if "d" in flags and "s" not in flags else 2
    if not sets or len(sets) > 2 or ("s" not in flags and len(sets) != wanted) or ("d" in flags and "s" in flags and len(sets) != 2):
        raise UnsupportedPipeline("tr: sets")
    other = bool({"c", "C"} & set(flags))
    # line feeds must stay: out of the sets, or in the set whose complement is meant
    if any("\n" in x for x in sets[other:]) or other and "\n" not in sets[0]:
        raise UnsupportedPipeline("tr: line feeds have to stay")

    def among(chars: str, other: bool) -> str:
        body = re.sub(r"([\\\]\[^&-])", r"\\\1", chars)
        return f"[{'^' if other else ''}{body}]" if chars else ("." if other else "(?!)")

    line = F.col("line")
    if "d" in flags:
        line = F.regexp_replace(line, among(sets[0], True), "") if other else F.translate(line, sets[0], "")
    elif len(sets) == 2:
        if not sets[1]:
            raise UnsupportedPipeline("tr: an empty second set")
        if other:
            last = sets[1][-1]
            line = F.regexp_replace(line, among(sets[0], True), "\\" + last if last in "\\$" else last)
        else:
            line = F.translate(line, sets[0], (sets[1] + sets[1][-1] * len(sets[0]))[: len(sets[0])])
    if "s" in flags:
        squeezed = among(sets[-1], other and len(sets) == 1)
        line = F.regexp_replace(line, f"({squeezed})\\1+", "$1")
    return s.kept(line, raw=False, search=False)


def _sed(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "sed")
    if "e" in flags:
        scripts = str(flags["e"]).split("\n")
    else:
        scripts, rest = rest[:1], rest[1:]
    s = replace(_open(s, rest), search=False)
    for script in scripts or [""]:
        s = _sed_one(s, script.strip(), flags)
    return s


def _sed_one(s: Stream, script: str, flags: dict) -> Stream:
    extended = bool({"E", "r"} & set(flags))

    def java(p: str) -> str:
        try:
            return patterns.posix(p, extended)
        except ValueError as e:
            raise UnsupportedPipeline(str(e)) from e

    if (m := re.fullmatch(r"s([^\w\s\\])((?:\\.|(?!\1).)*)\1((?:\\.|(?!\1).)*)\1([gIi]*)", script)) and "n" not in flags:
        body = java(m[2].replace("\\" + m[1], m[1]) if m[1] not in ".*[]^$+?(){}|" else m[2])
        body = ("(?iu)" if set(m[4]) & set("Ii") else "") + body
        text = ""
        for t in re.findall(r"\\.|[^\\]", m[3]):
            if t == "&":
                text += "$0"
            elif re.fullmatch(r"\\\d", t):
                text += "$" + t[1]
            else:
                c = {"\\n": "\n", "\\t": "\t"}.get(t, t[-1])
                text += "\\" + c if c in "\\$" else c
        if "g" in m[4]:
            return s.kept(F.regexp_replace("line", body, text), raw=False)
        # the first match: what stands before it, the replaced match, what is left
        if "$" in text.replace("\\$", "").replace("$0", "") or re.search(r"\(\?[=!<]|\\b|(?<!\\)[\^$]", body):
            if body.lstrip("(?iu)").startswith("^") or body.endswith("$"):
                return s.kept(F.regexp_replace("line", body, text), raw=False)  # at most one match
            raise UnsupportedPipeline("sed: groups need the g flag")
        body = body.removeprefix("(?iu)")
        fold = "(?iu)" if set(m[4]) & set("Ii") else ""
        return s.kept(F.regexp_replace("line", f"{fold}^(.*?)(?<whole>{body})", "$1" + text.replace("$0", "${whole}")), raw=False)
    if (m := re.fullmatch(r"(\d+)(?:,(\d+|\$))?([pd])", script)) and (("n" in flags) == (m[3] == "p")):
        s = numbered(s)
        low = _number(m[1])
        inside = F.col("nr") >= low if m[2] == "$" else F.col("nr").between(low, max(low, int(m[2] or m[1])))
        out = replace(s, rows=s.rows.where(inside if m[3] == "p" else ~inside), raw=False)
        return out if "nr" in out.keys else replace(out, rows=out.rows.drop("nr"))
    if (m := re.fullmatch(r"/((?:\\.|[^/\\])*)/(I?)([pd])", script)) and (("n" in flags) == (m[3] == "p")):
        hit = F.col("line").rlike(("(?iu)" if m[2] else "") + java(m[1].replace("\\/", "/")))
        return replace(s, rows=s.rows.where(hit if m[3] == "p" else ~hit), raw=False)
    if (m := re.fullmatch(r"(\d+)q", script)) and "n" not in flags:
        return replace(s, rows=s.rows.orderBy(*s.by()).limit(_number(m[1])), raw=False)
    if script == "$p" and "n" in flags:
        return replace(s, rows=s.rows.orderBy(*s.by(backwards=True)).limit(1), raw=False)
    raise UnsupportedPipeline(f"sed: {script}")


def _cat(s: Stream, argv: list[str]) -> Stream:
    flags, rest = _flags(argv, "cat")
    s = _open(s, rest)
    if "n" in flags:
        s = numbered(s)
        out = s.kept(F.concat(F.lpad(F.col("nr").cast("string"), 6, " "), F.lit("\t"), "line"), raw=False)
        return out if "nr" in out.keys else replace(out, rows=out.rows.drop("nr"))
    return replace(s, search=False)


def _names(s: Stream, names: list[str]) -> Stream:
    rows = s.rows.sparkSession.createDataFrame(list(enumerate(names)), "line_no bigint, line string")
    return Stream(rows, name=s.name, files=s.files)


def _ls(s: Stream, argv: list[str]) -> Stream:
    _, rest = _flags(argv, "ls")
    there = sorted(s.files or {s.name: None})
    rest = [r for r in rest if r not in (".", "./")]
    if missing := [r for r in rest if r not in there]:
        raise UnsupportedPipeline(f"{missing[0]}: no such file")
    return _names(s, sorted(rest) or there)


def _find(s: Stream, argv: list[str]) -> Stream:
    """``find [.] [-type f] [-name|-iname pattern] [-maxdepth n]`` over the catalogue's names."""
    there = [f"./{n}" for n in sorted(s.files or {s.name: None})]
    i, dirs = 0, [] if "-type" in argv else ["."]
    while i < len(argv):
        a = argv[i]
        if a in (".", "./"):
            i += 1
            continue
        if a not in ("-type", "-name", "-iname", "-maxdepth") or i + 1 >= len(argv):
            raise UnsupportedPipeline(f"find: {a}")
        value = argv[i + 1]
        if a == "-type":
            if value not in "fd":
                raise UnsupportedPipeline(f"find -type {value}")
            there, dirs = (there, []) if value == "f" else ([], ["."])
        elif a == "-maxdepth":
            there = there if _number(value) else []
        else:
            low = str.lower if a == "-iname" else str
            there = [n for n in there if fnmatch.fnmatchcase(low(n[2:]), low(value))]
            dirs = [n for n in dirs if fnmatch.fnmatchcase(n, value)]
        i += 2
    return _names(s, dirs + there)


_RUN = {"head": _head, "tail": _tail, "wc": _wc, "sort": _sort, "uniq": _uniq, "cut": _cut, "tr": _tr, "sed": _sed, "awk": _awk, "cat": _cat, "ls": _ls, "find": _find}


def compile_pipeline(text: str, lines: DataFrame, files: dict[str, DataFrame] | None = None) -> Stream:
    """The stream of a pipeline over ``lines`` (line_no, line), or over the
    tables that its first program names if ``files`` is given."""
    s = Stream(lines.select("line_no", "line"), raw=True, files=files or {})
    for program, *argv in parse(text):
        if program in ("rg", "grep"):
            s = _grep(s, argv, program)
        else:
            s = replace(_RUN[program](s, argv), search=False)
        s = replace(s, files={})  # later stages read the stream
    return s


def run_pipeline(text: str, lines: DataFrame, files: dict[str, DataFrame] | None = None) -> DataFrame:
    """The lines of a pipeline's output, in its order."""
    s = compile_pipeline(text, lines, files)
    return s.rows.orderBy(*s.by()).select("line")


@dataclass(frozen=True)
class Result:
    """What a caller of one pipeline gets."""

    command: str
    stdout: str
    stderr: str
    exit_code: int
    timed_out: bool
    truncated: bool
    information_lines: list[str]

    def to_payload(self) -> str:
        return json.dumps(self.__dict__, ensure_ascii=False)


def execute(text: str, lines: DataFrame, max_tokens: int = 4096, files: dict[str, DataFrame] | None = None) -> Result:
    """Run a pipeline and keep at most 3 characters a token of its output.

    exit_code: 0, 1 if the last program is a search without a hit, -2 if the
    text is refused.  Only as many lines as fit are brought to the driver.
    """
    try:
        s = compile_pipeline(text, lines, files)
    except UnsupportedPipeline as e:
        return Result(text, "", f"validation error: {e}", -2, False, False, [])
    cap = 3 * max_tokens
    # a line has a character at least, its line feed
    found = [r[0] for r in s.rows.orderBy(*s.by()).limit(cap + 1).select(F.left("line", F.lit(cap + 1))).collect()]
    none = not found or (s.search and found == ["0"])
    out = "".join(x + "\n" for x in found)
    truncated = len(out) > cap
    if truncated:
        out = f"{out[:cap]}\n[... output truncated at {max_tokens} tokens]"
    return Result(text, out, "", int(s.search and none), False, truncated, [x for x in out.split("\n") if x.strip()])
