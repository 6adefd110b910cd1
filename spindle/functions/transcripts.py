"""Transcripts and tool calls: format gate, parsers, payloads, messages.

Column expressions, but for the parsers that read nested JSON of any shape
(Arrow-batched functions over one text column).
"""

from __future__ import annotations

import ast
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions.answers import _c, strip
from spindle.functions.scorers import SHELL_TOOL, _last, _s, first_tag

#: Tags of a transcript, role words between them, reasons of invalid requests by index.
TAGS = ("reason", "think", "tool_call", "tool_response", "answer")
ROLES = ("user", "assistant")
INVALID = ("malformed_tool_call", "wrong_tool_name", "invalid_arguments", "missing_command", "non_string_command", "empty_command", "command_validation_error")
CJK = "[\u4e00-\u9fff]"

#: Moves of the format gate: tag -> (states it leads from, state it leads to).
_OPENS = {"<reason>": "in_reason", "<think>": "in_reason"}
_MOVES = {
    "</reason>": ("in_reason", "after_reason"),
    "</think>": ("in_reason", "after_reason"),
    "<tool_call>": ("after_reason", "in_tool_call"),
    "</tool_call>": ("in_tool_call", "after_tool_call"),
    "<tool_response>": ("after_tool_call", "in_tool_response"),
    "</tool_response>": ("in_tool_response", "after_tool_response"),
    "<answer>": ("after_reason", "in_answer"),
    "</answer>": ("in_answer", "end"),
}


def well_formed(text: Column | str) -> Column:
    """struct(ok, reason): tags come in pairs and in order, nothing but role
    words stands outside them, no block is mostly CJK, an answer ends it."""
    t = strip(_s(text))
    tag = f"</?(?:{'|'.join(TAGS)})>"
    uneven = F.lit(None).cast("string")
    for name in reversed(TAGS):
        uneven = F.when(F.regexp_count(t, F.lit(f"<{name}>")) != F.regexp_count(t, F.lit(f"</{name}>")), F.lit(f"Tag mismatch for {name}")).otherwise(uneven)
    parts = F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"(?s){tag}|(?:(?!{tag}).)+"), F.lit(0)), strip), lambda x: x != "")
    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("string").alias("bad"))

    def step(a: Column, x: Column) -> Column:
        state = a["state"]
        is_tag = x.rlike(f"^{tag}$")
        moved = state
        for name, (before, after) in _MOVES.items():
            moved = F.when((x == name) & (state == before), F.lit(after)).otherwise(moved)
        opens = x.isin(*_OPENS)
        ready = state.isin("start", "after_tool_response")
        moved = F.when(opens & ready, F.lit("in_reason")).otherwise(moved)
        inside = state.startswith("in_")
        content = F.regexp_replace(x, r"(?U)\s+", "")
        dense = F.regexp_count(content, F.lit(CJK)) > 0.5 * F.length(content)
        bad = (
            F.when(is_tag & (state == "end"), F.concat(F.lit("Unexpected tag '"), x, F.lit("' after sequence completion")))
            .when(opens & ~ready, F.concat(F.lit("Unexpected "), x, F.lit(" at state "), state))
            .when(is_tag, F.lit(None))
            .when(state == "end", F.concat(F.lit("Invalid trailing content after </answer>: '"), F.left(x, F.lit(20)), F.lit("...'")))
            .when(~inside & ~F.lower(x).isin(*ROLES), F.concat(F.lit("Unexpected text '"), F.left(x, F.lit(15)), F.lit("' outside tags at state "), state))
            .when(inside & dense, F.concat(F.lit("Chinese density exceeded in "), state))
        )
        return F.struct(F.when(is_tag, moved).otherwise(state).alias("state"), F.coalesce(a["bad"], bad).alias("bad"))

    done = F.aggregate(parts, start, step)
    end = F.when(done["state"] == "end", F.lit("Valid sequence")).otherwise(F.concat(F.lit("Incomplete: ended in "), done["state"]))
    reason = F.coalesce(uneven, done["bad"], end)
    return F.struct((reason == "Valid sequence").alias("ok"), reason.alias("reason"))


def with_think(text: Column | str) -> Column:
    """The text with its opening thought tag, which a prompt may have held."""
    t = _s(text)
    return F.when(t.rlike(r"^\s*<(?:think|reason)>"), t).otherwise(F.concat(F.lit("<think>\n"), t))


def planner_step(text: Column | str) -> Column:
    """struct(prose, tool_call, answer); what is not there or blank prose is null."""
    t = _s(text)
    at = F.regexp_instr(t, F.lit(r"(?s)<(?:tool_call>.*?</tool_call|answer>.*?</answer)>"))
    prose = strip(F.regexp_replace(F.when(at > 0, F.left(t, at - 1)).otherwise(t), "</?think>", ""))
    return F.struct(F.when(prose != "", prose).alias("prose"), first_tag(t, "tool_call").alias("tool_call"), first_tag(t, "answer").alias("answer"))


def attempted_call(text: Column | str) -> Column:
    """The last whole call, else from the last opening tag on, else up to the last closing tag, else the text."""
    t = _s(text)
    whole = _last(F.regexp_extract_all(t, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1)))
    opened = F.concat(F.lit("<tool_call"), F.substring_index(t, "<tool_call", -1))
    last = F.length(F.substring_index(t, "</tool_call>", -1))
    closed = F.left(t, F.length(t) - last)
    return F.coalesce(whole, F.when(t.contains("<tool_call"), opened).when(t.contains("</tool_call>"), closed).otherwise(t))


def invalid_request(text: Column | str, name: Column | str, arguments: Column | str) -> Column:
    """struct(reason, index): why the first call (its name and its arguments as
    JSON; null name: none was parsed) cannot be run; "" and -1 if it can or if nothing was tried."""
    t, n = _s(text), _c(name)
    parsed = F.try_parse_json(_c(arguments))
    kind = F.schema_of_variant(parsed)
    command = F.try_variant_get(parsed, "$.command", "variant")
    has = F.array_contains(F.json_object_keys(_c(arguments)), "command")
    reason = (
        F.when(n.isNull(), F.when(t.contains("<tool_call") | t.contains("</tool_call>"), INVALID[0]).otherwise(""))
        .when(n != SHELL_TOOL, INVALID[1])
        .when(parsed.isNull() | ~kind.startswith("OBJECT"), INVALID[2])
        .when(~F.coalesce(has, F.lit(False)), INVALID[3])
        .when(F.coalesce(F.schema_of_variant(command), F.lit("VOID")) != "STRING", INVALID[4])
        .when(strip(F.try_variant_get(parsed, "$.command", "string")) == "", INVALID[5])
        .otherwise("")
    )
    index = F.when(reason == "", -1).otherwise(F.array_position(F.array(*map(F.lit, INVALID)), reason) - 1).cast("int")
    return F.struct(reason.alias("reason"), index.alias("index"))


def _relaxed(text: str):
    """JSON, or JSON with comments, single quotes, bare keys and trailing commas; raises ValueError."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    token = r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[A-Za-z_$][\w$]*|[-+]?(?:0[xX][0-9a-fA-F]+|\d*\.?\d+(?:[eE][-+]?\d+)?\.?)|[\[\]{}:,]|\s+"
    out, at = [], 0
    for m in re.finditer(token, text, re.DOTALL):
        if m.start() != at:
            raise ValueError("not JSON")
        at, x = m.end(), m[0]
        if x.isspace() or x.startswith(("//", "/*")):
            continue
        if x[0] == "'":
            x = json.dumps(re.sub(r"\\(['\n])", lambda q: q[1].strip(), x[1:-1]))
        elif (x[0].isalpha() or x[0] in "_$") and x not in ("true", "false", "null"):
            x = json.dumps(x)
        elif x[0] in "+.0123456789-" and not re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", x):
            x = str(int(x, 16)) if "x" in x.lower() else repr(float(x))
        if x in "]}" and out and out[-1] == ",":
            out.pop()
        out.append(x)
    if at != len(text):
        raise ValueError("not JSON")
    return json.loads(" ".join(out))


def recovered_json(text: str | None, kind: type = list):
    """The first value of the kind in the whole text, its widest brackets or a fenced block; None without one."""
    if not text:
        return None
    tries = [text.strip()]
    brackets = r"\[.*\]" if kind is list else r"\{.*\}"
    for pattern, group in ((brackets, 0), (r"```(?:json5?|JSON)?\s*(.*?)```", 1)):
        if m := re.search(pattern, text, re.DOTALL):
            tries.append(m[group].strip())
    for x in tries:
        try:
            value = _relaxed(x)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, kind) and value:
            return value
    return None


def lenient_json(text: Column | str, kind: type = list) -> Column:
    """A JSON list (or object, by ``kind``) found in each text, as JSON; null without one."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        found = (recovered_json(t, kind) for t in texts)
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found], dtype=object)

    return find(_c(text))


def _literal(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return ast.literal_eval(text)


def tagged_calls(text: str | None) -> list[dict]:
    """Calls in <tool_call> blocks (JSON or Python literals); bad blocks are left out."""
    out = []
    for block in re.findall(r"<tool_call>(.*?)</tool_call>", text or "", re.DOTALL):
        try:
            call = _literal(block.strip())
            out.append({"name": str(call["name"]), "arguments": json.dumps(call["arguments"], ensure_ascii=False)})
        except (ValueError, SyntaxError, KeyError, TypeError, RecursionError, MemoryError):
            continue
    return out


def channel_calls(text: str | None) -> list[dict]:
    """Calls of texts with channels: reasoning segments go, then each call to a function."""
    rest = re.sub(r"(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "", text or "", flags=re.DOTALL)
    found = re.findall(r"<\|start\|>assistant<\|channel\|>commentary to=functions\.([^<\s]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>", rest, re.DOTALL)
    return [{"name": name, "arguments": arguments} for name, arguments in found]


def xml_calls(text: str | None, kinds: dict[str, dict[str, str]] | None = None) -> list[dict]:
    """Calls as <function=name><parameter=key>value; closing tags may lack.  Values
    are cast by the declared kind; unknown parameters and values that do not fit stay texts."""
    out = []
    blocks = re.findall(r"<tool_call>(.*?)(?:</tool_call>|$)", text or "", re.DOTALL) or [text or ""]
    for body in (b for block in blocks for b in re.findall(r"<function=(.*?)(?:</function>|(?=<function=)|$)", block, re.DOTALL)):
        name, closed, rest = body.partition(">")
        if not closed:
            continue
        args = {}
        for p in re.findall(r"<parameter=(.*?)(?:</parameter>|(?=<parameter=)|$)", rest, re.DOTALL):
            key, closed, value = p.partition(">")
            if closed:
                value = value.removeprefix("\n").removesuffix("\n")
                args[key] = _cast(value, (kinds or {}).get(name, {}).get(key, "string"))
        out.append({"name": name, "arguments": json.dumps(args, ensure_ascii=False)})
    return out


def _cast(value: str, kind: str):
    if value.lower() == "null":
        return None
    try:
        if kind.startswith(("int", "uint", "long", "short", "unsigned")):
            return int(value)
        if kind.startswith(("num", "float", "double")):
            x = float(value)
            return int(x) if x.is_integer() else x
        if kind in ("bool", "boolean"):
            return value.lower() == "true"
        if kind.startswith(("object", "dict", "list", "array")):
            return _literal(value)
    except (ValueError, SyntaxError, OverflowError, RecursionError, MemoryError):
        pass
    return value


#: Parsers of tool calls by format; more are added by ``register_parser``.
PARSERS = {"hermes": tagged_calls, "gpt-oss": channel_calls, "xml": xml_calls}
CALLS = "array<struct<name:string,arguments:string>>"


def register_parser(name: str, f) -> None:
    PARSERS[name] = f


def tool_calls(text: Column | str, parser: str = "hermes", **options) -> Column:
    """The calls of a text as array<struct(name, arguments as JSON)>."""
    if parser not in PARSERS:
        raise ValueError(f"unknown parser: {parser}")
    f = PARSERS[parser]

    @F.pandas_udf(CALLS)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t, **options))

    return parse(_c(text))


def _alike(a: list, b: list) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    both = (Counter(a) & Counter(b)).total()
    return both / (len(a) + len(b) - both)


def calls_value(wanted: list[dict], made: list[dict], low: float, high: float) -> float:
    """How well made calls fit the wanted ones, from ``low`` to ``high``: alike
    names, and for each wanted call its best unused namesake by alike parameter names and equal values."""
    if wanted == made:
        return high
    total, most, free = _alike([c["name"] for c in wanted], [c["name"] for c in made]), 1.0, dict(enumerate(made))
    for call in wanted:
        params = call["parameters"]
        most += 1 + len(params)
        worth = {
            i: _alike(list(params), list(c["parameters"])) + sum(k in c["parameters"] and c["parameters"][k] == v for k, v in params.items())
            for i, c in free.items()
            if c["name"] == call["name"]
        }
        best = max(worth, key=worth.get, default=None)
        if best is not None and worth[best] > 0:
            total += worth[best]
            del free[best]
    return (high - low) * total / most + low


def tool_call_reward(response: Column | str, gold: Column | str, low: float = -3.0, high: float = 3.0) -> Column:
    """Gold holds a call a line in its block: ``low`` if the response's block cannot be read, 0 if gold has none."""

    def block(text: str) -> list[dict]:
        body = text.split("<tool_call>")[1].split("</tool_call>")[0].strip()
        return [json.loads(x) for x in body.split("\n")]

    def one(r: str | None, g: str | None) -> float:
        if "<tool_call>" not in (g or ""):
            return 0.0
        wanted = block(g)
        try:
            if "</tool_call>" not in r:
                return low
            return float(calls_value(wanted, block(r), low, high))
        except (ValueError, IndexError, KeyError, TypeError, AttributeError):
            return low

    @F.pandas_udf("double")
    def score(rs: pd.Series, gs: pd.Series) -> pd.Series:
        return pd.Series([one(r, g) for r, g in zip(rs, gs, strict=True)], dtype="float64")

    return score(_c(response), _c(gold))


def call_format_reward(response: Column | str, gold: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Thoughts and then just the blocks that the gold has, each once."""
    r, g = _s(response), _s(gold)
    call, said = g.contains("<tool_call>"), g.contains("<response>")

    def once(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (F.regexp_count(r, F.lit(f"<{n}>")) == 1) & (F.regexp_count(r, F.lit(f"</{n}>")) == 1)
        return out

    think, c, s = "<think>.*?</think>", "\n<tool_call>\n.*?\n</tool_call>", "\n<response>.*?</response>"
    ok = (
        F.when(said & ~call, r.rlike(f"(?s)^{think}{s}$") & once("response"))
        .when(call & ~said, r.rlike(f"(?s)^{think}{c}$") & once("tool_call"))
        .when(call & said, r.rlike(f"(?s)^{think}{c}{s}$") & once("tool_call", "response"))
        .otherwise(r.rlike(f"(?s)^{think}$"))
    )
    return F.when(ok, high).otherwise(low)


def tool_payload(command: Column | str, output: Column | str, exit_code: Column | str) -> Column:
    """JSON of a tool's answer, keys in a fixed order; the sentinel text tells a cut output."""
    out = _s(output)
    lines = F.filter(F.split(out, "\n"), lambda x: strip(x) != "")
    return F.to_json(
        F.struct(
            _c(command).alias("command"), out.alias("stdout"), F.lit("").alias("stderr"), _c(exit_code).cast("int").alias("exit_code"),
            out.contains("[command timed out").alias("timed_out"), out.contains("[... output truncated at").alias("truncated"), lines.alias("information_lines"),
        )
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(system: Column | str, question: Column | str, steps: Column | str, answer: Column | str) -> Column:
    """system, user, (assistant, tool) a step (struct think, command, output), assistant; null without steps or answer."""
    call = lambda s: F.concat(F.lit("<think>"), s["think"], F.lit("</think>\n<tool_call>\n"), F.to_json(F.struct(F.lit(SHELL_TOOL).alias("name"), F.struct(s["command"].alias("command")).alias("arguments"))), F.lit("\n</tool_call>"))
    turns = F.flatten(F.transform(_c(steps), lambda s: F.array(_message("assistant", call(s)), _message("tool", s["output"]))))
    last = F.array(_message("assistant", F.concat(F.lit("<answer>"), _c(answer), F.lit("</answer>"))))
    out = F.concat(F.array(_message("system", _c(system)), _message("user", _c(question))), turns, last)
    return F.when((F.coalesce(F.size(_c(steps)), F.lit(0)) > 0) & (strip(_s(answer)) != ""), out)


def passages_text(passages: Column | str) -> Column:
    """``Doc i (Title: first line)`` and the other lines of each passage."""

    def one(p: Column, i: Column) -> Column:
        title = F.substring_index(p, "\n", 1)
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title, F.lit(")\n"), F.substring(p, F.length(title) + 2, F.length(p)), F.lit("\n\n"))

    return F.array_join(F.transform(_c(passages), one), "")


def numbered_turns(turns: Column | str) -> Column:
    """``[i] role`` and the indented text of each turn (struct role, content)."""
    one = lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t["role"], F.lit("\n"), F.regexp_replace(t["content"], "(?m)^", "    "))
    return F.array_join(F.transform(_c(turns), one), "\n")


def media_parts(text: Column | str, images: Column | str, videos: Column | str) -> Column:
    """Texts and places of media in order; the marks have to be as many as the media."""
    t = _s(text)
    fits = (F.regexp_count(t, F.lit("<image>")) == F.size(_c(images))) & (F.regexp_count(t, F.lit("<video>")) == F.size(_c(videos)))
    parts = F.filter(F.split(t, "(?<=<image>)|(?=<image>)|(?<=<video>)|(?=<video>)"), lambda x: x != "")
    typed = F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("value")))
    return F.when(fits, typed).otherwise(F.raise_error(F.lit("marks and media do not agree in number")).cast("array<struct<type:string,value:string>>"))
