"""Scorers, parsers and transcript functions on stated texts and against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from spindle.functions import mathscore, transcripts
from spindle.operators import replay


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "inner"),
    [
        ("a \\boxed{1} b \\boxed{\\frac{1}{2}} c", "\\frac{1}{2}"),
        ("\\boxed{open", None),
        ("no box", None),
        ("$\\boxed 7$ rest", "7"),
        ("\\fbox{3}", None),
        ("\\boxed{}", ""),
        (None, None),
        ("", None),
    ],
)
def test_boxed(spark, text, inner):
    assert one(spark, mathscore.boxed_answer("t"), t=text) == inner


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("\\dfrac12", "\\frac{1}{2}", True),
        ("0.5", "\\frac{1}{2}", True),
        ("3/4", "\\frac{3}{4}", True),
        ("x = 5", "5", True),
        ("long = 5", "5", False),
        ("\\sqrt3", "\\sqrt{3}", True),
        ("10\\%", "10", True),
        ("5\\text{ cm}", "5", True),
        (".5", "0.5", True),
        ("90^\\circ", "90", True),
        ("\\frac1{72}", "\\frac{1}{72}", True),
        ("1 , 2", "1,2", True),
        ("\\left( 1 \\right)", "(1)", True),
        ("\\text{ a} \\text{ b}", "\\text{ a} \\text{ b}", True),
        ("\\sqrt", "\\sqrt", True),
        ("\\frac", "1", False),
        ("", "", True),
        ("01/2", "\\frac{01}{2}", False),
    ],
)
def test_math_equal(spark, a, b, same):
    assert one(spark, mathscore.math_equal("a", "b"), a=a, b=b) is same


@pytest.mark.parametrize(
    ("text", "truth", "score"),
    [
        ("Answer: 12", "12", 1.0),
        ("answer : $\\frac12$", "\\frac{1}{2}", 1.0),
        ("Answer: 1,000 dollars", "1000", 1.0),
        ("Answer: 3\nAnswer: 4", "3", -1.0),
        ("4", "4", -1.0),
        ("Answer: \\text{east}", "east", 1.0),
        ("Answer: x=2", "2", 1.0),
        (None, "2", -1.0),
    ],
)
def test_final(spark, text, truth, score):
    assert one(spark, mathscore.final_score("t", "g"), t=text, g=truth) == score


def test_other_math(spark):
    assert one(spark, mathscore.final_score("t", "g", boxed=True), t="so \\boxed{7}", g="7") == 1.0
    assert one(spark, mathscore.geometry_score("t", "g"), t="<think>x</think> \\boxed{7}", g="7") == pytest.approx(1.0)
    assert one(spark, mathscore.geometry_score("t", "g"), t="\\boxed{7}", g="7") == pytest.approx(0.9)
    with pytest.raises(Exception, match="no scorer"):
        one(spark, mathscore.score_by_source("s", F.lit("x"), F.lit("y")), s="unknown")


GATE = [
    ("<think>a</think><answer>b</answer>", True, "Valid sequence"),
    ("<think>a</think>\n<tool_call>c</tool_call>\nuser\n<tool_response>r</tool_response>\nassistant\n<think>a</think>\n<answer>b</answer>", True, "Valid sequence"),
    ("<reason>a</reason><answer>b</answer>", True, "Valid sequence"),
    ("<think>a<answer>b</answer>", False, "Tag mismatch for think"),
    ("<think>a</think>", False, "Incomplete: ended in after_reason"),
    ("hello <think>a</think><answer>b</answer>", False, "Unexpected text 'hello' outside tags at state start"),
    ("<think>a</think><think>b</think><answer>c</answer>", False, "Unexpected <think> at state after_reason"),
    ("<think>a</think><answer>b</answer>x", False, "Invalid trailing content after </answer>: 'x...'"),
    ("<think>a</think><answer>b</answer><answer>c</answer>", False, "Unexpected tag '<answer>' after sequence completion"),
    ("<think>漢字漢字a</think><answer>b</answer>", False, "Chinese density exceeded in in_reason"),
    ("<think>漢a</think><answer>b</answer>", True, "Valid sequence"),
    ("<answer>b</answer>", False, "Unexpected text 'b' outside tags at state start"),
    ("", False, "Incomplete: ended in start"),
    (None, False, "Incomplete: ended in start"),
]


@pytest.mark.parametrize(("text", "ok", "reason"), GATE)
def test_format_gate(spark, text, ok, reason):
    got = one(spark, transcripts.well_formed("t"), t=text)
    assert (got.ok, got.reason) == (ok, reason)


def test_small_parsers(spark):
    assert one(spark, transcripts.with_think("t"), t="x</think>") == "<think>\nx</think>"
    assert one(spark, transcripts.with_think("t"), t="  <reason>x") == "  <reason>x"
    step = one(spark, transcripts.planner_step("t"), t="<think>go</think> now <tool_call> rg x </tool_call><answer>y</answer>")
    assert (step.prose, step.tool_call, step.answer) == ("go now", "rg x", "y")
    for text, want in [("<tool_call> a </tool_call><tool_call>b</tool_call>", "b"), ("x <tool_call>{", "<tool_call>{"), ("{} </tool_call> y", "{} </tool_call>"), ("plain", "plain")]:
        assert one(spark, transcripts.attempted_call("t"), t=text) == want


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("[1, 2]", [1, 2]),
        ("so: [{'a': 'it''s'}] end".replace("it''s", "x"), [{"a": "x"}]),
        ("```json\n[1, // one\n 2,]\n```", [1, 2]),
        ("[{a: .5, b: 0x1F, c: +2}]", [{"a": 0.5, "b": 31, "c": 2.0}]),
        ("[]", None),
        ("{}", None),
        ("[1, 2", None),
        ("", None),
        (None, None),
        ("[" * 5000, None),
    ],
)
def test_lenient_json(spark, text, value):
    assert transcripts.recovered_json(text) == value
    got = one(spark, transcripts.lenient_json("t"), t=text)
    assert (None if got is None else json.loads(got)) == value


def test_tool_call_parsers():
    assert transcripts.tagged_calls('<tool_call>{"name": "a", "arguments": {"x": 1}}</tool_call><tool_call>bad</tool_call>') == [{"name": "a", "arguments": '{"x": 1}'}]
    assert transcripts.tagged_calls("<tool_call>__import__('os')</tool_call>") == []
    text = "<|start|>assistant<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>commentary to=functions.find <|constrain|>json<|message|>{\"q\": 1}<|call|>"
    assert transcripts.channel_calls(text) == [{"name": "find", "arguments": '{"q": 1}'}]
    xml = "<tool_call><function=f><parameter=n>\n3\n</parameter><parameter=s>x</parameter><parameter=o>{'a': [1]}</parameter><parameter=z>null</parameter><parameter=b>True"
    got = transcripts.xml_calls(xml, {"f": {"n": "integer", "o": "object", "b": "boolean", "z": "number"}})
    assert got[0]["name"] == "f" and json.loads(got[0]["arguments"]) == {"n": 3, "s": "x", "o": {"a": [1]}, "z": None, "b": True}
    assert transcripts.xml_calls(None) == [] and transcripts.tagged_calls(None) == []


def test_tool_call_reward(spark):
    gold = '<tool_call>\n{"name": "f", "parameters": {"a": 1, "b": 2}}\n{"name": "g", "parameters": {}}\n</tool_call>'
    near = '<tool_call>\n{"name": "f", "parameters": {"a": 1}}\n</tool_call>'
    # names 1/2, f: keys 1/2 and one value; the most is 1 + (1 + 2) + (1 + 0)
    assert one(spark, transcripts.tool_call_reward("r", "g"), r=near, g=gold) == pytest.approx(6 * 2.0 / 5 - 3)
    assert one(spark, transcripts.tool_call_reward("r", "g"), r=gold, g=gold) == 3.0
    assert one(spark, transcripts.tool_call_reward("r", "g"), r=None, g=gold) == -3.0
    assert one(spark, transcripts.tool_call_reward("r", "g"), r=near, g="said") == 0.0
    shaped = "<think>x</think>\n<tool_call>\n{}\n</tool_call>"
    assert one(spark, transcripts.call_format_reward("r", "g"), r=shaped, g=gold) == 1.0
    assert one(spark, transcripts.call_format_reward("r", "g"), r=shaped + "x", g=gold) == 0.0
    assert one(spark, transcripts.call_format_reward("r", "g"), r="<think>x", g=gold) == 0.0


def test_invalid_requests(spark):
    def reason(text, name, args):
        return tuple(one(spark, transcripts.invalid_request("t", "n", "a"), t=text, n=name, a=args))

    assert reason("plain", None, None) == ("", -1)
    assert reason("<tool_call>{", None, None) == ("malformed_tool_call", 0)
    assert reason("x", "python", "{}") == ("wrong_tool_name", 1)
    assert reason("x", "shell", "nope") == ("invalid_arguments", 2)
    assert reason("x", "shell", '{"command": null}') == ("non_string_command", 4)
    assert reason("x", "shell", '{"command": "rg"}') == ("", -1)


def test_media(spark):
    parts = one(spark, transcripts.media_parts("t", F.array(F.lit(1)), F.array().cast("array<int>")), t="see <image> here")
    assert [p.type for p in parts] == ["text", "image", "text"]
    with pytest.raises(Exception, match="do not agree"):
        one(spark, transcripts.media_parts("t", F.array(F.lit(1)), F.array().cast("array<int>")), t="none")


def test_runs_end(spark):
    good = '<tool_call>{"name": "shell", "arguments": {"command": "rg x"}}</tool_call>'
    runs = {
        "answered": [good, "<answer>yes</answer>", good],
        "twice bad": ["x", "y", good],
        "once bad": ["x", good, "z", "<answer>n</answer>"],
        "capped": [good] * 4,
        "open": [good],
    }
    rows = [(k, i, t, False) for k, v in runs.items() for i, t in enumerate(v)] + [("failed", 0, good, True)]
    out = replay.finish_reasons(spark.createDataFrame(rows, "run_id string, turn int, text string, failed boolean"), 4).collect()
    assert {r.run_id: r.finish_reason for r in out} == {"answered": "answer", "twice bad": "parse_error", "once bad": "answer", "capped": "max_turns", "open": "unfinished", "failed": "api_error"}
    assert {r.run_id: r.answer for r in out}["answered"] == "yes" and {r.run_id: r.parse_errors for r in out}["once bad"] == 2


def test_abort_reasons(spark):
    step = "array(named_struct('output', {}))"
    cases = [("null", step.format("'x'"), "'a'", "decomposition_failed"), ("array(1)", "null", "'a'", "no_steps"), ("array(1)", step.format("' '"), "'a'", "empty_tool_output"), ("array(1)", step.format("'x'"), "''", "no_answer"), ("array(1)", step.format("'x'"), "'a'", None)]
    for d, s, a, want in cases:
        row = spark.sql(f"select cast({d} as array<int>) d, cast({s} as array<struct<output:string>>) s, {a} a")
        assert row.select(replay.abort_reason("d", "s", "a").alias("v")).first().v == want
