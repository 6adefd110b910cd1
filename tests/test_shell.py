"""Pipelines against the same programs run on a text export."""

import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from spindle.operators import index
from spindle.plans.shell import UnsupportedPipeline, execute, parse, run_pipeline
from spindle.sources.tables import corpus_lines

LINES = ["The cat sat", "the dog 12", "the dog 12", "Émile the\tthird", "", "boilerplate", "a,b,c", "boilerplate", "cat the hat", "thethe 7", "boilerplate"] * 3


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string")


@pytest.fixture(scope="module")
def documents(spark):
    """The same lines as documents of several lines."""
    cuts = [0, 1, 5, 6, 20, len(LINES)]
    return spark.createDataFrame([(7 * i - 3, "\n".join(LINES[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "doc_id long, text string")


PIPES = [
    "grep -F the corpus",
    "grep -F -v the corpus",
    "grep -F -i THE corpus | grep -F dog | wc -l",
    "grep -w the corpus",
    "grep -x 'boilerplate' corpus",
    "grep -c -F the corpus",
    "grep -n -F cat corpus",
    "grep -m 2 -F the corpus",
    "grep -o '[0-9]' corpus",
    "cat corpus | head -n 4",
    "cat corpus | tail -n 3",
    "cat corpus | tail -n +30",
    "cat corpus | uniq",
    "cat corpus | sort | uniq",
    "cat corpus | sort | uniq -c | sort -r | head -n 3",
    "cat corpus | sort -u | head -n 2",
    "cat corpus | cut -d , -f 2",
    "grep -F the corpus | grep -v -F mile | cut -c 2-4",
    "cat corpus | tr a-z A-Z | head -n 2",
    "cat corpus | tr -d aeiou",
    "cat corpus | sed -n '2,5p'",
    "cat corpus | sed 's/the/X/g'",
    "cat corpus | sed -n '/dog/p'",
    "cat corpus | wc -l -c",
    "grep -F -A 1 dog corpus",
    "grep -F -B 2 -n dog corpus",
    "grep -F -C 1 a,b corpus | grep -v -F -e --",
    "grep -F -C 3 -n mile corpus",
    "grep -F -v -A 1 e corpus",
    "awk '/dog/' corpus",
    "awk 'NR == 3' corpus",
    "awk '{print $2}' corpus",
    "awk -F , '{print $2, $1}' corpus",
    "awk 'NF > 2 {print NR \":\" $1}' corpus",
    "awk '!/the/ {print length, $0}' corpus | head -n 4",
    "awk '/the/ {s += $3} END {print s}' corpus",
    "awk '/zzz/ {n++} END {print n+0}' corpus",
    "awk '/the/ {n++} END {print n}' corpus",
    "awk 'END {print NR}' corpus",
    "awk '$3 >= 12 {print $3}' corpus",
    "cat corpus | sort | uniq -c | head -n 2",
    "cat corpus | sort | cut -d ' ' -f 2 | head -n 4",
    "cat corpus | sort | sed s/b/z/ | head -n 3",
    "grep -v -F mile corpus | sort -r | cut -c 1-3 | head -n 5",
    "grep -v -F mile corpus | sort | cut -c 1-3 | uniq -c",
    "cat corpus | sort | tail -n 4",
    "cat corpus | sort | sed -n '3,5p'",
    "cat corpus | sort -r | grep -n -F the",
    "cat corpus | sort | awk 'NR > 30'",
    "cat corpus | sort -k 2",
    "cat corpus | sort -k 2,2 -k 1,1r",
    "cat corpus | sort -k 3n | tail -n 5",
    "cat corpus | sort -t , -k 2,2",
    "cat corpus | sort -s -k 2,2 | head -n 7",
    "cat corpus | sort -f | uniq -i -c",
    "cat corpus | sort -u -k 2,2",
    "cat corpus | sort -n -r --unique",
    "cat corpus | uniq -c",
    "cat corpus | uniq -d",
    "cat corpus | uniq -u | wc -l",
    "cat corpus | tr -cd 'a-z\\n'",
    "cat corpus | tr -s a-z b",
    "cat corpus | tr -s el",
    "cat corpus | tr -c 'a-z\\n' _ | head -n 3",
    "cat corpus | wc -L",
    "cat corpus | wc -w -l",
    "grep 'a+' corpus",
    "grep 'the\\+ ' corpus",
    "grep -E 'd.g|hat$' corpus".replace("|", "."),
    "grep -E '^(the)+ ?[0-9]' corpus",
    "grep '^[[:upper:]]' corpus",
    "grep '*a' corpus",
    "grep '\\(the\\)\\{2\\}' corpus",
    "grep '\\<cat' corpus",
    "grep -H -n -F dog corpus",
    "grep -l -F dog corpus",
    "grep -L -F zzzz corpus",
    "grep -c -H -F dog corpus",
    "grep --fixed-strings --ignore-case --max-count=2 DOG corpus",
    "grep -e cat -e dog corpus",
    "cat -n corpus | head -n 3",
    "cat corpus | head --lines=3",
    "grep -v -F mile corpus | cut -c 1,3-4",
    "cat corpus | cut -d ' ' -f 1,3-",
    "cat corpus | cut -s -d , -f 2-",
    "cat corpus | sed -E 's/(the) ([a-z]+)/\\2 \\1/g'",
    "cat corpus | sed 's/e/[&]/'",
    "cat corpus | sed 's/^the/X/'",
    "cat corpus | sed '2,4d' | head -n 3",
    "cat corpus | sed 3q",
    "cat corpus | sed -n '$p'",
    "cat corpus | sed -e 's/the/A/g' -e 's/A/B/g'",
    "cat corpus | sed 's/cat\\|dog/pet/g'".replace("\\|", "."),
    "ls",
    "find . -name 'corp*'",
]


@pytest.mark.parametrize("pipe", PIPES)
def test_like_the_programs(pipe, lines, tmp_path):
    if not shutil.which("grep"):
        pytest.skip("no programs")
    (tmp_path / "corpus").write_text("".join(x + "\n" for x in LINES))
    want = subprocess.run(["bash", "-c", pipe], cwd=tmp_path, env={"LC_ALL": "C" if "sort" in pipe else "C.UTF-8", "PATH": "/usr/bin:/bin"}, capture_output=True, text=True).stdout.split("\n")[:-1]
    got = [r.line for r in run_pipeline(pipe, lines, {"corpus": lines}).collect()]
    if " wc" in pipe:
        got, want = [x.split() for x in got], [x.split() for x in want]
    assert got == want


@pytest.mark.parametrize("pipe", ["rm x", "cat a > b", "grep 'a", "cat a; ls", "awk 'BEGIN {x}' c", "awk '{system(1)}' c", "grep -C 9999 x c", "grep --frob x", "x" * 3000, "sort -V c", "head -c 3 c", "tail -c 3 c", "uniq -w 3 c", "sort -k 1.2 c", "wc -x c", "tr -x a b", "tr -cd a-z", "tr a '\\n'", "grep 'a|b' c", 'rg "$HOME" c', "find . -delete", "cat c || ls", "rg -F install c", "cut -b 1 c"])
def test_refused(pipe, lines):
    with pytest.raises(UnsupportedPipeline):
        parse(pipe)
        run_pipeline(pipe, lines)


def test_index_finds_a_superset(lines):
    posted = index.postings(lines)
    for pattern in ("the", "he do", "cat", "mile", "zzz", "7"):
        hits = {r.line_no for r in lines.where(F.col("line").contains(pattern)).collect()}
        assert hits <= {r.line_no for r in index.candidates(posted, pattern).collect()}
        assert hits == {r.line_no for r in index.search(lines, posted, pattern).collect()}


def test_index_search_without_a_word(spark):
    rows = spark.createDataFrame([(0, "a !"), (1, "b"), (2, "more ! words")], "line_no long, line string")
    assert {r.line_no for r in index.search(rows, index.postings(rows), "!").collect()} == {0, 2}
    assert {r.line_no for r in index.search(rows, index.postings(rows), "a").collect()} == {0}


ORDERED = [p for p in PIPES if any(x in p for x in (" -n", "NR", "uniq", "tail -n +", "sed -n", "-A", "-B", "-C"))]


@pytest.mark.parametrize("pipe", ORDERED)
def test_documents_are_lines_in_order(pipe, lines, documents):
    got = [r.line for r in run_pipeline(pipe.replace("corpus", "corpus.jsonl"), corpus_lines(documents)).collect()]
    assert got == [r.line for r in run_pipeline(pipe.replace("corpus", "corpus.jsonl"), lines).collect()]


def test_long_documents_keep_their_numbers(spark):
    text = "\n".join(["x"] * 100_003 + ["hit"])
    docs = spark.createDataFrame([(0, text), (1, "first\nhit")], "doc_id long, text string")
    assert [r.line for r in run_pipeline("rg -n hit c", corpus_lines(docs)).collect()] == ["100004:hit", "100006:hit"]
    assert [r.line for r in run_pipeline("cat c | uniq", corpus_lines(docs)).collect()] == ["x", "hit", "first", "hit"]


def test_null_and_empty_documents(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (3, None), (4, ""), (-5, "c")], "doc_id long, text string")
    assert [r.line for r in run_pipeline("cat -n c", corpus_lines(docs)).collect()] == ["     1\ta", "     2\tb", "     3\tc", "     4\t"]
    assert run_pipeline("cat c | sort | uniq -c", corpus_lines(docs.limit(0))).collect() == []


@pytest.mark.parametrize(
    ("pattern", "line", "hit"),
    [("k", "\u212a", True), ("STRASSE", "stra\u017f\u017fe", True), ("ss", "\u00df", False), ("\u00e9", "\u00c9", True), ("i", "\u0130", False), ("\u03c3", "\u03c2", True)],
)
def test_simple_case_folding(spark, pattern, line, hit):
    rows = spark.createDataFrame([(0, line)], "line_no long, line string")
    assert bool(run_pipeline(f"rg -F -i {pattern} c", rows).count()) == hit


def test_execute(lines):
    done = execute("grep -F dog corpus | head -n 2", lines)
    assert (done.exit_code, done.stdout, done.truncated, done.information_lines) == (0, "the dog 12\nthe dog 12\n", False, ["the dog 12"] * 2)
    assert execute("grep -F zzzz corpus", lines).exit_code == 1
    assert execute("grep -c -F zzzz corpus", lines).exit_code == 1
    assert execute("grep -F zzzz corpus | wc -l", lines).exit_code == 0
    bad = execute("rm corpus", lines)
    assert bad.exit_code == -2 and bad.stderr.startswith("validation error: disallowed")
    cut = execute("cat corpus", lines, max_tokens=5)
    assert cut.truncated and cut.stdout == "The cat sat\nthe\n[... output truncated at 5 tokens]"
    assert '"exit_code": 0' in done.to_payload()


def test_json_lines(lines):
    rows = run_pipeline("rg --json 'the' corpus", lines).collect()
    first = json.loads(rows[0].line)
    assert first["type"] == "match" and first["data"]["line_number"] == 2
    last = next(d for d in map(json.loads, (r.line for r in rows)) if d["data"]["lines"]["text"] == "thethe 7\n")
    assert [(m["start"], m["end"]) for m in last["data"]["submatches"]] == [(0, 3), (3, 6)]


def test_shell_expansion(spark):
    rows = spark.createDataFrame([(0, "cost 00"), (1, "cost $500")], "line_no long, line string")
    assert [r.line for r in run_pipeline('rg -F "$500" c', rows).collect()] == ["cost 00", "cost $500"]
    assert [r.line for r in run_pipeline("rg -F '$500' c", rows).collect()] == ["cost $500"]


def test_several_files(spark, lines):
    more = spark.createDataFrame([(0, "the end")], "line_no long, line string")
    files = {"a": lines, "b": more}
    assert [r.line for r in run_pipeline("cat b a | head -n 2", lines, files).collect()] == ["the end", LINES[0]]
    assert [r.line for r in run_pipeline("ls", lines, files).collect()] == ["a", "b"]
    with pytest.raises(UnsupportedPipeline):
        run_pipeline("cat c", lines, files)
