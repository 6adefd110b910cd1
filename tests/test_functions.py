import itertools
import random

import pytest
from pyspark.sql import functions as F

from spindle.functions import answers, scorers
from spindle.operators import balance, groups, metrics, rows


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("o")).first().o


def test_answers(spark):
    assert one(spark, answers.normalize_answer("t"), t="The  Cat, a hat!") == "cat hat"
    assert one(spark, answers.exact_match("t", F.array(F.lit("the"))), t="") is False
    assert one(spark, answers.exact_match("t", F.array(F.lit("the")), guard_empty=False), t="") is True
    assert abs(one(spark, answers.token_f1("t", F.array(F.lit("x y z"))), t="x x y") - 2 / 3) < 1e-12
    assert one(spark, answers.last_answer("t"), t="<answer> a </answer> <answer>b\n</answer>") == "b"
    assert one(spark, answers.last_answer("t"), t="<think>x</think>\nlast\n\n") == "last"
    assert one(spark, answers.generic_answer("t"), t=" Yes!") is True


def test_gae(spark):
    row = [([0.0, 0.0, 1.0], [0.5, 0.4, 0.3], [1, 1, 1])]
    df = spark.createDataFrame(row, "rewards array<double>, values array<double>, mask array<int>")
    got = groups.gae(df, 0.9, 0.8).first().advantages
    want, last, after = [], 0.0, 0.0
    for r, v in zip(reversed(row[0][0]), reversed(row[0][1]), strict=True):
        last = r + 0.9 * after - v + 0.9 * 0.8 * last
        after = v
        want.append(last)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, reversed(want), strict=True))


def test_token_reductions(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.0, 0.0], [1.0, -1.0], [1, 0])], "new array<double>, old array<double>, adv array<double>, mask array<int>")
    row = df.select(metrics.masked_mean("new", "mask").alias("m"), metrics.ppo_clip_loss("old", "new", "adv").alias("l"), metrics.kl_k3("new", "old").alias("k")).first()
    assert abs(row.m) < 1e-6 and abs(row.l[0] + 1) < 1e-12 and abs(row.l[1] - 2.718281828459045) < 1e-12
    assert abs(row.k[1] - (2.718281828459045**-1)) < 1e-12


def test_partitions():
    # the example known for this method: 8 7 6 5 4 in two parts differ by 2
    parts = balance.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    rng = random.Random(1)
    for n, k in itertools.product((1, 4, 12, 40), (1, 2, 4)):
        lengths = [rng.randrange(0, 100) for _ in range(n)]
        for split in (balance.differencing, balance.greedy):
            parts = split(lengths, k)
            assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(n))
            if n % k == 0:
                assert {len(p) for p in split(lengths, k, True)} == {n // k}
        loads = [sum(lengths[i] for i in p) for p in balance.differencing(lengths, k)]
        assert max(loads) - min(loads) <= max(lengths)
    assert balance.greedy([5, 1, 1, 9], 2) == [[0], [1, 2, 3]]
    with pytest.raises(ValueError):
        balance.differencing([1, 2, 3], 2, True)


def test_micro_batches(spark):
    df = spark.createDataFrame([(b, i, (i * 37) % 50 + 1) for b in (0, 1) for i in range(30)] + [(2, 0, None)], "batch int, row_id int, length int")
    got = balance.micro_batches(df, "batch", 200).collect()
    assert len(got) == 61
    loads = {}
    for r in got:
        loads.setdefault(r.batch, {}).setdefault(r.micro_batch, []).append(balance.workload(r.length))
    total = sum((i * 37) % 50 + 1 for i in range(30))
    assert len(loads[0]) == -(-total // 200) and loads[0] == loads[1]
    sums = [sum(loads[0][k]) for k in sorted(loads[0])]
    top = sums.index(max(sums))
    assert sums[:top] == sorted(sums[:top]) and sums[top:] == sorted(sums[top:], reverse=True)


def test_scorers(spark):
    assert one(spark, scorers.last_number("t"), t="#### 1 #### 1,234") == "1234"
    assert one(spark, scorers.last_number("t"), t="no 5") is None
    assert one(spark, scorers.last_number("t", False), t="a 5 then 7.5 .") == "7.5"
    assert one(spark, scorers.last_number("t", False), t="a . b .") == "."
    assert one(spark, scorers.last_number("t"), t=None) is None
    assert one(spark, scorers.tagged_answer("t"), t="<answer>a</answer><answer>\n b\n</answer>") == "b"
    assert one(spark, scorers.truncated("t", 4, "right"), t="abcdefgh") == "(truncated)...efgh"
    assert one(spark, scorers.truncated("t", 4, "left"), t="abcd") == "abcd"
    assert one(spark, scorers.empty_output("t"), t=" \n") is True
    assert one(spark, scorers.empty_output("t"), t="x [no stdout]") is True
    assert one(spark, scorers.warm_up("t", 10), t=5) == 0.5
    assert one(spark, scorers.warm_up("t", 10), t=None) == 1.0
    assert one(spark, scorers.assistant_turn("t"), t=None).error == "empty response"
    assert one(spark, scorers.assistant_turn("t"), t="<tool_call>[1]</tool_call>").error == "tool call is not an object"
    assert one(spark, scorers.assistant_turn("t"), t='<tool_call>{"name": "shell", "arguments": [1]}</tool_call>').error == "arguments are not an object"
    assert one(spark, scorers.assistant_turn("t"), t='<tool_call>{"name": "shell"}</tool_call>').error == "no command"
    ids = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5)])
    assert one(spark, scorers.fit_length(ids, 4, 0, cut="middle")) == [1, 2, 4, 5]
    assert one(spark, scorers.fit_length(ids, 3, 0, cut="right")) == [1, 2, 3]
    assert one(spark, scorers.fit_length(ids, 7, 0, left_pad=False)) == [1, 2, 3, 4, 5, 0, 0]
    assert one(spark, scorers.eos_mask(ids, 3)) == [1, 1, 1, 0, 0]
    assert one(spark, answers.boolean_answer(F.array(F.lit("Paris"), F.lit(" No.")))) is True


def test_pads_and_empty_rows(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, x string")
    assert [(r.row_id, r.x) for r in rows.pad_to_multiple(df, 5).orderBy("row_id").collect()] == [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "a")]
    assert rows.pad_to_multiple(df, 2).count() == 2
    assert rows.pad_to_multiple(df.limit(0), 5).count() == 0
    assert rows.sample(df.limit(0), "row_id", 3, 1).count() == 0
