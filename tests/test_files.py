"""Readers, writers, streams and registries: round trips and a real stream."""

import gzip
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from spindle.operators import balance, index, registry, rows
from spindle.sources import datasets, scratch, sinks
from spindle.sources.tables import corpus_lines, keep_split, read_json_documents, read_jsonl
from spindle.streaming import queue, samples


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    open(path, "w").write('{"id": 1, "t": "é"}\n\n{"id": 2, "t": \n{"id": 3, "t": null}\n')
    assert [tuple(r) for r in read_jsonl(spark, path, "id int, t string").orderBy("id").collect()] == [(1, "é"), (3, None)]
    with pytest.raises(Exception):
        read_jsonl(spark, path, "id int, t string", strict=True).collect()
    open(path, "w").write('[{"id": 1}, {"id": 2}]')
    assert read_json_documents(spark, path, "id int").count() == 2
    assert datasets.records(spark, path, "id int").count() == 2
    open(path, "w").write('{"data": [{"id": 1}], "dev": [{"id": 2}, {"id": 3}]}')
    assert datasets.records(spark, path, "id int").count() == 1 and datasets.records(spark, path, "id int", "dev").count() == 2


def test_split_filter(spark):
    named = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, split string")
    assert [r.id for r in keep_split(named, "a").collect()] == [1]
    assert keep_split(named.withColumn("split", F.lit(None).cast("string")), "a").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", 0.5)], "id int, t string, x double")
    path = str(tmp_path / "out")
    sinks.write_jsonl(df, path)
    lines = "".join(open(f"{path}/{f}").read() for f in os.listdir(path) if f.endswith(".json"))
    assert '{"id":1,"t":"é","x":null}' in lines
    assert sinks.append_new(df.union(df.selectExpr("id + 2", "t", "x")), path, "id") == 2
    assert sinks.append_new(df, path, "id") == 0
    assert json.loads(sinks.summary_json(df.agg(F.count("*").alias("n")))) == {"n": 2}
    with pytest.raises(ValueError):
        sinks.summary_json(df)
    sinks.log_call(spark, str(tmp_path / "log"), "rg x", "scan", 0)
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    sinks.log_call(spark, "/proc/none/log", "rg x", "scan", 0)
    sinks.save_step(df, str(tmp_path / "steps"), 3)
    assert sinks.load_step(spark, str(tmp_path / "steps"), 3).count() == 2 and sinks.load_step(spark, str(tmp_path / "steps"), 4) is None


def test_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "\n".join(f"{i} {j}" for j in range(i % 5))) for i in range(50)], "doc_id long, text string")
    lines, path = corpus_lines(docs), str(tmp_path / "shards")
    first = sinks.build_shards(lines, path, 4, "docs")
    stamp = os.path.getmtime(f"{path}/lines")
    assert sinks.build_shards(lines, path, 4, "docs") == first and os.path.getmtime(f"{path}/lines") == stamp
    assert sinks.build_shards(lines.limit(10), path, 4, "docs")["n_lines"] == 10
    assert sinks.read_shards(spark, path).count() == 10


def test_trajectory_text(spark):
    record = spark.sql(
        "select named_struct('id', 'q1', 'question', 'who?', 'gold_answer', array('x'), 'success', false, 'abort_reason', 'no_answer', "
        "'history_steps', array(named_struct('think', 't', 'tool_call', 'rg', 'tool_response', ' r ')), 'final', named_struct('think', '', 'answer', '')) as record"
    )
    text = record.select(sinks.rendered_trajectory().alias("v")).first().v
    assert "id:           q1" in text and "--- assistant turn 1 ---" in text and "<tool_response>\nr\n</tool_response>" in text and text.endswith("[DID NOT FINISH — no_answer]")


def test_archives(spark, tmp_path):
    body = "one\ntwo é\n".encode()
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name in ("d/c.jsonl", "d/readme.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    with gzip.open(tmp_path / "b.gz", "wb") as f:
        f.write(body)
    got = sorted((os.path.basename(r.file), r.line_no, r.line) for r in datasets.archive_lines(spark, str(tmp_path)).collect())
    assert got == [(f, i, x) for f in ("a.tar.gz", "b.gz") for i, x in enumerate(["one", "two é"])]


def test_question_files(spark, tmp_path):
    r = spark.createDataFrame([(0, None, "q0", ["a", " "]), (1, "k", " ", ["b"]), (2, "z", "q2", None)], "row_id long, id string, question string, answers array<string>")
    assert [(x.id, x.question, x.golden_answers) for x in datasets.questions(r, "f").orderBy("question").collect()] == [("f_0", "q0", ["a"]), ("z", "q2", [])]
    with pytest.raises(ValueError):
        datasets.benchmark(spark, "/x", "unknown")
    with pytest.raises(ValueError):
        datasets.read_files(spark, ["x.csv"])
    with pytest.raises(KeyError):
        datasets.resolve(spark, {"corpus.jsonl": "x.parquet"}, "wiki_corpus.jsonl")
    r.write.parquet(str(tmp_path / "x.parquet"))
    assert datasets.resolve(spark, {"corpus.jsonl": str(tmp_path / "x.parquet")}, "corpus.jsonl").count() == 3
    path = str(tmp_path / "m.jsonl")
    open(path, "w").write('{"id": "1", "question": "q", "golden_answers": ["x"], "metadata": {"level": "hard", "type": "bridge"}, "more": 1}\n{"id": "2", "question": "r", "golden_answers": []}\n')
    assert [tuple(x) for x in datasets.multi_hop(spark, path).orderBy("id").collect()] == [("1", "q", ["x"], "hard", "bridge"), ("2", "r", [], None, None)]
    assert [x.id for x in datasets.single_hop(spark, path).collect()] == ["nq_1"]


def test_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: {"spark.master": "spark://host:7077"}.get(name, default))

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)
    assert scratch.shared_dir(spark)


def test_index_plans(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 7} Straße {'rare' if i == 30 else ''}\nsecond !") for i in range(200)] + [(5000, None)], "doc_id long, text string")
    lines, path = corpus_lines(docs), str(tmp_path / "index")
    index.build(lines, path, "docs")
    built = index.Index(spark, path)
    for pattern in ("rare", "word3 Str", "common", "!", "absent", "ond !", "raße"):
        want = {tuple(r.line_no) for r in lines.where(F.col("line").contains(pattern)).collect()}
        assert {tuple(r.line_no) for r in built.search(pattern).collect()} == want
    assert built.plan("rare").indexed and built.plan("rare").estimate == 1
    assert not built.plan("common").indexed and not built.plan("!").indexed
    assert built.plan("absent").estimate == 0 and built.plan("absent").indexed
    assert built.fresh("docs", 400, built.meta["n_bytes"]) and not built.fresh("other", 400, built.meta["n_bytes"])
    read = built.candidates(built.plan("rare"))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in read._jdf.queryExecution().executedPlan().toString() or "In(term" in read._jdf.queryExecution().executedPlan().toString()


def test_bounded_queue_stream(spark, tmp_path):
    source, schema = tmp_path / "in", "queue string, at bigint, action string, sample string"
    acts = [("a", i, "put", f"s{i}") for i in range(7)] + [("a", 7, "get", None), ("a", 8, "get", None), ("b", 0, "get", None), ("b", 1, "put", "x")]
    want = {(r.queue, r.at, r.sample, r.ok, r["size"], r.produced, r.consumed, r.dropped) for r in samples.bounded_queue(spark.createDataFrame(acts, schema), 3).collect()}
    assert ("a", 7, "s4", True, 2, 7, 1, 4) in want and ("b", 0, None, False, 0, 0, 0, 0) in want and ("a", 3, "s3", False, 3, 4, 0, 1) in want
    got = set()
    for part in (acts[:4], acts[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
        stream = samples.bounded_queue(spark.readStream.schema(schema).json(str(source)), 3)

        def keep(batch, _):
            got.update((r.queue, r.at, r.sample, r.ok, r["size"], r.produced, r.consumed, r.dropped) for r in batch.collect())

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert got == want


def test_resumable_stream_and_config(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id int, ts timestamp"
    made = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    seen = []
    for ids in ([1, 2, 2], [2, 3]):
        made(ids).coalesce(1).write.mode("append").json(source)
        samples.resumable(spark.readStream.schema(schema).json(source), "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        config = spark.createDataFrame([(i, f"v{len(seen)}") for i in (1, 2, 3)], "id int, v string")
        samples.with_config(spark.readStream.schema(schema).json(source), lambda c=config: c, "id", lambda b, _: seen.append({(r.id, r.v) for r in b.collect()}), str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(r.id for r in read_jsonl(spark, str(tmp_path / "out"), "id int").collect()) == [1, 2, 3]
    assert seen == [{(1, "v0"), (2, "v0")}, {(2, "v1"), (3, "v1")}]
    assert queue.first_events(made([1, 1, 2]), "id").count() == 2


def test_registries(tmp_path, spark):
    assert "grpo" in registry.ESTIMATORS.names()
    with pytest.raises(ValueError):
        registry.ESTIMATORS.get("unknown")
    with pytest.raises(ValueError):
        registry.ESTIMATORS.register("grpo")(lambda r: r)
    (tmp_path / "reward.py").write_text("from pyspark.sql import functions as F\ndef score(rows, bonus=0):\n    return rows.withColumn('score', F.col('length') + bonus)\n")
    f = registry.load_function(str(tmp_path / "reward.py"), "score")
    df = spark.createDataFrame([(3,), (0,)], "length int")
    assert sorted(r.score for r in f(df, bonus=1).collect()) == [1, 4]
    with pytest.raises(AttributeError):
        registry.load_function(str(tmp_path / "reward.py"), "none")
    over = registry.REWARD_MANAGERS.get("overlong")(df.withColumn("length", F.lit(4000)), F.lit(1.0))
    assert {round(r.score, 4) for r in over.collect()} == {round(1 - 416 / 512, 4)}
    assert {r.score for r in registry.REWARD_MANAGERS.get("zero_on_error")(df, F.lit(None).cast("double")).collect()} == {0.0}
    assert sorted(len(r.rewards) for r in registry.token_rewards(df.withColumn("score", F.lit(2.0))).collect()) == [0, 3]


def test_balanced_modes(spark):
    batch = spark.createDataFrame([(0, i, i // 4, (i * 37) % 50 + 1) for i in range(32)], "batch long, row_id long, uid long, length long")
    plain = balance.balanced(batch, "batch", 4).collect()
    assert sorted(r.place for r in plain) == list(range(32)) and {sum(r.part == k for r in plain) for k in range(4)} == {8}
    mini = balance.balanced(batch, "batch", 4, "mini", 16).collect()
    assert all(sum(r.part == k and r.row_id // 16 == m for r in mini) == 4 for k in range(4) for m in range(2))
    group = balance.balanced(batch, "batch", 4, "group", group="uid").collect()
    assert all(len({r.part for r in group if r.row_id // 4 == g}) == 1 for g in range(8))
    with pytest.raises(ValueError):
        balance.balanced(batch, "batch", 4, "other")


def test_weighted_draws(spark):
    r = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 1, 3, -2, 6])], "k long, w double")
    out = rows.weighted_sample(r, "k", "w", 4000, 1).groupBy("k").count().collect()
    share = {x.k: x["count"] / 4000 for x in out}
    assert set(share) == {1, 2, 4} and sum(share.values()) == 1 and abs(share[4] - 0.6) < 0.05 and abs(share[1] - 0.1) < 0.03
    for method, want in (("pow", [0, 1, 9, 4, 36]), ("max_min", [0, 0, 0, 1, 1]), ("max_random", [0.1] * 4 + [0.4])):
        assert [x.v for x in r.select("k", rows.resampling_weights("w", method, 2.0).alias("v")).orderBy("k").collect()] == want


def test_row_errors(spark):
    n = spark.range(5).select(F.col("id").alias("row_id"), F.col("id").alias("x"))
    with pytest.raises(KeyError):
        rows.pop(n, ["y"])
    with pytest.raises(ValueError):
        rows.rename(n, ["x"], [])
    with pytest.raises(ValueError):
        rows.concat([n, n.drop("x")])
    with pytest.raises(ValueError):
        rows.mini_batches(n, 2, 1, 5)
    with pytest.raises(Exception):
        rows.check_lengths(n.withColumn("a", F.array("x")).withColumn("b", F.array("x", "x")), ["a", "b"]).collect()
    with pytest.raises(Exception):
        rows.unfold_chunks(n.withColumn("a", F.array("x", "x", "x")), "a", 2).collect()
    assert rows.slice_rows(n, -2, None).count() == 2 and rows.slice_rows(n, None, None, -1).orderBy("place").first().row_id == 4
    assert rows.pad_with(n, 0).count() == 5
