"""Writers: JSONL, Parquet, append and resume, shards with a manifest, dumps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, null fields kept, letters as they are."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not in the file yet; returns how many.  A run that was cut off is resumed."""
    spark = rows.sparkSession
    if _exists(spark, path):
        done = spark.read.schema(rows.schema).json(path).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    before = spark.read.schema(rows.schema).json(path).count() if _exists(spark, path) else 0
    write_jsonl(rows, path, "append")
    return spark.read.schema(rows.schema).json(path).count() - before


def write_train_val(rows: DataFrame, path: str, held: Column) -> None:
    """Parquet folders split=train and split=val."""
    rows.withColumn("split", F.when(held, "val").otherwise("train")).write.partitionBy("split").parquet(path)


def summary_json(rows: DataFrame) -> str:
    """The one row of a summary as indented JSON."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a summary has one row")
    return json.dumps(found[0].asDict(recursive=True), indent=2, ensure_ascii=False, default=str)


def dump_generations(rows: DataFrame, path: str, step: int, extras: list[str] | None = None) -> None:
    """JSONL of input, output, gts, score, step and the extra columns that are there, under ``path/step``."""
    columns = ["input", "output", "gts", "score", *[c for c in extras or [] if c in rows.columns]]
    write_jsonl(rows.select(*columns, F.lit(step).alias("step")), f"{path}/{step}", "overwrite")


def rendered_trajectory(record: Column | str = "record") -> Column:
    """A record (id, question, gold_answer, success, abort_reason, history_steps,
    final) as text to read: head, turns, and how it ended."""
    r = F.col(record) if isinstance(record, str) else record
    bar = F.lit("=" * 72)
    aborted = F.coalesce(r["abort_reason"], F.lit("")) != ""
    head = F.array(
        bar, F.concat(F.lit("id:           "), F.coalesce(r["id"], F.lit(""))), F.concat(F.lit("question:     "), F.coalesce(r["question"], F.lit(""))),
        F.concat(F.lit("gold_answer:  "), F.to_json(F.coalesce(r["gold_answer"], F.array().cast("array<string>")))), F.concat(F.lit("success:      "), F.initcap(r["success"].cast("string"))),
    )
    head = F.concat(head, F.when(aborted, F.array(F.concat(F.lit("abort_reason: "), r["abort_reason"]))).otherwise(F.array().cast("array<string>")), F.array(bar))

    def turn(s: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.array(
            F.concat(F.lit("\n--- assistant turn "), n, F.lit(" ---")),
            F.concat(F.lit("<think>\n"), F.coalesce(s["think"], F.lit("")), F.lit("\n</think>\n<tool_call>\n"), F.coalesce(s["tool_call"], F.lit("")), F.lit("\n</tool_call>")),
            F.concat(F.lit("\n--- user turn "), n, F.lit(" (tool result) ---")),
            F.concat(F.lit("<tool_response>\n"), F.trim(F.coalesce(s["tool_response"], F.lit(""))), F.lit("\n</tool_response>")),
        )

    none = F.array().cast("array<string>")
    turns = F.flatten(F.transform(F.coalesce(r["history_steps"], F.array().cast("array<struct<think:string,tool_call:string,tool_response:string>>")), turn))
    answered = F.coalesce(r["final"]["answer"], F.lit("")) != ""
    last = F.array(F.lit("\n--- final assistant turn ---"), F.concat(F.lit("<think>\n"), F.coalesce(r["final"]["think"], F.lit("")), F.lit("\n</think>\n<answer>"), r["final"]["answer"], F.lit("</answer>")))
    end = F.when(answered, last).when(aborted, F.array(F.concat(F.lit("\n[DID NOT FINISH — "), r["abort_reason"], F.lit("]")))).otherwise(none)
    return F.array_join(F.concat(head, turns, end), "\n")


def log_call(spark: SparkSession, path: str, command: str, strategy: str, exit_code: int, reason: str | None = None) -> None:
    """One row of the query log; a log that cannot be written stops nothing."""
    row = [(command, strategy, exit_code, reason)]
    try:
        spark.createDataFrame(row, "command string, strategy string, exit_code int, reason string").coalesce(1).write.mode("append").json(path)
    except Exception:  # noqa: BLE001 - best effort by contract
        return


def _checksum(lines: DataFrame) -> tuple[int, str]:
    """Count and an order-independent digest: the sum of each line's 256-bit hash, by 64-bit quarters."""
    h = F.sha2(F.concat_ws("\x1f", F.to_json(F.struct("line_no")), "line"), 256)
    parts = [F.sum(F.conv(F.substring(h, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    r = lines.agg(F.count("*"), *parts).first()
    return r[0], "-".join(str(x or 0) for x in r[1:])


def build_shards(lines: DataFrame, path: str, shards: int, source: str = "", force: bool = False) -> dict:
    """Contiguous shards in order of line_no and their manifest; built anew only if
    forced or if the manifest tells of another source.  What was written is read back and compared."""
    spark = lines.sparkSession
    manifest = f"{path}/manifest"
    n, digest = _checksum(lines)
    if _exists(spark, manifest) and not force:
        old = spark.read.json(manifest).first().asDict()
        if (old["source"], old["n_lines"], old["digest"], old["n_shards"]) == (source, n, digest, shards):
            return old
    ranged = lines.repartitionByRange(shards, "line_no").sortWithinPartitions("line_no").withColumn("shard", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(f"{path}/lines")
    if _checksum(spark.read.parquet(f"{path}/lines").select("line_no", "line")) != (n, digest):
        raise ValueError("the shards do not hold the lines that were written")
    facts = {"source": source, "n_lines": n, "digest": digest, "n_shards": shards}
    spark.createDataFrame([tuple(facts.values())], "source string, n_lines bigint, digest string, n_shards int").coalesce(1).write.mode("overwrite").json(manifest)
    return facts


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line of a shard set; line_no is the order, whatever task reads which shard."""
    return spark.read.parquet(f"{path}/lines").select("line_no", "line")


def save_step(rows: DataFrame, path: str, step: int) -> None:
    """A batch of rollouts, to be replayed by ``load_step``."""
    rows.write.mode("overwrite").parquet(f"{path}/step={step}")


def load_step(spark: SparkSession, path: str, step: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/step={step}") if _exists(spark, f"{path}/step={step}") else None


def save_pool(rows: DataFrame, path: str) -> None:
    """A replay pool by task and side."""
    rows.write.mode("overwrite").partitionBy("task", "positive").parquet(path)


def load_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
