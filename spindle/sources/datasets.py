"""Question sets, corpora in archives and file sets by suffix."""

from __future__ import annotations

import io
import os
import tarfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Benchmark sets and the split each is read from.
DEFAULT_SPLIT = {
    "nq": "test",
    "triviaqa": "test",
    "popqa": "test",
    "hotpotqa": "dev",
    "2wikimultihopqa": "dev",
    "musique": "dev",
    "bamboogle": "test",
}

_RAW = "id string, question string, golden_answers array<string>, metadata struct<level:string,type:string>"


def list_datasets() -> list[str]:
    return sorted(DEFAULT_SPLIT)


def prefixed(prefix: str, key: Column | str) -> Column:
    """The key with its prefix, once; ``prefix_anon`` without a key."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.when(k.isNull() | (k == ""), F.lit(f"{prefix}_anon")).when(k.startswith(f"{prefix}_"), k).otherwise(F.concat(F.lit(f"{prefix}_"), k))


def _answered(golds: str = "golden_answers") -> Column:
    return F.coalesce(F.exists(golds, lambda g: F.trim(F.coalesce(g, F.lit(""))) != ""), F.lit(False))


def benchmark(spark: SparkSession, root: str, name: str, split: str | None = None) -> DataFrame:
    """id, question, golden_answers of a named set under ``root/name/split.jsonl``; rows without an answer go."""
    if name not in DEFAULT_SPLIT:
        raise ValueError(f"unknown dataset {name!r}; supported: {list_datasets()}")
    rows = spark.read.schema(_RAW).json(f"{root}/{name}/{split or DEFAULT_SPLIT[name]}.jsonl")
    return rows.where(_answered()).select(prefixed(name, "id").alias("id"), "question", "golden_answers")


def multi_hop(spark: SparkSession, path: str) -> DataFrame:
    """Questions with the level and type of their metadata."""
    rows = spark.read.schema(_RAW).json(path)
    return rows.select("id", "question", "golden_answers", F.col("metadata.level").alias("level"), F.col("metadata.type").alias("type"))


def single_hop(spark: SparkSession, path: str, prefix: str = "nq") -> DataFrame:
    """Questions with an answer that is not blank, ids with a prefix."""
    rows = spark.read.schema(_RAW).json(path)
    return rows.where(_answered()).select(prefixed(prefix, "id").alias("id"), "question", "golden_answers")


def questions(rows: DataFrame, stem: str) -> DataFrame:
    """id, question and golden_answers of records of any common shape (row_id and
    the columns question or query, id or qid, golden_answers, answers or answer); blank questions go."""
    have = set(rows.columns)

    def first(names: list[str], default: Column) -> Column:
        return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names if n in have], default)

    def golds(n: str) -> Column:
        kind = rows.schema[n].dataType.simpleString()
        return F.col(n) if kind.startswith("array") else F.when(F.col(n).isNotNull(), F.array(F.col(n).cast("string")))

    found = F.coalesce(*[golds(n) for n in ("golden_answers", "answers", "answer") if n in have], F.array().cast("array<string>"))
    question = F.trim(first(["question", "query"], F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    key = F.coalesce(*[F.col(n).cast("string") for n in ("id", "qid") if n in have], F.concat(F.lit(f"{stem}_"), F.col("row_id").cast("string")))
    out = rows.select(key.alias("id"), question.alias("question"), F.filter(F.transform(found, lambda g: F.trim(g)), lambda g: g != "").alias("golden_answers"))
    return out.where("question <> ''")


def records(spark: SparkSession, path: str, schema: str, key: str = "data") -> DataFrame:
    """A JSON document: an array of records, or an object that holds it under ``key`` (or a split's name)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("_v"))
    bare = F.from_json("_v", f"array<struct<{schema}>>")
    held = F.from_json("_v", f"struct<`{key}`:array<struct<{schema}>>>")[key]
    is_list = F.startswith(F.ltrim("_v", F.lit(" \t\n\r")), F.lit("["))
    return whole.select(F.explode(F.when(is_list, bare).otherwise(held)).alias("_r")).select("_r.*")


def read_files(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All rows of Parquet, JSON or JSONL files, by their suffix; columns by name."""
    out = None
    for p in paths:
        suffix = os.path.splitext(p)[1]
        if suffix == ".parquet":
            rows = spark.read.parquet(p)
        elif suffix in (".json", ".jsonl"):
            reader = spark.read.schema(schema) if schema else spark.read
            rows = reader.option("multiLine", suffix == ".json").json(p)
        else:
            raise ValueError(f"unsupported file format: {p}")
        out = rows if out is None else out.unionByName(rows)
    return out


def archive_lines(spark: SparkSession, path: str, member: str = ".jsonl") -> DataFrame:
    """(file, line_no, line) of the members with a suffix in gzipped tar files, or
    of plain gzip files.  A file is one task (a compressed stream has no places to
    enter it), read as a stream."""

    def read(batches):
        for b in batches:
            for name, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:gz") as t:
                        parts = [t.extractfile(m) for m in t if m.isfile() and m.name.endswith(member)]
                        yield from lines(name, parts)
                except tarfile.ReadError:
                    yield from lines(name, [io.BytesIO(zlib.decompress(raw, 47))])

    def lines(name, parts):
        at, held = 0, []
        for part in parts:
            for x in part:
                held.append(x.decode("utf-8", "replace").rstrip("\n"))
                if len(held) == 10_000:
                    yield batch(name, at, held)
                    at, held = at + len(held), []
        if held:
            yield batch(name, at, held)

    def batch(name, at, held):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.string())], ["file", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, line_no bigint, line string")


def resolve(spark: SparkSession, catalogue: dict[str, str], name: str) -> DataFrame:
    """The table that a logical file name stands for, by the whole name."""
    if name not in catalogue:
        raise KeyError(name)
    return read_files(spark, [catalogue[name]])
