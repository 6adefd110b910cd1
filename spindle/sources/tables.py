"""Readers and writers: line corpora, tolerant and strict JSON lines, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def corpus_lines(docs: DataFrame) -> DataFrame:
    """line_no and line of every line of ``docs``; line_no is the struct (doc_id, pos), which orders documents, then lines."""
    exploded = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return exploded.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("bigint").alias("pos")).alias("line_no"), "line")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones are skipped too or raise (``strict``)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keep_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of a split; all rows if none names a split."""
    named = rows.where(F.col("split").isNotNull()).limit(1).agg(F.count("*").alias("_named"))
    return rows.join(F.broadcast(named)).where((F.col("_named") == 0) | (F.col("split") == split)).drop("_named")


def write_shards(lines: DataFrame, path: str, shards: int) -> None:
    """Line-aligned contiguous shards in order of line_no."""
    lines.repartitionByRange(shards, "line_no").sortWithinPartitions("line_no").write.parquet(path)


def in_shards_round_trip(lines: DataFrame, path: str) -> bool:
    """A written shard set holds the same lines: counts and order-independent checksums agree."""
    total = [F.count("*"), F.sum(F.xxhash64("line_no", "line").cast("decimal(38,0)"))]
    return tuple(lines.agg(*total).first()) == tuple(lines.sparkSession.read.parquet(path).agg(*total).first())
