"""The corpus pipeline: five stages over ``documents``.

Every stage gets what its predecessor kept, written as Parquet and read again.
The first four return the columns of ``documents``:

1. quality rules: documents that fail the base rules or the learned list go;
2. near duplicates: of each class one row with the least doc_id stays (null is
   the greatest); of rows repeated with one doc_id and text one stays;
3. repeated windows: bytes of 50-byte strings that also start in a document
   with a smaller doc_id go, ``n_chars`` is counted anew;
4. decontamination: documents that match a benchmark item go;
5. packing: the pieces of the rest in sequences of 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from spindle.llm.queries import table
from spindle.llm.store import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # classes of rows, not of doc_ids: a doc_id may stand in several rows or be null
    rows = Workspace(spark, "rows").write(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = near_dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row", "_hash")).alias("f")
    firsts = rows.select("_row", "doc_id", F.sha2("text", 256).alias("_hash")).join(classes, "_row").groupBy("class_id").agg(least)
    # texts without a word have a class each; of these too a repeated row stays once
    kept = firsts.groupBy("f.doc_id", "f._hash").agg(F.min("f._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(docs, as_text=True)
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[fresh.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), "spaced", 2).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_windows", repeated_windows),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Near duplicates, learned rules and packing are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
