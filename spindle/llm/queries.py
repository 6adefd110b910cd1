"""The registered queries of this folder: thin wrappers that read a table,
apply an operator with production parameters and derive the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import chat, class_lm, decontaminate, huffman, langid, licenses, near_dedup, packing, quality, suffix_dedup

from spindle.llm.store import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.remainder() != 2))
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(langid.remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.write(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "words", 1)
    return huffman.read_checksums(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    written = Workspace(spark, "chat").write(chat.format_conversations(turns.union(own)), "formatted")
    return chat.read_back(written).select(
        "conv_id",
        F.expr("bigint(size(turns))").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.expr("bigint(length(array_join(losses, '')))").alias("loss_chars"),
        F.expr("sha2(array_join(losses, ''), 256)").alias("loss_sha256"),
        F.expr("bigint(length(formatted))").alias("formatted_chars"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "spaced", 2)
    return out.drop("ids")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = langid.remainder(by=10)
    return class_lm.score(docs, train=rest != 0, held_out=rest == 0)


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_language_id": op2_language_id,
    "op3_huffman_ids": op3_huffman_ids,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_format": op6_chat_format,
    "op8_license_scan": op8_license_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_class_lm": op10_class_lm,
}

#: No query of this folder is plain SQL: each is held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {}
