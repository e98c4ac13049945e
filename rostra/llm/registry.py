"""The thin opN queries: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm import ann, chat, decontaminate, html_model, licenses, line_dedup, lm_scoring, merkle, minhash, packing, pivots, quality_mil, substring_dedup
from rostra.llm.common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.groups(table(spark, sf_dir, "documents", "doc_id", "text"), n=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_model.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return line_dedup.strip_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lm_scoring.score(docs, table(spark, sf_dir, "conversations", "text"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    awkward = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", awkward), (-1, 1, "assistant", awkward)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(more)), arranged=True)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.from_embeddings(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents", *columns)
    marked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(marked, merkle.leaf([*columns[:-1], merkle.lowered("text")]))
    return merkle.manifest(docs, columns, "source", "doc_id", changed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_near_dedup, op3_html, op4_line_dedup, op5_lm_scoring, op6_licenses, op7_decontamination, op8_substring_dedup, op9_quality, op10_packing, op11_chat, op12_hard_negatives, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": minhash.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE, "op11_chat": chat.ORACLE, "op12_hard_negatives": pivots.ORACLE, "op13_manifest": merkle.ORACLE}
