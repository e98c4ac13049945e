"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows its predecessor kept and returns the columns of documents;
the last returns the packing. ``run`` writes every stage as Parquet to the shared folder
and rereads it, so a lost executor never costs more than tasks of the current stage.

Nulls: a null text counts as an empty one where a stage reads it and passes through where
it does not; rows with a null doc_id are never dropped as copies. Extra columns of the
documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rostra.llm import decontaminate, line_dedup, minhash, packing, quality_mil
from rostra.llm.common import discard, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_mil.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites carry; ``n_chars`` follows the text.

    Of documents proven to be near copies of one another only one counts with its site, else
    a copied document would lose its lines; lines that have the spread go whatever is left.
    """
    copies_out = minhash.keep_one(docs.select("doc_id", "text", "source"), rounds=1)
    return line_dedup.clean(docs, counted=copies_out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates."""
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packed", packed)]

#: A classifier and a tokenizer are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
