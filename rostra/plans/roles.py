"""The driver's tables in the roles of the engine's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(1998, 6, 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dated over 90 days, titled by source, spoken by two made-up names."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("crec_id"),
        F.col("text").alias("content"),
        F.col("source").alias("title"),
        F.col("lang").alias("title_part"),
        F.date_add(F.lit(dt.date(2017, 1, 1)), F.pmod("doc_id", F.lit(90)).cast("int")).alias("date_issued"),
        F.concat(F.lit("Customer#"), F.lpad(F.pmod("doc_id", F.lit(150)).cast("string"), 9, "0"), F.lit(",nobody,Customer#"), F.lpad(F.pmod(F.col("doc_id") * 7, F.lit(150)).cast("string"), 9, "0")).alias("speakers"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("bioguide_id"), F.col("c_name").alias("official_full"), F.col("c_mktsegment").alias("religion"), F.col("c_nationkey").alias("nation"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("bioguide_id"),
        F.col("o_orderkey").alias("term_id"),
        start.alias("start_date"),
        F.date_add(start, 365).alias("end_date"),
        F.col("o_orderstatus").alias("type"),
        F.col("o_orderpriority").alias("party"),
    )
