"""Queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as answers: id, answer, model, prompt (no text of its own: the language)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.col("source").alias("model"), F.col("lang").alias("prompt"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as two corpora: even items 'q', odd ones 'h'."""
    return table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "q").otherwise("h").alias("corpus"), F.col("item_id").alias("seq"), "text")
