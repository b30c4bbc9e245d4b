"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents (the last returns token digests). ``run`` applies them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_reuse, decontam, ngram_join, quality, queries, suffix_dedup
from tessera.llm.core import Stage, bloom, thinned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a hash of all columns: rows that share it are alike in all of them."""
    return docs.select(*COLUMNS, F.xxhash64(*[c for n in COLUMNS for c in (F.col(n), F.col(n).isNull())]).alias("row"))


def judged_rows(docs: DataFrame) -> DataFrame:
    """``docs`` for an operator that judges by row, and not by doc_id."""
    return keyed(docs).withColumn("doc_id", F.col("row")).drop("row")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows in ``gone`` (row: as of ``keyed``). Other rows of the same doc_id stay.
    Only rows that may be in it (a bit set of fixed size) are shuffled."""
    docs, bits = keyed(docs), bloom(gone, "row")
    return thinned(docs, "row", bits, inside=False).unionByName(thinned(docs, "row", bits).join(gone.distinct(), "row", "left_anti").select(*COLUMNS, "row")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.quality(judged_rows(docs)).where("not kept").select(F.col("doc_id").alias("row"))
    return without(docs, Stage(spark, "judged").write(judged, "bad"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one row of the smallest doc_id (null: last; rows
    that share it: any one), and of rows alike in all columns, one. Similar: Jaccard similarity 0.8 or more
    of the sets of five-word shingles (op3's own are of four words, at 0.85)."""
    stage = Stage(spark, "copies")
    linked = ngram_join.jaccard_components(judged_rows(docs), k=5, percent=80).where("component_id <> doc_id")
    others = stage.write(linked.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "others")
    members = others.unionByName(others.select(F.col("component").alias("row"), "component")).distinct()
    named = thinned(keyed(docs).select("row", "doc_id"), "row", bloom(members, "row")).distinct().join(members, "row")
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")).select("first.row")
    gone = stage.write(members.select("row").join(kept, "row", "left_anti"), "gone")
    docs = keyed(docs)
    again = stage.write(docs.groupBy("row").count().where("count > 1").select("row"), "again")
    bits = bloom(gone.unionByName(again), "row")
    once = thinned(docs, "row", bits).join(gone, "row", "left_anti").select(*COLUMNS).distinct()
    return thinned(docs, "row", bits, inside=False).select(*COLUMNS).unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere too: all that is in strings of
    ``suffix_dedup.PASSAGE`` bytes met twice, which passages of over 50 words have (op4's own strings
    are of 400 bytes). What is left of a cut character goes, and n_chars follows. A document of
    nothing else stays, with an empty text."""
    cut = suffix_dedup.without_repeats(docs.select(*COLUMNS), length=suffix_dedup.PASSAGE)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontam.leaks(judged_rows(docs), queries.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row"))
    return without(docs, Stage(spark, "leaks").write(found, "found"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return bpe_reuse.encode(docs, queries.tokenizer())


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", benchmark_passages), ("BPE encoding and decoding", tokens)]

#: Suffix arrays, edit windows and BPE can't be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents").select(*COLUMNS)
    stage = Stage(spark, "pipeline")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage.write(docs, f"step-{k}")
    return docs
