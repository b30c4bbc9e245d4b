"""Quoted passages: word shingles of texts against one or two reference corpora.

A corpus is (corpus 'q' or 'h', seq, text); a text table has an ``id`` and ``text``. Grams are exploded
once and joined to one gram table with a flag for each corpus, so Spark picks a broadcast or a sort
merge by the table's size; all later steps see hits only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

K, LEAST = 4, 6


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a small input lies in fewer partitions; else as they are, so a
    large input's texts are never shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def grams(texts: DataFrame, spec: tx.NormSpec = tx.ARABIC, k: int = K) -> DataFrame:
    """(id, pos, gram), positions from 0."""
    return spread(texts.select("id", "text")).select("id", F.posexplode(tx.grams(tx.tokens(tx.norm(F.col("text"), spec)), k)).alias("pos", "gram"))


def corpus_grams(corpus: DataFrame, spec: tx.NormSpec = tx.ARABIC, k: int = K) -> DataFrame:
    """Distinct grams with is_q, is_h; grams never cross records."""
    each = corpus.select("corpus", F.explode(tx.grams(tx.tokens(tx.norm(F.col("text"), spec)), k)).alias("gram"))
    return each.groupBy("gram").agg(F.max((F.col("corpus") == "q").cast("int")).alias("is_q"), F.max((F.col("corpus") == "h").cast("int")).alias("is_h"))


def tag_grams(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Positions whose gram a corpus has, tagged 'q' or 'h'; q wins."""
    return found.join(reference, "gram").withColumn("tag", F.when(F.col("is_q") == 1, "q").otherwise("h")).select("id", "pos", "gram", "tag")


def islands(tagged: DataFrame) -> DataFrame:
    """``tagged`` with a number, ``island``, that neighbouring positions of one tag share."""
    return tagged.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("id", "tag").orderBy("pos")))


def tag_runs(tagged: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring positions of one tag: (id, tag, first, n, words)."""
    return islands(tagged).groupBy("id", "tag", "island").agg(F.min("pos").alias("first"), F.count("*").alias("n")).withColumn("words", F.col("n") + K - 1).drop("island")


def passage_scan(texts: DataFrame, reference: DataFrame, spec: tx.NormSpec = tx.ARABIC, least: int = LEAST) -> DataFrame:
    """(id, q_passages, h_passages, covered) for texts with a passage of ``least`` words or more."""
    runs = tag_runs(tag_grams(grams(texts, spec), reference)).where(F.col("words") >= least)
    return runs.groupBy("id").agg(F.sum((F.col("tag") == "q").cast("long")).alias("q_passages"), F.sum((F.col("tag") == "h").cast("long")).alias("h_passages"), F.sum("words").alias("covered"))


def region_gold(texts: DataFrame, reference: DataFrame, spec: tx.NormSpec = tx.ARABIC, least: int = LEAST) -> DataFrame:
    """Distinct (id, tag, gram) inside passages: one scan, one shuffle by (id, tag) for both windows."""
    size = F.count("*").over(Window.partitionBy("id", "tag", "island"))
    tagged = islands(tag_grams(grams(texts, spec), reference)).withColumn("n", size)
    return tagged.where(F.col("n") + K - 1 >= least).select("id", "tag", "gram").distinct()


def longest_run(texts: DataFrame, reference: DataFrame, corpus: str, spec: tx.NormSpec = tx.ARABIC) -> DataFrame:
    """(id, longest) over one corpus alone, 0 if no gram is in it."""
    hits = grams(texts, spec).join(reference.where(F.col(f"is_{corpus}") == 1).select("gram"), "gram", "left_semi").withColumn("tag", F.lit(corpus))
    best = tag_runs(hits).groupBy("id").agg(F.max("n").alias("longest"))
    return texts.select("id").join(best, "id", "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def substring_exact(spans: DataFrame, corpus: DataFrame, spec: tx.NormSpec = tx.ARABIC) -> DataFrame:
    """(id, corpus, seq): the records whose normalised text has a span of two words or more in it, which
    may begin and end inside a word. A span's inner words are whole words of the record, so spans of
    three words or more meet the records on their longest inner word; of two words, on the first, which
    ends a word of the record, and then on the next word's beginning. A span's id is its own."""
    normed = tx.norm(F.col("text"), spec)
    words = spans.select("id", normed.alias("normed")).withColumn("w", tx.tokens(F.col("normed"))).where(F.size("w") >= 2)
    records = corpus.select("corpus", "seq", normed.alias("record"))
    longest = F.array_max(F.transform(F.slice("w", 2, F.size("w") - 2), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    whole = records.select("corpus", "seq", "record", F.explode(F.array_distinct(tx.tokens(F.col("record")))).alias("key"))
    more = words.where(F.size("w") > 2).withColumn("key", longest).join(whole, "key").where(F.contains("record", "normed"))
    r = tx.tokens(F.col("record"))
    couples = records.select("corpus", "seq", F.explode(F.array_distinct(F.zip_with(r, F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))).alias("c")).where("c.y is not null")
    ends = couples.select("corpus", "seq", F.col("c.y").alias("after"), F.explode(F.transform(F.sequence(F.lit(1), F.length("c.x")), lambda i: F.right(F.col("c.x"), i))).alias("key"))
    two = words.where(F.size("w") == 2).withColumn("key", F.get("w", F.lit(0))).join(ends, "key").where(F.startswith("after", F.get("w", F.lit(1))))
    return more.select("id", "corpus", "seq").unionByName(two.select("id", "corpus", "seq")).distinct()


def exact(spans: DataFrame, corpus: DataFrame, reference: DataFrame, tag: str, spec: tx.NormSpec = tx.ARABIC, least_run: int = 3, across: bool = True) -> DataFrame:
    """(id, exact): a run of ``least_run`` grams, or two words or more that stand in the corpus's
    normalised text, joined over records in order (across) or within one.

    The substring test is for spans without the run only, and for those of fewer than K + 2 words: a
    longer one within a record has the run. Across records it runs over one joined text."""
    runs = longest_run(spans, reference, tag, spec)
    short = spans.join(runs.where(F.col("longest") < least_run), "id").select("id", "text")
    own = corpus.where(F.col("corpus") == tag)
    if across:  # one row
        own = own.select("seq", tx.norm(F.col("text"), spec).alias("record"))
        own = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "record"))), lambda x: x["record"]), " ").alias("record"))
        open_ = short.select("id", tx.norm(F.col("text"), spec).alias("normed")).where(F.size(tx.tokens(F.col("normed"))) >= 2)
        hit = open_.join(own, F.col("record").contains(F.col("normed")), "left_semi").select("id", F.lit(True).alias("found"))
    else:
        hit = substring_exact(short, own, spec).select("id", F.lit(True).alias("found")).distinct()
    return runs.join(hit, "id", "left").select("id", ((F.col("longest") >= least_run) | F.coalesce("found", F.lit(False))).alias("exact"))
