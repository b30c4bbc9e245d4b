"""Label metrics, in integer counts until the last division. No data: null, not 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zip_pairs(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Pairs by position, to the shorter of two arrays: all other columns, pos, g, p."""
    n = F.least(F.size(gold), F.size(predicted))
    both = F.when(n > 0, F.arrays_zip(F.slice(gold, 1, n).alias("g"), F.slice(predicted, 1, n).alias("p")))
    rest = [c for c in rows.columns if c not in (gold, predicted)]
    return rows.select(*rest, F.posexplode(both).alias("pos", "pair")).select(*rest, "pos", "pair.g", "pair.p")


def label_counts(pairs: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn of each group and label of the fixed list, zero rows included. One pass: each pair
    is one row for its gold and one for its predicted label, summed before the shuffle."""
    side = F.explode(F.array(F.struct(F.col("g").alias("label"), F.lit(True).alias("gold")), F.struct(F.col("p").alias("label"), F.lit(False).alias("gold")))).alias("s")
    counted = pairs.select(*by, (F.col("g") == F.col("p")).alias("same"), side).select(*by, "same", "s.*")
    same = F.coalesce("same", F.lit(False))
    sums = counted.groupBy(*by, "label").agg(F.sum((same & F.col("gold")).cast("long")).alias("tp"), F.sum((~same & ~F.col("gold")).cast("long")).alias("fp"), F.sum((~same & F.col("gold")).cast("long")).alias("fn"))
    every = pairs.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, labels))).alias("label"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(sums, [*by, "label"], "left").select(*by, "label", zero("tp"), zero("fp"), zero("fn"))


def f1() -> Column:
    """2 tp / (2 tp + fp + fn), 0 when undefined."""
    return F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def macro_f1(counts: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean over the fixed labels."""
    return counts.withColumn("f1", f1()).groupBy(*by).agg((F.sum("f1") / F.count("*")).alias("macro_f1"))


def of_kind(pairs: DataFrame, wanted: str | None = None, kind: str = "source_type") -> DataFrame:
    """The pairs whose gold span has the kind ``wanted``; all of them without one."""
    return pairs.where(F.col(kind) == wanted) if wanted else pairs


def scorecard(pairs: DataFrame, labels: list[str], kinds: list[str], by: str = "model", kind: str = "source_type") -> DataFrame:
    """A row for each model: macro F1 of all pairs and of each kind (null where there are none) and F1
    of each label, best model first."""
    slices = F.array(F.lit("all"), F.when(F.col(kind).isin(kinds), F.col(kind)))
    sliced = pairs.select(by, "g", "p", F.explode(F.array_compact(slices)).alias("slice"))
    scored = label_counts(sliced, labels, [by, "slice"]).withColumn("f1", f1())
    macro = [F.avg(F.when(F.col("slice") == s, F.col("f1"))).alias(f"macro_f1_{s}") for s in ("all", *kinds)]
    own = [F.max(F.when((F.col("slice") == "all") & (F.col("label") == x), F.col("f1"))).alias(f"f1_{x}") for x in labels]
    return scored.groupBy(by).agg(*macro, *own).orderBy(F.desc_nulls_last("macro_f1_all"), by)


def label_matrix(scores: DataFrame, by: str = "model") -> DataFrame:
    """A scorecard's F1 columns under the labels' names."""
    return scores.select(by, *(F.col(f"`{c}`").alias(c.removeprefix("f1_")) for c in scores.columns if c.startswith("f1_")))


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """total, agree, rate (null for no pairs) and ``confusion``, a map of "gold|predicted" to counts in
    order of the keys; one entry for each pair of labels that occurs."""
    n = pairs.groupBy(*by, "g", "p").agg(F.count("*").alias("n"))
    key = F.concat_ws("|", F.coalesce("g", F.lit("None")), F.coalesce("p", F.lit("None"))).alias("key")
    agree = F.sum(F.when(F.col("g").eqNullSafe(F.col("p")), F.col("n")).otherwise(0))
    sums = n.groupBy(*by).agg(F.sum("n").alias("total"), agree.alias("agree"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("confusion"))
    return sums.withColumn("rate", F.try_divide("agree", "total"))


def type_counts(spans: DataFrame, listed: list[str], kind: str = "type") -> DataFrame:
    """Spans by type: the listed types, 0 where there are none, and others as they are found."""
    zero = spans.sparkSession.createDataFrame([(x, 0) for x in listed], f"{kind} string, n long")
    return spans.groupBy(kind).agg(F.count("*").alias("n")).unionByName(zero).groupBy(kind).agg(F.sum("n").alias("n"))


def label_columns(spans: DataFrame, by: list[str], labels: list[str], label: str = "label") -> DataFrame:
    """A count for each listed label, ``other`` for the rest, and ``shown``, the sum of the listed."""
    count = lambda where, name: F.count_if(F.coalesce(where, F.lit(False))).alias(name)
    known = F.coalesce(F.col(label).isin(labels), F.lit(False))
    return spans.groupBy(*by).agg(*(count(F.col(label) == x, x) for x in labels), count(~known, "other"), count(known, "shown"))
