"""Which items are still to do, and merging of old and new results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def is_error(answer: Column) -> Column:
    return F.coalesce(F.startswith(answer, F.lit("ERROR")), F.lit(False))


def blank_or_error(answer: Column) -> Column:
    return (strip(F.coalesce(answer, F.lit(""))) == "") | is_error(answer)


def todo(items: DataFrame, done: DataFrame, policy: str = "any", key: str = "id") -> DataFrame:
    """Items not done. any: an id that is there is done; drop_errors: error answers are done again;
    blank_or_error: blank ones too; missing_label: without a category; typology: without spans or
    with an error, unless the header says complete (column ``complete``); typology_retry: whatever the
    header says, so that failures of a complete run are done again."""
    finished = {
        "any": lambda d: d,
        "drop_errors": lambda d: d.where(~is_error(F.col("answer"))),
        "blank_or_error": lambda d: d.where(~blank_or_error(F.col("answer"))),
        "missing_label": lambda d: d.where("category is not null"),
        "typology_retry": lambda d: d.where("has_spans and coalesce(error, '') = ''"),
        "typology": lambda d: d.where("complete or (has_spans and coalesce(error, '') = '')"),
    }[policy](done)
    return items.join(finished.select(key), key, "left_anti")


def merge_latest(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One record for each id, the newest."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc("age"))
    return both.withColumn("rank", F.row_number().over(latest)).where("rank = 1").drop("rank", "age")


def merge_in_order(questions: DataFrame, old: DataFrame, new: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """``merge_latest`` in the questions' order; results of no question and questions without a result go."""
    return questions.select(place, key).join(merge_latest(old, new, key), key).orderBy(place)
