"""Tables of the span review: import, decisions, added spans, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .spans import norm_type

SPAN = "id string, prompt_id string, type string, text string, start int, `end` int, status string, added boolean"
ENTRY = f"id string, prompt_id string, spans array<struct<{SPAN}>>"


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def spans_of(documents: DataFrame) -> DataFrame:
    """Review spans of annotation documents (column ``value``). Flat: an object whose first span has an
    id; each span names its prompt. Grouped: entries with spans, one or an array. Types are canonical,
    a missing status is 'pending', a missing text empty; places count within a document or an entry."""
    value = F.trim("value")
    one = F.from_json(F.when(F.startswith(value, F.lit("{")), value), ENTRY)
    many = F.from_json(F.when(F.startswith(value, F.lit("[")), value), f"array<struct<{ENTRY}>>")
    kept = [c for c in documents.columns if c != "value"]
    flat = F.get_json_object(value, "$.spans[0].id").isNotNull()
    parsed = documents.select(*kept, F.coalesce(flat, F.lit(False)).alias("flat"), F.explode(F.coalesce(many, F.array(one))).alias("entry"))
    each = parsed.select(*kept, "flat", "entry", F.posexplode("entry.spans").alias("span_idx", "s"))
    owner = lambda x: F.coalesce(_filled(x["id"]), x["prompt_id"])
    s = F.col("s")
    return each.select(*kept, F.when(F.col("flat"), owner(s)).otherwise(owner(F.col("entry"))).alias("prompt_id"), "span_idx", norm_type(s["type"]).alias("type"), F.coalesce(s["text"], F.lit("")).alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(_filled(s["status"]), F.lit("pending")).alias("status"), F.coalesce(s["added"], F.lit(False)).alias("added"))


def with_answers(spans: DataFrame, answers: DataFrame, order: str) -> DataFrame:
    """Spans beside their answers; of several answers to a prompt the last by ``order``; none: nulls."""
    names = [c for c in answers.columns if c not in ("prompt_id", order)]
    last = answers.groupBy("prompt_id").agg(F.max_by(F.struct(*names), order).alias("a"))
    return spans.join(last, "prompt_id", "left").select(*spans.columns, *(F.col(f"a.{n}").alias(n) for n in names))


def mark(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans with the status (and type, where given) that was decided: decisions are (prompt_id,
    span_idx, new_status, new_type), one for a span."""
    joined = spans.join(decisions, ["prompt_id", "span_idx"], "left")
    return joined.withColumn("status", F.coalesce("new_status", "status", F.lit("pending"))).withColumn("type", F.coalesce(norm_type(F.col("new_type"), None), "type")).select(*spans.columns)


def add(spans: DataFrame, added: DataFrame) -> DataFrame:
    """Spans with new ones (``after_idx``: the place they follow), correct and added, places counted
    anew. Several after one place: the later one (``seq``) stands first, as each is put right after it."""
    new = added.withColumn("status", F.lit("correct")).withColumn("added", F.lit(True))
    columns = [c for c in spans.columns if c != "span_idx"]
    both = spans.select(*columns, F.col("span_idx").alias("place"), F.lit(None).cast("long").alias("seq")).unionByName(new.select(*columns, F.col("after_idx").alias("place"), F.col("seq").cast("long").alias("seq")))
    order = Window.partitionBy("prompt_id").orderBy("place", F.desc_nulls_first("seq"))
    return both.withColumn("span_idx", F.row_number().over(order) - 1).select(*spans.columns)


def matches(answer: Column, start: Column, end: Column, text: Column) -> Column:
    """Whether the slice is the span's text, but for white space and diacritics; null without one."""
    plain = lambda t: tx.without_marks(tx.collapsed(t))
    good = (start >= 0) & (end > start) & (end <= F.length(answer))
    return F.when(good, plain(F.substring(answer, (start + 1).cast("int"), (end - start).cast("int"))) == plain(text))


def export(spans: DataFrame) -> DataFrame:
    """(id, spans) for each prompt, corrected fields first, in order of place."""
    fixed = lambda c: F.coalesce(f"corrected_{c}", c) if f"corrected_{c}" in spans.columns else F.col(c)
    one = F.struct(F.col("span_idx"), F.struct("type", fixed("text").alias("text"), fixed("start").alias("start"), fixed("end").alias("end"), "status", F.when(F.col("added"), True).alias("added")).alias("span"))
    rows = spans.groupBy(F.col("prompt_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    return rows.select("id", F.transform("x", lambda r: r["span"]).alias("spans"))


def preview(text: Column, size: int = 10) -> tuple[Column, Column]:
    """(head, tail): the first and the last ``size`` characters."""
    return F.left(text, F.lit(size)).alias("head"), F.right(text, F.lit(size)).alias("tail")


def search(rows: DataFrame, word: str | None, columns: list[str]) -> DataFrame:
    """Rows that have ``word`` in one of the columns, whatever its case and outer white space; all rows
    for an empty one."""
    wanted = (word or "").strip().lower()
    if not wanted:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted)), F.lit(False))
    return rows.where(hit)
