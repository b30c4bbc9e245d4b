"""Repair and display of citation spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

#: Aliases of span types; anything else is a verse.
TYPES = {"quran": "quran", "q": "quran", "hadith_matn": "hadith_matn", "h": "hadith_matn", "hadith_isnad": "hadith_isnad", "claimed_source": "claimed_source"}


def norm_type(kind: Column, fallback: str | None = "quran") -> Column:
    """Canonical type; unknown ones get the fallback (None: stay null, the strict form)."""
    table = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    known = F.try_element_at(table, F.coalesce(kind, F.lit("")))
    return F.coalesce(known, F.lit(fallback)) if fallback else known


def fix_indices(answer: Column, spans: Column) -> Column:
    """Spans (type, text, start, end) whose offsets hold their text: kept if exact, else moved to the
    occurrence nearest to the start, dropped without one or with an empty text. Missing type: 'q';
    missing offsets: 0."""

    def one(s):
        start, end, text = F.coalesce(s["start"], F.lit(0)), F.coalesce(s["end"], F.lit(0)), s["text"]
        exact = tx.py_slice(answer, start, end) == text
        moved = lambda at: F.when(at.isNotNull(), F.struct(at.cast("int").alias("start"), (at + F.length(text)).cast("int").alias("end")))
        place = F.when(exact, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).otherwise(tx.let(tx.nearest(tx.occurrences(answer, text), start), moved))
        whole = lambda p: F.when(p.isNotNull(), F.struct(F.coalesce(s["type"], F.lit("q")).alias("type"), text.alias("text"), p["start"].alias("start"), p["end"].alias("end")))
        return F.when(F.coalesce(text, F.lit("")) != "", tx.let(place, whole))

    return F.filter(F.transform(spans, one), lambda s: s.isNotNull())


def snap(answer: Column, head: Column, tail: Column, hint_start: Column, hint_end: Column) -> Column:
    """(start, end, verified, source) of a span given by its first and last words and rough offsets.

    Head: the occurrence nearest to the hinted start. Tail: of its occurrences from the head on, or
    else of all, the one whose end is nearest to the hinted end. No tail, or the same words: the
    head alone. Not found, or empty: unverified with the hints as they are."""
    head, tail = F.coalesce(head, F.lit("")), F.coalesce(tail, F.lit(""))
    ends = F.transform(tx.occurrences(answer, tail), lambda p: p + F.length(tail))

    def with_start(start):
        after = lambda tails: tx.let(F.filter(tails, lambda p: p - F.length(tail) >= start), lambda some: F.when(F.size(some) > 0, some).otherwise(tails))
        end = F.when((tail == "") | (tail == head), start + F.length(head)).otherwise(tx.let(ends, lambda tails: tx.nearest(after(tails), hint_end)))
        return tx.let(end, lambda end: placed(start, end))

    def placed(start, end):
        good = F.coalesce(end > start, F.lit(False))
        same = (start == hint_start) & (end == hint_end)
        source = F.when(~good, "model").when(same, "model_ok").otherwise("snapped")
        pick = lambda a, b: F.when(good, a).otherwise(b).cast("int")
        return F.struct(pick(start, hint_start).alias("start"), pick(end, hint_end).alias("end"), good.alias("verified"), source.alias("source"))

    return tx.let(tx.nearest(tx.occurrences(answer, head), hint_start), with_start)


def format_span(kind: Column, label: Column, text: Column, start: Column, end: Column) -> Column:
    """type[/label]  «text»  [s:e]; the label for Correct and Incorrect only."""
    shown = F.when(label.isin("Correct", "Incorrect"), F.concat(F.lit("/"), label)).otherwise(F.lit(""))
    return F.concat(kind, shown, F.lit("  «"), text, F.lit("»  ["), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("]"))


def citations_cell(spans: Column, error: Column) -> Column:
    """The error, or '(no citations)', or the spans by start, numbered, one to a line."""
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(F.coalesce(s["start"], F.lit(0)).alias("by"), i.alias("i"), s.alias("s"))))
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), format_span(x["s"]["type"], x["s"]["label"], x["s"]["text"], x["s"]["start"], x["s"]["end"]))
    return F.when(F.coalesce(error, F.lit("")) != "", error).when(F.coalesce(F.size(spans), F.lit(0)) <= 0, "(no citations)").otherwise(F.array_join(F.transform(ordered, line), "\n"))


def highlight(text: Column, start: Column, end: Column) -> Column:
    """(before, marked, after); all before where the offsets aren't a range of the text."""
    good = F.coalesce((start >= 0) & (end > start) & (end <= F.length(text)), F.lit(False))
    part = lambda a, n: F.substring(text, a.cast("int"), n.cast("int"))
    return F.struct(F.when(good, part(F.lit(1), start)).otherwise(text).alias("before"), F.when(good, part(start + 1, end - start)).otherwise("").alias("marked"), F.when(good, part(end + 1, F.length(text) - end)).otherwise("").alias("after"))
