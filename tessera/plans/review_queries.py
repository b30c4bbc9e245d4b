"""The review tool's tables, over events as spans (a user is a prompt, an event a span)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import review
from .registry import query, table, texts

_RV = """rv AS (SELECT user_id::VARCHAR AS prompt_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS span_idx, event_id,
  CASE WHEN event_id % 2 = 0 THEN 'quran' ELSE 'hadith_matn' END AS type, props AS text, (event_id % 50)::INTEGER AS start, (event_id % 50 + 9)::INTEGER AS stop, event_id % 10 = 0 AS added FROM events)"""


def rows(spark, sf_dir):
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("span_idx")
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("prompt_id"), place, F.when(e % 2 == 0, "quran").otherwise("hadith_matn").alias("type"), F.col("props").alias("text"), (e % 50).cast("int").alias("start"), (e % 50 + 9).cast("int").alias("end"), F.lit("pending").alias("status"), (e % 10 == 0).alias("added"), "event_id")


@query("SELECT event_id, event_id::VARCHAR AS prompt_id, i AS span_idx, CASE WHEN i = 1 THEN 'hadith_matn' ELSE 'quran' END AS type, CASE WHEN i = 0 THEN event_type ELSE '' END AS text, CASE WHEN i = 0 THEN 3 END::INTEGER AS start, CASE WHEN i = 0 THEN 'pending' ELSE 'correct' END AS status FROM events, (VALUES (0), (1)) AS x(i)")
def review_import(spark, sf_dir):
    """One annotation document for each event, flat or grouped, bare or in an array."""
    e = F.col("event_id")
    span = lambda owner, k: F.struct(*([e.cast("string").alias("id")] if owner else []), F.lit(("q", "h")[k]).alias("type"), (F.col("event_type") if k == 0 else F.lit(None)).alias("text"), F.lit((3, None)[k]).cast("int").alias("start"), F.lit((None, "correct")[k]).cast("string").alias("status"))
    flat = F.struct(F.array(span(True, 0), span(True, 1)).alias("spans"))
    grouped = F.struct(e.cast("string").alias("prompt_id"), F.array(span(False, 0), span(False, 1)).alias("spans"))
    value = F.when(e % 3 == 0, F.to_json(flat)).when(e % 3 == 1, F.to_json(F.array(grouped))).otherwise(F.to_json(grouped))
    found = review.spans_of(table(spark, sf_dir, "events").select("event_id", value.alias("value")))
    return found.select("event_id", "prompt_id", "span_idx", "type", "text", "start", "status")


@query(f"WITH {_RV} SELECT event_id, a.event_type AS answer FROM rv LEFT JOIN (SELECT user_id::VARCHAR AS prompt_id, max_by(event_type, event_id) AS event_type FROM events WHERE user_id % 3 <> 0 GROUP BY user_id) a USING (prompt_id)")
def review_join(spark, sf_dir):
    found = table(spark, sf_dir, "events").where("user_id % 3 <> 0").select(F.col("user_id").cast("string").alias("prompt_id"), F.col("event_type").alias("answer"), F.col("event_id").alias("seq"))
    return review.with_answers(rows(spark, sf_dir), found, "seq").select("event_id", "answer")


@query(f"WITH {_RV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'reject' ELSE 'pending' END AS status, CASE WHEN event_id % 4 = 1 THEN 'hadith_isnad' ELSE type END AS type FROM rv")
def review_mark(spark, sf_dir):
    spans = rows(spark, sf_dir)
    decided = spans.where("event_id % 4 < 2").select("prompt_id", "span_idx", F.when(F.col("event_id") % 4 == 0, "correct").otherwise("reject").alias("new_status"), F.when(F.col("event_id") % 4 == 1, "hadith_isnad").alias("new_type"))
    return review.mark(spans, decided).select("event_id", "status", "type")


@query(f"WITH {_RV}, al AS (SELECT prompt_id, span_idx, 0 AS later, type, status FROM (SELECT *, 'pending' AS status FROM rv) UNION ALL SELECT prompt_id, span_idx, 2 - (k - 1), 'quran', 'correct' FROM rv, (VALUES (1), (2)) AS x(k) WHERE event_id % 5 = 0) SELECT prompt_id, (row_number() OVER (PARTITION BY prompt_id ORDER BY span_idx, later) - 1)::INTEGER AS span_idx, type, status FROM al")
def review_add(spark, sf_dir):
    spans = rows(spark, sf_dir).drop("event_id")
    new = rows(spark, sf_dir).where("event_id % 5 = 0").select("prompt_id", F.col("span_idx").alias("after_idx"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.lit("quran").alias("type"), "text", "start", "end")
    return review.add(spans, new).select("prompt_id", "span_idx", "type", "status")


@query(f"WITH {_RV} SELECT prompt_id AS id, count(*) AS n, string_agg(type || ':' || CASE WHEN event_id % 6 = 0 THEN 'fixed' ELSE event_id::VARCHAR END || ':' || CASE WHEN event_id % 6 = 0 THEN 7 ELSE start END || ':' || CASE WHEN added THEN 'true' ELSE '' END, '|' ORDER BY span_idx) AS spans FROM rv GROUP BY prompt_id")
def review_export(spark, sf_dir):
    spans = rows(spark, sf_dir).withColumn("text", F.col("event_id").cast("string")).withColumn("corrected_text", F.when(F.col("event_id") % 6 == 0, "fixed")).withColumn("corrected_start", F.when(F.col("event_id") % 6 == 0, 7))
    line = lambda s: F.concat_ws(":", s["type"], s["text"], s["start"].cast("string"), F.coalesce(s["added"].cast("string"), F.lit("")))
    return review.export(spans).select("id", F.size("spans").cast("long").alias("n"), F.array_join(F.transform("spans", line), "|").alias("spans"))


@query("SELECT doc_id AS id, substring(text, 4, 12) = substring(text, 4 + (doc_id % 2)::INTEGER, 12) AS same FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9]', 'x', 'g') AS text FROM documents) WHERE length(text) >= 15")
def match_pill(spark, sf_dir):
    """Slices against texts that differ in outer white space, and in every other row by a shift."""
    plain = texts(spark, sf_dir).select("id", F.regexp_replace("text", "[^a-zA-Z0-9]", "x").alias("t")).where("length(t) >= 15")
    shown = F.concat(F.lit("  "), F.substring(F.col("t"), (F.col("id") % 2 + 4).cast("int"), F.lit(12)), F.lit("\n"))
    return plain.select("id", review.matches(F.col("t"), F.lit(3), F.lit(15), shown).alias("same"))


@query("SELECT item_id, 'ab' || chr(1600) || text AS shown FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 2 = 1")
def strip_diacritics_js(spark, sf_dir):
    """The review tool's class takes marks and Arabic digits and leaves the tatweel."""
    marked = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("aًbِ٠ـۖ"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", tx.without_marks(marked).alias("shown"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END::INTEGER AS label FROM events")
def parse_binary(spark, sf_dir):
    token = F.when(F.col("event_id") % 4 == 0, "1").when(F.col("event_id") % 4 == 1, "0").when(F.col("event_id") % 4 == 2, "10")
    return table(spark, sf_dir, "events").select("event_id", tx.binary_label(token).alias("label"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 50 END, event_id) AS ids FROM events GROUP BY user_id")
def sorted_spans(spark, sf_dir):
    """Spans of a prompt by start; a missing start counts as 0, ties stay in order."""
    one = F.struct(F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50), F.lit(0)).alias("by"), "event_id")
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return grouped.select("user_id", F.array_join(F.transform("x", lambda r: r["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT doc_id AS id, left(text, 10) AS head, right(text, 10) AS tail FROM documents")
def boundary_preview(spark, sf_dir):
    return texts(spark, sf_dir).select("id", *review.preview(F.col("text")))
