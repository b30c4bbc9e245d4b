"""Span repair, replies and the review tool over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import review
from ..operators import spans as sp
from .registry import answers, query, table, texts

#: Derived spans: three words from the fifth on as head, three from the eleventh as tail, rough offsets.
_A = "a AS (SELECT doc_id AS id, text AS t, length(text)::INTEGER AS n, string_split(text, ' ') AS w FROM documents), s AS (SELECT id, t, n, coalesce(array_to_string(w[5:7], ' '), '') AS head, coalesce(array_to_string(w[11:13], ' '), '') AS tail, (id * 7 % greatest(n, 1))::INTEGER AS h, (id * 7 % greatest(n, 1))::INTEGER + 40 AS e FROM a)"


def hinted(spark, sf_dir):
    rows = texts(spark, sf_dir).select("id", F.col("text").alias("t"), F.length("text").alias("n"), F.split("text", " ").alias("w"))
    h = F.expr("cast(id * 7 % greatest(n, 1) as int)")
    part = lambda i: F.array_join(F.slice("w", i, 3), " ")
    return rows.select("id", "t", "n", part(5).alias("head"), part(11).alias("tail"), h.alias("h"), (h + 40).alias("e"))


def _occ(text: str, needle: str) -> str:
    return f"CASE WHEN {needle} = '' OR NOT contains({text}, {needle}) THEN [] ELSE list_filter(range(0, length({text}) - length({needle}) + 1), lambda i: substring({text}, i + 1, length({needle})) = {needle}) END"


def _near(places: str, hint: str) -> str:
    return f"list_min(list_transform({places}, lambda p: {{'d': abs(p - {hint}), 'p': p}})).p"


@query(f"WITH {_A} SELECT id, len(o)::INTEGER AS n_found, o[1]::INTEGER AS first_found FROM (SELECT id, {_occ('t', 'head')} AS o FROM s)")
def occurrences(spark, sf_dir):
    found = hinted(spark, sf_dir).select("id", tx.occurrences(F.col("t"), F.col("head")).alias("o"))
    return found.select("id", F.size("o").alias("n_found"), F.get("o", F.lit(0)).alias("first_found"))


@query(f"""WITH {_A}, o AS (SELECT id, head, t, h, {_occ('t', 'head')} AS o FROM s)
SELECT id, {_near('o', 'h')}::INTEGER AS start, ({_near('o', 'h')} + length(head))::INTEGER AS stop FROM o WHERE head <> '' AND len(o) > 0""")
def fix_span_indices(spark, sf_dir):
    span = F.struct(F.lit("Quran").alias("type"), F.col("head").alias("text"), F.col("h").alias("start"), F.col("e").alias("end"))
    fixed = hinted(spark, sf_dir).select("id", F.explode(sp.fix_indices(F.col("t"), F.array(span))).alias("s"))
    return fixed.select("id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(f"""WITH {_A}, o AS (SELECT *, {_near('(' + _occ('t', 'head') + ')', 'h')} AS st, list_transform({_occ('t', 'tail')}, lambda p: p + length(tail)) AS te FROM s),
  p AS (SELECT *, list_filter(te, lambda x: x - length(tail) >= st) AS af FROM o),
  q AS (SELECT *, CASE WHEN tail = '' OR tail = head THEN st + length(head) ELSE {_near('(CASE WHEN len(af) > 0 THEN af ELSE te END)', 'e')} END AS en FROM p)
SELECT id, (CASE WHEN coalesce(en > st, false) THEN st ELSE h END)::INTEGER AS start, (CASE WHEN coalesce(en > st, false) THEN en ELSE e END)::INTEGER AS stop, coalesce(en > st, false) AS verified,
  CASE WHEN NOT coalesce(en > st, false) THEN 'model' WHEN st = h AND en = e THEN 'model_ok' ELSE 'snapped' END AS source FROM q""")
def snap_spans(spark, sf_dir):
    snapped = hinted(spark, sf_dir).select("id", sp.snap(F.col("t"), F.col("head"), F.col("tail"), F.col("h"), F.col("e")).alias("s"))
    return snapped.select("id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.verified").alias("verified"), F.col("s.source").alias("source"))


@query("""WITH x AS (SELECT doc_id AS id, text AS t, length(text) AS n, doc_id % 13 - 6 AS s, doc_id % 29 - 9 AS e FROM documents),
  b AS (SELECT id, t, CASE WHEN s < 0 THEN greatest(n + s, 0) ELSE least(s, n) END AS s, CASE WHEN e < 0 THEN greatest(n + e, 0) ELSE least(e, n) END AS e FROM x)
SELECT id, substring(t, s + 1, greatest(e - s, 0)) AS part FROM b""")
def py_slice(spark, sf_dir):
    return texts(spark, sf_dir).select("id", tx.py_slice(F.col("text"), F.col("id") % 13 - 6, F.col("id") % 29 - 9).alias("part"))


@query(f"WITH {_A} SELECT id, CASE WHEN head <> '' AND tail <> '' AND head <> tail THEN head || ' .... ' || tail WHEN head <> '' THEN head ELSE tail END AS snippet FROM s")
def snippet(spark, sf_dir):
    return hinted(spark, sf_dir).select("id", tx.snippet(F.col("head"), F.col("tail")).alias("snippet"))


@query(f"""WITH {_A} SELECT id, 'Reference' || CASE WHEN id % 3 = 0 THEN '/Correct' WHEN id % 3 = 1 THEN '/Incorrect' ELSE '' END || '  «' || head || '»  [' || h || ':' || e || ']' AS shown FROM s""")
def format_span(spark, sf_dir):
    label = F.when(F.col("id") % 3 == 0, "Correct").when(F.col("id") % 3 == 1, "Incorrect").otherwise("NA")
    return hinted(spark, sf_dir).select("id", sp.format_span(F.lit("Reference"), label, F.col("head"), F.col("h"), F.col("e")).alias("shown"))


@query(f"""WITH {_A} SELECT id, CASE WHEN id % 10 = 0 THEN 'ERROR: timeout' WHEN id % 10 = 1 THEN '(no citations)'
  WHEN h <= 30 THEN '1. Quran  «' || head || '»  [' || h || ':' || e || ']' || chr(10) || '2. Reference  «' || tail || '»  [30:60]' ELSE '1. Reference  «' || tail || '»  [30:60]' || chr(10) || '2. Quran  «' || head || '»  [' || h || ':' || e || ']' END AS cell FROM s""")
def citations_cell(spark, sf_dir):
    span = lambda kind, text, a, b: F.struct(F.lit(kind).alias("type"), F.lit("NA").alias("label"), text.alias("text"), a.alias("start"), b.alias("end"))
    both = F.array(span("Quran", F.col("head"), F.col("h"), F.col("e")), span("Reference", F.col("tail"), F.lit(30), F.lit(60)))
    spans = F.when(F.col("id") % 10 != 1, both)
    return hinted(spark, sf_dir).select("id", sp.citations_cell(spans, F.when(F.col("id") % 10 == 0, "ERROR: timeout")).alias("cell"))


@query(f"""WITH {_A} SELECT id, CASE WHEN h >= 0 AND e > h AND e <= n THEN substring(t, 1, h) ELSE t END AS before, CASE WHEN h >= 0 AND e > h AND e <= n THEN substring(t, h + 1, e - h) ELSE '' END AS marked,
  CASE WHEN h >= 0 AND e > h AND e <= n THEN substring(t, e + 1, n - e) ELSE '' END AS after FROM s""")
def highlight_split(spark, sf_dir):
    return hinted(spark, sf_dir).select("id", sp.highlight(F.col("t"), F.col("h"), F.col("e")).alias("x")).select("id", "x.*")


@query(f"WITH {_A} SELECT id, (strpos(t, head) - 1)::INTEGER AS start, (strpos(t, head) - 1 + length(head))::INTEGER AS stop FROM s WHERE head <> '' AND contains(t, head)")
def search_fallback(spark, sf_dir):
    """Exact places; the fallback over diacritics is held against a model in the tests."""
    found = hinted(spark, sf_dir).select("id", tx.stripped_search(F.col("t"), F.col("head")).alias("x"))
    return found.where("x is not null").select("id", "x.*")


_TYPES = "(VALUES (0, 'quran'), (1, 'q'), (2, 'hadith_matn'), (3, 'h'), (4, 'claimed_source'), (5, 'Source'), (6, NULL)) AS v(k, kind)"


@query(f"SELECT doc_id AS id, kind, CASE kind WHEN 'h' THEN 'hadith_matn' WHEN 'hadith_matn' THEN 'hadith_matn' WHEN 'claimed_source' THEN kind ELSE 'quran' END AS norm_type FROM documents JOIN {_TYPES} ON doc_id % 7 = k")
def norm_type(spark, sf_dir):
    kinds = spark.createDataFrame([(0, "quran"), (1, "q"), (2, "hadith_matn"), (3, "h"), (4, "claimed_source"), (5, "Source"), (6, None)], "k int, kind string")
    rows = texts(spark, sf_dir).select("id", (F.col("id") % 7).cast("int").alias("k")).join(kinds, "k")
    return rows.select("id", "kind", sp.norm_type(F.col("kind")).alias("norm_type"))


_REPLY = """r AS (SELECT event_id, props, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Sure: ' || props || ' done' WHEN 3 THEN props || ']' WHEN 4 THEN '' ELSE 'no json' END AS reply FROM events)"""


@query(f"WITH {_REPLY} SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN props END AS json FROM r")
def parse_json(spark, sf_dir):
    k, props = F.col("event_id") % 6, F.col("props")
    reply = F.when(k == 0, props).when(k == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), props, F.lit(" done"))).when(k == 3, F.concat(props, F.lit("]"))).when(k == 4, F.lit("")).otherwise("no json")
    return table(spark, sf_dir, "events").select("event_id", tx.find_json(reply).alias("json"))


@query("SELECT doc_id AS id, trim(CASE WHEN doc_id % 2 = 0 THEN text ELSE '<think>' || text END, ' ' || chr(9) || chr(10) || chr(13)) AS shown FROM documents")
def strip_think(spark, sf_dir):
    t = F.col("text")
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<think>a\nb</think> "), t)).otherwise(F.concat(F.lit("<think>"), t))
    return texts(spark, sf_dir).select("id", tx.strip_think(raw).alias("shown"))


@query(r"SELECT doc_id AS id, regexp_replace(regexp_replace(chr(160) || text || ' ' || chr(10), '^[\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '') AS stripped FROM documents")
def strip_text(spark, sf_dir):
    return texts(spark, sf_dir).select("id", tx.strip(F.concat(F.lit(" "), F.col("text"), F.lit(" \n"))).alias("stripped"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown FROM (SELECT page_id, replace(html, '**', '') AS html FROM pages)")
def render_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.render_html(F.replace("html", F.lit("**"), F.lit(""))).alias("shown"))


@query("SELECT page_id, regexp_replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(page)', '<mark>\\1</mark>', 'gi') AS shown FROM (SELECT page_id, replace(html, '**', '') AS html FROM pages)")
def highlight_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.highlighted(tx.render_html(F.replace("html", F.lit("**"), F.lit(""))), "PAGE").alias("shown"))


@query("SELECT doc_id AS id, array_to_string(CASE WHEN len(w) > 50 THEN w[len(w)-49:len(w)] ELSE w END, ' ') AS tail FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def left_truncate(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(tx.keep_tail(F.split("text", " "), 50), " ").alias("tail"))


@query("SELECT doc_id AS id, 'Annotate this answer.' || chr(10) || '<<<' || chr(10) || text || chr(10) || '>>>' AS message FROM documents")
def build_user_prompt(spark, sf_dir):
    return answers(spark, sf_dir).select("id", F.concat(F.lit("Annotate this answer.\n<<<\n"), "answer", F.lit("\n>>>")).alias("message"))


@query("""SELECT doc_id AS id, CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 2 END AS n_messages, CASE WHEN source IN ('src1', 'src2') THEN 'Be brief.' || chr(10) || chr(10) || text ELSE text END AS last_content FROM documents""")
def chat_messages(spark, sf_dir):
    """System and user turns; one folded user turn for models without a system role."""
    folded = F.col("model").isin("src1", "src2")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.when(folded, F.array(turn("user", F.concat(F.lit("Be brief.\n\n"), "answer")))).otherwise(F.array(turn("system", F.lit("Be brief.")), turn("user", F.col("answer"))))
    return answers(spark, sf_dir).select("id", messages.alias("m")).select("id", F.size("m").alias("n_messages"), F.element_at("m", -1)["content"].alias("last_content"))


@query("SELECT doc_id AS id, source AS model FROM documents WHERE contains(lower(text), 'license') OR contains(doc_id::VARCHAR, 'license') OR contains(lower(lang), 'license')")
def search_answers(spark, sf_dir):
    return review.search(answers(spark, sf_dir), " License ", ["id", "prompt", "answer"]).select("id", "model")


@query("SELECT doc_id AS id, source AS model FROM documents")
def search_nothing(spark, sf_dir):
    return review.search(answers(spark, sf_dir), "  ", ["id", "prompt", "answer"]).select("id", "model")


_REVIEW = "rv AS (SELECT event_id, user_id AS prompt_id, CASE event_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'reject' END AS status FROM events)"


@query(f"WITH {_REVIEW} SELECT prompt_id, count(*) AS spans, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'reject') AS reject, count(*) FILTER (status IS NULL) AS pending FROM rv GROUP BY prompt_id")
def review_progress(spark, sf_dir):
    status = F.when(F.col("event_id") % 4 == 0, "correct").when(F.col("event_id") % 4 == 1, "reject").otherwise("pending")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("prompt_id"), status.alias("status"))
    return rows.groupBy("prompt_id").agg(F.count("*").alias("spans"), *(F.count_if(F.col("status") == s).alias(s) for s in ("correct", "reject", "pending")))


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
def review_neighbors(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(order).alias("before"), F.lead("turn").over(order).alias("after"))
