"""Passages of benchmark items in documents, under the Latin normaliser."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as cp
from .registry import corpus, query, table, texts

LATIN = tx.LATIN
_WORDS = r"list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_GRAMS = "CASE WHEN len({0}) >= 4 THEN list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i:i+3], ' ')) ELSE [] END"
_DOC = f"""w AS (SELECT doc_id AS id, {_WORDS.format('text')} AS l FROM documents),
  g AS (SELECT id, unnest(gs) AS gram, unnest(range(0, len(gs))) AS pos FROM (SELECT id, {_GRAMS.format('l')} AS gs FROM w)),
  cw AS (SELECT item_id, {_WORDS.format('text')} AS l FROM benchmark),
  ref AS (SELECT gram, max(CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END) AS is_q, max(CASE WHEN item_id % 2 = 1 THEN 1 ELSE 0 END) AS is_h
          FROM (SELECT item_id, unnest({_GRAMS.format('l')}) AS gram FROM cw) GROUP BY gram),
  tag AS (SELECT id, pos, gram, CASE WHEN is_q = 1 THEN 'q' ELSE 'h' END AS tag FROM g JOIN ref USING (gram)),
  run AS (SELECT id, tag, min(pos) AS first, count(*) AS n, count(*) + 3 AS words FROM (SELECT *, pos - row_number() OVER (PARTITION BY id, tag ORDER BY pos) AS isl FROM tag) GROUP BY id, tag, isl)"""


def reference(spark, sf_dir):
    return cp.corpus_grams(corpus(spark, sf_dir), LATIN)


def tagged(spark, sf_dir):
    return cp.tag_grams(cp.grams(texts(spark, sf_dir), LATIN), reference(spark, sf_dir))


@query(f"WITH {_DOC} SELECT id, sum(CASE WHEN tag = 'q' THEN 1 ELSE 0 END)::BIGINT AS q_passages, sum(CASE WHEN tag = 'h' THEN 1 ELSE 0 END)::BIGINT AS h_passages, sum(words)::BIGINT AS covered FROM run WHERE words >= 6 GROUP BY id")
def passage_scan(spark, sf_dir):
    return cp.passage_scan(texts(spark, sf_dir), reference(spark, sf_dir), LATIN)


@query(f"WITH {_DOC} SELECT id, pos, gram FROM g")
def kgrams(spark, sf_dir):
    return cp.grams(texts(spark, sf_dir), LATIN)


@query(f"WITH {_DOC} SELECT gram, is_q, is_h FROM ref")
def distinct_grams(spark, sf_dir):
    return reference(spark, sf_dir)


@query(f"WITH {_DOC} SELECT id, pos, gram, tag FROM tag")
def tag_grams(spark, sf_dir):
    return tagged(spark, sf_dir)


@query(f"WITH {_DOC} SELECT id, tag, first, n, words FROM run")
def tag_runs(spark, sf_dir):
    return cp.tag_runs(tagged(spark, sf_dir))


@query(f"""WITH {_DOC}, hit AS (SELECT id, pos FROM g JOIN ref USING (gram) WHERE is_h = 1),
  r AS (SELECT id, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS isl FROM hit) GROUP BY id, isl)
SELECT w.id, coalesce(max(r.n), 0) AS longest FROM w LEFT JOIN r USING (id) GROUP BY w.id""")
def longest_run(spark, sf_dir):
    return cp.longest_run(texts(spark, sf_dir), reference(spark, sf_dir), "h", LATIN)


@query(f"WITH {_DOC} SELECT DISTINCT tag.id, tag.tag, tag.gram FROM tag JOIN run ON run.id = tag.id AND run.tag = tag.tag AND tag.pos >= run.first AND tag.pos < run.first + run.n WHERE run.words >= 6")
def region_gold(spark, sf_dir):
    return cp.region_gold(texts(spark, sf_dir), reference(spark, sf_dir), LATIN)


@query(f"""WITH {_DOC}, d AS (SELECT DISTINCT id, gram FROM g)
SELECT id, count(*) AS grams, count(is_q) AS shared FROM d LEFT JOIN ref USING (gram) GROUP BY id""")
def gram_intersect(spark, sf_dir):
    own = cp.grams(texts(spark, sf_dir), LATIN).select("id", "gram").distinct()
    return own.join(reference(spark, sf_dir), "gram", "left").groupBy("id").agg(F.count("*").alias("grams"), F.count("is_q").alias("shared"))


@query(f"SELECT source, sum(len({_WORDS.format('text')}))::BIGINT AS words FROM documents GROUP BY source")
def word_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(F.size(tx.tokens(tx.norm(F.col("text"), LATIN)))).cast("long").alias("words"))


#: Spans derived from documents: the first five words of every text, typed by the id.
_SPANS = f"sp AS (SELECT doc_id AS id, array_to_string((string_split(text, ' '))[2:6], ' ') AS span FROM documents)"


def spans(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(F.slice(F.split("text", " "), 2, 5), " ").alias("text"))


def _exact_sql(parity: int, across: bool) -> str:
    own = f"SELECT item_id, array_to_string({_WORDS.format('text')}, ' ') AS r FROM benchmark WHERE item_id % 2 = {parity}"
    records = f"SELECT string_agg(r, ' ' ORDER BY item_id) AS r FROM ({own})" if across else f"SELECT r FROM ({own})"
    return f"""WITH {_DOC}, {_SPANS}, sw AS (SELECT id, {_WORDS.format('span')} AS l FROM sp), rec AS ({records}),
  sg AS (SELECT id, unnest(gs) AS gram, unnest(range(0, len(gs))) AS pos FROM (SELECT id, {_GRAMS.format('l')} AS gs FROM sw)),
  hit AS (SELECT sg.id, pos FROM sg JOIN ref USING (gram) WHERE {'is_q' if parity == 0 else 'is_h'} = 1),
  rn AS (SELECT id, max(n) AS n FROM (SELECT id, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS isl FROM hit) GROUP BY id, isl) GROUP BY id)
SELECT sw.id, coalesce(rn.n, 0) >= 3 OR (len(l) >= 2 AND EXISTS (SELECT 1 FROM rec WHERE contains(rec.r, array_to_string(l, ' ')))) AS exact FROM sw LEFT JOIN rn USING (id)"""


@query(_exact_sql(0, True))
def exact_concat(spark, sf_dir):
    return cp.exact(spans(spark, sf_dir), corpus(spark, sf_dir), reference(spark, sf_dir), "q", LATIN, across=True)


@query(_exact_sql(1, False))
def exact_rowwise(spark, sf_dir):
    return cp.exact(spans(spark, sf_dir), corpus(spark, sf_dir), reference(spark, sf_dir), "h", LATIN, across=False)


_ENDS = f"""st AS (SELECT id, list_filter(string_split(part, ' '), lambda x: x <> '') AS w FROM (SELECT doc_id AS id, unnest(string_split(text, '.')) AS part FROM documents)),
  sp AS (SELECT id, array_to_string(w[1:3], ' ') AS span FROM st UNION ALL SELECT id, array_to_string(w[greatest(len(w) - 1, 1):], ' ') FROM st)"""


@query(f"""WITH {_ENDS}, sw AS (SELECT DISTINCT id, {_WORDS.format('span')} AS l FROM sp), rec AS (SELECT item_id, array_to_string({_WORDS.format('text')}, ' ') AS r FROM benchmark)
SELECT sw.id, item_id AS seq, count(*) AS spans FROM sw JOIN rec ON len(l) >= 2 AND contains(rec.r, array_to_string(l, ' ')) GROUP BY sw.id, item_id""")
def substring_exact(spark, sf_dir):
    """Spans: the first three and the last two words of every sentence."""
    words = F.filter(F.split("part", " "), lambda x: x != "")
    parts = texts(spark, sf_dir).select("id", F.explode(F.split("text", r"\.")).alias("part")).select("id", words.alias("w"))
    ends = F.array(F.slice("w", 1, 3), F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), 2))
    named = parts.select("id", F.explode(ends).alias("w")).select("id", tx.norm(F.array_join("w", " "), LATIN).alias("text")).distinct()
    found = cp.substring_exact(named.select(F.struct("id", "text").alias("id"), "text"), corpus(spark, sf_dir), LATIN)
    return found.groupBy("id.id", "seq").agg(F.count("*").alias("spans"))


@query(f"""WITH {_DOC}, t AS (SELECT id, sum(CASE WHEN tag = 'q' THEN 1 ELSE 0 END) AS q, sum(CASE WHEN tag = 'h' THEN 1 ELSE 0 END) AS h, sum(words) AS c FROM run WHERE words >= 6 GROUP BY id)
SELECT d.source, sum(len(l))::BIGINT AS words, coalesce(sum(q), 0)::BIGINT AS q_passages, coalesce(sum(h), 0)::BIGINT AS h_passages, coalesce(sum(c), 0)::BIGINT AS covered,
  (sum(len(l)) // count(*))::BIGINT AS words_per_text FROM w JOIN documents d ON d.doc_id = w.id LEFT JOIN t USING (id) GROUP BY d.source""")
def citation_report(spark, sf_dir):
    found = cp.passage_scan(texts(spark, sf_dir), reference(spark, sf_dir), LATIN)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.size(tx.tokens(tx.norm(F.col("text"), LATIN))).cast("long").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return docs.join(found, "id", "left").groupBy("source").agg(F.sum("n").alias("words"), total("q_passages").alias("q_passages"), total("h_passages").alias("h_passages"), total("covered").alias("covered"), F.expr("sum(n) div greatest(count(*), 1)").alias("words_per_text"))


@query(f"""WITH {_DOC}, sn AS (SELECT id, {_WORDS.format('part')} AS l FROM (SELECT doc_id AS id, unnest(string_split(text, '.')) AS part FROM documents)), m AS (SELECT DISTINCT id, unnest({_GRAMS.format('l')}) AS gram FROM sn),
  gold AS (SELECT DISTINCT tag.id, tag.gram FROM tag JOIN run ON run.id = tag.id AND run.tag = tag.tag AND tag.pos >= run.first AND tag.pos < run.first + run.n WHERE run.words >= 6),
  a AS (SELECT count(*) AS n, count(is_q) AS good FROM m LEFT JOIN ref USING (gram)), b AS (SELECT count(*) AS n, count(m.gram) AS good FROM gold LEFT JOIN m ON m.id = gold.id AND m.gram = gold.gram)
SELECT a.good AS p_num, a.n AS p_den, b.good AS r_num, b.n AS r_den FROM a, b""")
def micro_pr(spark, sf_dir):
    """Claimed: the grams of every sentence of each text. Precision against the whole corpus, recall
    against passages, which run on over full stops."""
    sentences = texts(spark, sf_dir).select("id", F.explode(F.split("text", r"\.")).alias("text"))
    claimed = cp.grams(sentences, LATIN).select("id", "gram").distinct()
    gold = cp.region_gold(texts(spark, sf_dir), reference(spark, sf_dir), LATIN).select("id", "gram").distinct()
    precision = claimed.join(reference(spark, sf_dir), "gram", "left").agg(F.count("is_q").alias("p_num"), F.count("*").alias("p_den"))
    recall = gold.join(claimed.withColumn("hit", F.lit(1)), ["id", "gram"], "left").agg(F.count("hit").alias("r_num"), F.count("*").alias("r_den"))
    return precision.crossJoin(recall)  # one row each


@query(rf"SELECT doc_id AS id, trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) AS normed FROM documents")
def norm_latin(spark, sf_dir):
    return texts(spark, sf_dir).select("id", tx.norm(F.col("text"), LATIN).alias("normed"))


_ARABIC_ROWS = "(SELECT item_id, 'قَالَ ' || substring(text, 1, 12) || ' إلى ١٢ ' || item_id || ' آمنوا ـ الصلاة' AS t FROM benchmark)"
_NORM_SQL = "trim(regexp_replace(translate(regexp_replace(t, '[ؐ-ًؚ-ٰٟـۖ-ۭ]', '', 'g'), 'أإآٱىةؤئ', 'اااايهوي'), '[^{0}]+', ' ', 'g'))"


def arabic_rows(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.concat(F.lit("قَالَ "), F.substring("text", 1, 12), F.lit(" إلى ١٢ "), F.col("item_id").cast("string"), F.lit(" آمنوا ـ الصلاة")).alias("t"))


@query(f"SELECT item_id, {_NORM_SQL.format('ء-غف-ي')} AS normed FROM {_ARABIC_ROWS}")
def norm_arabic(spark, sf_dir):
    return arabic_rows(spark, sf_dir).select("item_id", tx.norm(F.col("t"), tx.ARABIC).alias("normed"))


@query(f"SELECT item_id, {_NORM_SQL.format('ء-غف-ي0-9٠-٩')} AS normed FROM {_ARABIC_ROWS}")
def norm_digits(spark, sf_dir):
    return arabic_rows(spark, sf_dir).select("item_id", tx.norm(F.col("t"), tx.ARABIC_DIGITS).alias("normed"))
