"""Sources and sinks (each table is written to the shared folder and read back), attributions, and runs
over recorded replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decoding
from ..functions import text as tx
from ..operators import attribution, corpus as cp, remote, spans as sp
from ..sources import files, work
from .corpus_queries import _exact_sql, reference, spans
from .registry import corpus, query, table, texts
from .span_queries import _A, _near, _occ, hinted

LATIN_DIGITS = tx.NormSpec(keep=r"\p{L}0-9", lower=True)


@query("SELECT item_id::VARCHAR AS id, text AS prompt FROM benchmark")
def scan_prompts(spark, sf_dir):
    path = work.scratch(spark, "prompts") + ".jsonl"
    files.write_lines(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("prompt")), path)
    return files.prompts(spark, path)


@query("SELECT doc_id::VARCHAR AS id, text AS prompt FROM documents WHERE text <> '' AND text NOT IN ('" + "', '".join(files.MISSING) + "')")
def csv_dropna(spark, sf_dir):
    path = work.scratch(spark, "prompts") + ".csv"
    files.write_csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt")), path)
    return files.prompts(spark, path)


@query("SELECT doc_id AS doc, doc_id::VARCHAR AS id, lang AS prompt, text AS answer, source AS model FROM documents UNION ALL SELECT doc_id, 'second', NULL, lang, source FROM documents WHERE doc_id % 3 = 1")
def scan_answers(spark, sf_dir):
    """Documents as files of the three forms: a list, an object with per_sample, a bare object."""
    first = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("prompt"), F.col("text").alias("answer"), F.col("source").alias("model"))
    second = F.struct(F.lit("second").alias("id"), F.lit(None).cast("string").alias("prompt"), F.col("lang").alias("answer"), F.col("source").alias("model"))
    value = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(first))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.array(first, second).alias("per_sample")))).otherwise(F.to_json(first))
    return files.records(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), value.alias("value")), files.ANSWER)


@query("SELECT 'q' AS corpus, item_id AS seq, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'h', item_id, text FROM benchmark WHERE item_id % 2 = 1")
def scan_corpus(spark, sf_dir):
    path = work.scratch(spark, "corpus")
    files.write_lines(corpus(spark, sf_dir), path, by=("corpus",))
    return files.json_lines(spark, path, "seq long, text string, corpus string").select("corpus", "seq", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS model FROM documents")
def partition_from_name(spark, sf_dir):
    path = F.concat(F.lit("s3://bucket/gold/"), F.col("source"), F.when(F.col("doc_id") % 4 != 0, "_agreed.json").otherwise("_draft.json"))
    return table(spark, sf_dir, "documents").select("doc_id", files.name_of(path, "_agreed.json").alias("model"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang, source")
def multi_file_union(spark, sf_dir):
    path = work.scratch(spark, "answers")
    files.write_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), path, by=("lang",))
    both = files.union_of(spark, [f"{path}/lang=en/*.json", f"{path}/lang=de/*.json"], "doc_id long, source string")
    lang = F.regexp_extract(F.col("_metadata.file_path"), "lang=([^/]*)/", 1)
    return both.select(lang.alias("lang"), "source").groupBy("lang", "source").agg(F.count("*").alias("n"))


_SPACED = "trim(regexp_replace(lower(text), '[^\\p{L}0-9]+', ' ', 'g'))"
NAMES = ["page", "item", "part", "section", "version", "item number"]
_MARKED = f"(SELECT doc_id, string_split(regexp_replace({_SPACED}, '({'|'.join(sorted(NAMES, key=lambda n: (-len(n), n)))})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)"


@query(f"""SELECT doc_id, len(list_filter(range(2, len(p) + 1), lambda i: regexp_matches(array_to_string((string_split(ltrim(replace(substring(array_to_string(p[i:], ''), strpos(p[i], chr(2)) + 1), chr(2), '')), ' '))[1:5], ' '), '[0-9]')))::INTEGER AS n FROM {_MARKED}""")
def attr_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", attribution.named(F.col("text"), NAMES, LATIN_DIGITS).alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all({_SPACED}, 'copyright|licen[cs]e|rights reserved|page'))::INTEGER AS n FROM documents WHERE text IS NOT NULL")
def attr_hadith(spark, sf_dir):
    words = ["copyright", "license", "licence", "rights reserved", "page"]
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", attribution.keywords(F.col("text"), words, LATIN_DIGITS).alias("n"))


@query(r"SELECT DISTINCT name FROM (SELECT trim(regexp_replace(lower(c_name), '[^\p{L}0-9]+', ' ', 'g')) AS name FROM customer) WHERE length(name) >= 3")
def name_dictionary(spark, sf_dir):
    return attribution.name_dictionary(F.col("c_name"), table(spark, sf_dir, "customer"), LATIN_DIGITS)


@query(f"SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN q.exact THEN 'Correct' ELSE 'Incorrect' END WHEN 1 THEN CASE WHEN h.exact THEN 'Correct' ELSE 'Incorrect' END ELSE 'NA' END AS label FROM documents LEFT JOIN ({_exact_sql(0, True)}) q ON q.id = doc_id LEFT JOIN ({_exact_sql(1, False)}) h ON h.id = doc_id")
def corpus_verdict(spark, sf_dir):
    """Labels of verse and saying spans by the corpora; other types keep theirs."""
    rows, items, ref = spans(spark, sf_dir), corpus(spark, sf_dir), reference(spark, sf_dir)
    verse = cp.exact(rows.where("id % 3 = 0"), items, ref, "q", tx.LATIN, across=True)
    saying = cp.exact(rows.where("id % 3 = 1"), items, ref, "h", tx.LATIN, across=False)
    judged = verse.unionByName(saying).select("id", F.when(F.col("exact"), "Correct").otherwise("Incorrect").alias("label"))
    return rows.select("id").join(judged, "id", "left").select("id", F.coalesce("label", F.lit("NA")).alias("label"))


# ------------------------------------------------------------ runs over recorded replies

_SPAN = "array<struct<type string, text string, start int, `end` int>>"


@query(f"WITH {_A} SELECT id, 'quran' AS type, head AS text, {_near('(' + _occ('t', 'head') + ')', '0')}::INTEGER AS start, ({_near('(' + _occ('t', 'head') + ')', '0')} + length(head))::INTEGER AS stop FROM s WHERE id % 5 <> 0 AND head <> ''")
def annotate_pipeline(spark, sf_dir):
    """Replies (plain, fenced, amid prose, none) to spans to repaired spans."""
    rows = hinted(spark, sf_dir).select("id", F.col("t").alias("answer"), "head")
    span = F.array(F.struct(F.lit("q").alias("type"), F.col("head").alias("text"), F.lit(0).alias("start"), F.lit(3).alias("end")))
    json = F.to_json(F.struct(span.alias("spans")))
    raw = F.when(F.col("id") % 5 == 0, "I can't.").when(F.col("id") % 5 == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(F.col("id") % 5 == 2, F.concat(F.lit("Here: "), json, F.lit(" done"))).otherwise(json)
    replies = rows.select("id", raw.alias("raw"))
    parsed = rows.select("id", "answer").join(replies, "id").select("id", "answer", F.from_json(tx.find_json(F.col("raw")), f"spans {_SPAN}")["spans"].alias("spans"))
    return parsed.select("id", F.explode(sp.fix_indices(F.col("answer"), F.col("spans"))).alias("s")).select("id", sp.norm_type(F.col("s.type")).alias("type"), F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


def typology(spark, sf_dir):
    rows = hinted(spark, sf_dir).select("id", F.col("t").alias("answer"), "head", "h")
    span = F.struct(F.lit("Quran").alias("type"), F.lit("Correct").alias("label"), F.col("head").alias("start_words"), F.lit("").alias("end_words"), F.col("h").alias("start"), (F.col("h") + 40).alias("end"))
    raw = F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.to_json(F.struct(F.array(span).alias("spans"))))
    schema = "spans array<struct<type string, label string, start_words string, end_words string, start int, `end` int>>"
    parsed = rows.select("id", "answer", F.explode_outer(F.from_json(tx.find_json(raw), schema)["spans"]).alias("s"))
    placed = parsed.withColumn("p", F.when(F.col("s").isNotNull(), sp.snap(F.col("answer"), F.col("s.start_words"), F.col("s.end_words"), F.col("s.start"), F.col("s.end"))))
    return placed.select("id", F.col("s.type").alias("type"), F.col("s.label").alias("label"), F.col("p.start").alias("start"), F.col("p.end").alias("stop"), F.col("p.verified").alias("verified"), F.col("p.source").alias("index_source"), F.when(F.col("s").isNotNull(), tx.py_slice(F.col("answer"), F.col("p.start"), F.col("p.end"))).alias("span_text"))


_TYPOLOGY = f"""{_A}, o AS (SELECT *, CASE WHEN head = '' THEN NULL ELSE {_near('(' + _occ('t', 'head') + ')', 'h')} END AS st FROM s),
  ty AS (SELECT id, t, st IS NOT NULL AS verified, coalesce(st, h)::INTEGER AS start, coalesce(st + length(head), e)::INTEGER AS stop, st = h AND st + length(head) = e AS same FROM o WHERE id % 7 <> 0)"""


@query(f"WITH {_TYPOLOGY} SELECT id, 'Quran' AS type, 'Correct' AS label, start, stop, verified, CASE WHEN NOT verified THEN 'model' WHEN same THEN 'model_ok' ELSE 'snapped' END AS index_source, substring(t, start + 1, stop - start) AS span_text FROM ty UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s WHERE id % 7 = 0")
def typology_pipeline(spark, sf_dir):
    """Replies to spans placed by their first words; an item without a reply keeps a row of nulls."""
    return typology(spark, sf_dir)


@query(f"WITH {_TYPOLOGY} SELECT (SELECT count(*) FROM ty) AS spans, (SELECT count(*) FROM ty WHERE verified AND NOT same) AS snapped, (SELECT count(*) FROM ty WHERE NOT verified) AS unverified, (SELECT count(*) FROM s WHERE id % 7 = 0) AS failed")
def annotation_summary(spark, sf_dir):
    return typology(spark, sf_dir).agg(F.count("type").alias("spans"), F.count_if(F.col("index_source") == "snapped").alias("snapped"), F.count_if(~F.col("verified")).alias("unverified"), F.count_if(F.col("type").isNull()).alias("failed"))


TOO_LONG = 2000


def _sizes(prompts: list) -> list:
    """Stands for a model whose memory holds so many characters of a batch."""
    if sum(map(len, prompts)) > TOO_LONG:
        raise MemoryError("out of memory")
    return [str(len(p)) for p in prompts]


@query(f"SELECT doc_id AS id, CASE WHEN length(text) > {TOO_LONG} THEN 'ERROR: out of memory' ELSE length(text)::VARCHAR END AS answer FROM documents WHERE text IS NOT NULL")
def bisect_batches(spark, sf_dir):
    return remote.generate(texts(spark, sf_dir).where("text is not null").select("id", F.col("text").alias("prompt")), _sizes)


@query("SELECT source AS model, CASE source WHEN 'src1' THEN 3000 WHEN 'src2' THEN NULL ELSE 1500 END AS max_tokens, CASE source WHEN 'src1' THEN 7096 WHEN 'src2' THEN 32768 WHEN 'src3' THEN 2048 ELSE 4096 END AS max_len FROM (SELECT DISTINCT source FROM documents)")
def resolve_budget(spark, sf_dir):
    known = spark.createDataFrame([("src1", True, 3000, None), ("src2", True, None, None), ("src3", False, None, 2048)], "model string, listed boolean, override int, cap int")
    models = table(spark, sf_dir, "documents").select(F.col("source").alias("model")).distinct().join(F.broadcast(known), "model", "left")  # a fixed list
    return models.select("model", decoding.budget(F.coalesce("listed", F.lit(False)), F.col("override"), F.lit(1500), F.col("cap")).alias("b")).select("model", "b.*")


@query("SELECT source AS model, CASE source WHEN 'src1' THEN 0.6 ELSE 0.7 END::DOUBLE AS temperature, CASE source WHEN 'src4' THEN 0.5 ELSE 0.9 END::DOUBLE AS top_p FROM (SELECT DISTINCT source FROM documents)")
def resolve_sampling(spark, sf_dir):
    known = spark.createDataFrame([("src1", True, 0.6, None, None), ("src2", False, 0.1, 0.2, None), ("src3", True, 0.0, 0.0, None), ("src4", True, None, 0.95, 0.5)], "model string, samples boolean, t double, p double, asked_p double")
    models = table(spark, sf_dir, "documents").select(F.col("source").alias("model")).distinct().join(F.broadcast(known), "model", "left")  # a fixed list
    return models.select("model", decoding.sampling(F.lit(None).cast("double"), F.col("samples"), F.col("t"), decoding.TEMPERATURE).alias("temperature"), decoding.sampling(F.col("asked_p"), F.col("samples"), F.col("p"), decoding.TOP_P).alias("top_p"))
