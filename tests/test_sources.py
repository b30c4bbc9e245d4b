"""Readers, writers, attributions, review tables and batches against small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import decoding
from tessera.operators import attribution, remote, review
from tessera.sources import files, xlsx


def test_json_array_and_unknown_kind(spark, tmp_path):
    (tmp_path / "p.JSON").write_text(json.dumps([{"id": "1", "prompt": "a"}, {"id": "2"}]))
    assert [tuple(r) for r in files.prompts(spark, str(tmp_path / "p.JSON")).collect()] == [("1", "a"), ("2", None)]
    with pytest.raises(ValueError):
        files.prompts(spark, str(tmp_path / "p.txt"))


def test_csv_keeps_lines_and_quotes(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    files.write_csv(spark.createDataFrame([("1", 'a "b"\n c, d '), ("2", None), ("3", "NaN"), ("4", "")], "id string, prompt string"), path)
    assert [tuple(r) for r in files.prompts(spark, path).collect()] == [("1", 'a "b"\n c, d ')]


def test_records_of_the_three_forms(spark):
    docs = spark.createDataFrame([(1, '[{"id": "a"}, {"id": "b"}]'), (2, '{"per_sample": [{"id": "c"}]}'), (3, ' {"id": "d"}'), (4, "junk"), (5, None), (6, "[]")], "n int, value string")
    assert sorted((r["n"], r["id"]) for r in files.records(docs, files.ANSWER).collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_names(spark):
    rows = spark.createDataFrame([("x/m_agreed.json",), ("x/m.json",), (None,)], "p string")
    assert [r[0] for r in rows.select(files.name_of(F.col("p"), "_agreed.json")).collect()] == ["m", None, None]
    assert files.output_name("m") == "m.json" and files.output_name("m", "alt") == "m_alt.json" and files.output_name("m", annotator="x") == "m__x_typology.json"


def test_stems(spark, tmp_path):
    for stem in ("a", "b", "c"):
        (tmp_path / f"{stem}.json").write_text('{"id": "%s"}\n' % stem)
    found = files.union_of(spark, [f"{tmp_path}/a.json", f"{tmp_path}/[bc].json"], "id string", {"a", "c"})
    assert sorted(tuple(r) for r in found.collect()) == [("a", "a"), ("c", "c")]


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.xlsx")
    rows = spark.createDataFrame([("1", "a <b> & \n c"), ("2", None), ("3", "")], "qid string, prompt string").coalesce(1)
    xlsx.write_report(rows, path, [5, 60], [("total", 3)])
    with open(path, "rb") as f:
        assert list(xlsx.sheet_rows(f.read()))[-1] == ["total", "3"]
    assert [tuple(r) for r in files.prompts(spark, path).collect()] == [("1", "a <b> & \n c"), ("total", "3")]


def test_attributions(spark):
    rows = spark.createDataFrame([(0, "سورة البقرة الآية رقم 255"), (1, "البقرة ا ب ج د ه ٣"), (2, "البقرة البقرة 5"), (3, ""), (4, None)], "i int, text string")
    got = rows.select("i", attribution.named(F.col("text"), ["البقره"]).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [1, 0, 2, 0, None]
    said = spark.createDataFrame([("رواه البخاري و مسلم",)], "text string").select(attribution.keywords(F.col("text"), attribution.arabic_keywords())).first()[0]
    assert said == 3


def test_bisecting_and_retries():
    def call(items):
        if sum(items) > 5:
            raise MemoryError("full")
        return [str(i) for i in items]

    assert remote.bisected([1, 2, 3, 9, 4, 1], call) == ["1", "2", "3", "ERROR: full", "4", "1"]
    assert remote.bisected([], call) == []
    waited, tries = [], []

    def failing():
        tries.append(1)
        raise OSError

    assert remote.retried(failing, sleep=waited.append) is None and waited == [2, 4] and len(tries) == 3
    assert remote.retried(lambda: 7) == 7


def test_other_failures_spare_other_batches(spark):
    def call(items):
        if "bad" in items:
            raise OSError("down")
        return [i.upper() for i in items]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, prompt string").coalesce(1)
    assert [tuple(r) for r in remote.generate(rows, call, size=1).collect()] == [(1, "A"), (2, "ERROR: down"), (3, "C")]


def test_review_import_add_export(spark):
    docs = spark.createDataFrame([('{"spans": [{"id": "p", "type": "h"}, {"prompt_id": "q"}]}',), ('[{"prompt_id": "r", "spans": [{"text": "t", "status": "reject"}]}, {"id": "s"}]',), ("[]",), (None,)], "value string")
    spans = review.spans_of(docs)
    got = sorted((r["prompt_id"], r["span_idx"], r["type"], r["text"], r["status"]) for r in spans.collect())
    assert got == [("p", 0, "hadith_matn", "", "pending"), ("q", 1, "quran", "", "pending"), ("r", 0, "quran", "t", "reject")]
    new = spark.createDataFrame([("r", 0, 1, "quran", "x", 1, 2), ("r", 0, 2, "quran", "y", 1, 2)], "prompt_id string, after_idx int, seq int, type string, text string, start int, `end` int")
    out = {r["id"]: [(s["text"], s["added"]) for s in r["spans"]] for r in review.export(review.add(spans, new)).collect()}
    assert out["r"] == [("t", None), ("y", True), ("x", True)]


def test_budget_and_sampling(spark):
    b = lambda listed, over, cap: tuple(spark.range(1).select(decoding.budget(F.lit(listed), F.lit(over).cast("int"), F.lit(1500), F.lit(cap).cast("int")).alias("b")).first()["b"])
    assert [b(False, None, None), b(True, 3000, None), b(True, None, None), b(False, None, 2048), b(False, None, 0)] == [(1500, 4096), (3000, 7096), (None, 32768), (1500, 2048), (1500, 4096)]
    s = lambda *a: spark.range(1).select(decoding.sampling(*(F.lit(x).cast(t) for x, t in zip(a, ("double", "boolean", "double"))), 0.7)).first()[0]
    assert [s(0.0, True, 0.5), s(None, True, 0.5), s(None, False, 0.5), s(None, True, 0.0), s(None, None, None)] == [0.0, 0.5, 0.7, 0.7, 0.7]
