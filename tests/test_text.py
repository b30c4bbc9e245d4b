"""Text and span expressions against small Python models."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus as cp
from tessera.operators import metrics, resume
from tessera.operators import spans as sp


def test_norm_arabic(spark):
    rows = [("قَالَ إلى ١٢ آمنوا",), ("",), (None,), ("abc الصلاة ـ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.norm(F.col("t"))).collect()]
    assert got == ["قال الي امنوا", "", None, "الصلاه"]


def test_slice_and_occurrences_match_python(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab é😀") for _ in range(rng.randrange(12))), "".join(rng.choice("ab ") for _ in range(rng.randrange(3))), rng.randrange(-15, 15), rng.randrange(-15, 15)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "t string, u string, s int, e int")
    for r in frame.select("t", "u", "s", "e", tx.py_slice(F.col("t"), F.col("s"), F.col("e")).alias("p"), tx.occurrences(F.col("t"), F.col("u")).alias("o")).collect():
        assert r.p == r.t[r.s : r.e]
        assert r.o == ([i for i in range(len(r.t)) if r.t.startswith(r.u, i)] if r.u else [])


def test_needle_with_regex_quotes(spark):
    frame = spark.createDataFrame([("x\\Ey.x\\Ey", "\\Ey"), ("a.b", "."), ("aa", None)], "t string, u string")
    assert [r[0] for r in frame.select(tx.occurrences(F.col("t"), F.col("u"))).collect()] == [[1, 6], [1], []]


def _snap(t, head, tail, hs, he):
    def occ(u):
        return [i for i in range(len(t)) if u and t.startswith(u, i)]

    def near(places, hint):
        return min(places, key=lambda p: (abs(p - hint), p)) if places else None

    s = near(occ(head), hs)
    ends = [p + len(tail) for p in occ(tail)]
    if s is not None and (not tail or tail == head):
        e = s + len(head)
    else:
        e = near([x for x in ends if s is not None and x - len(tail) >= s] or ends, he)
    if s is None or e is None or e <= s:
        return (hs, he, False, "model")
    return (s, e, True, "model_ok" if (s, e) == (hs, he) else "snapped")


def test_snap_matches_model(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(rng.randrange(n)))
    rows = [(word(14), word(3), word(3), rng.randrange(14), rng.randrange(14)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "t string, h string, u string, s int, e int")
    for r in frame.select("*", sp.snap(*(F.col(c) for c in ("t", "h", "u", "s", "e"))).alias("x")).collect():
        assert tuple(r.x) == _snap(r.t, r.h, r.u, r.s, r.e), r


def test_find_json(spark):
    rows = [('{"k": 1}',), ('```json\n{"k": 1}\n```',), ('so {"k": 1} yes',), ('{"k": 1}]',), ("no",), (None,), ("",), ("[1]}",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.find_json(F.col("t"))).collect()]
    assert got == ['{"k": 1}'] * 4 + [None] * 4


def test_stripped_search(spark):
    rows = [("قَالَ نعم", "قال"), ("abc", "bc"), ("abc", "x"), ("abc", "")]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "t string, q string").select(tx.stripped_search(F.col("t"), F.col("q"))).collect()]
    assert got == [(0, 5), (1, 3), None, None]


def test_passages_of_five_and_six_words(spark):
    corpus = spark.createDataFrame([("q", 0, "a b c d e f"), ("h", 1, "p q r s t")], "corpus string, seq long, text string")
    texts = spark.createDataFrame([(1, "x a b c d e f y"), (2, "p q r s t"), (3, "a b"), (4, None), (5, "")], "id long, text string")
    got = [tuple(r) for r in cp.passage_scan(texts, cp.corpus_grams(corpus, tx.LATIN), tx.LATIN).collect()]
    assert got == [(1, 1, 0, 6)]
    exact = {r.id: r.exact for r in cp.exact(texts, corpus, cp.corpus_grams(corpus, tx.LATIN), "q", tx.LATIN).collect()}
    assert exact[3] and not exact[2] and not exact[5]


def test_f1_counts(spark):
    pairs = spark.createDataFrame([("m", "a", "a"), ("m", "a", "z"), ("m", "b", "a")], "m string, g string, p string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in metrics.label_counts(pairs, ["a", "b", "c"], ["m"]).collect()}
    assert got == {"a": (1, 1, 1), "b": (0, 0, 1), "c": (0, 0, 0)}


def test_resume_policies(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    done = spark.createDataFrame([(1, "ok", "x"), (2, "ERROR: a", None), (3, "  ", None)], "id long, answer string, category string")
    left = lambda p: sorted(r.id for r in resume.todo(items, done, p).collect())
    assert left("any") == [4, 5] and left("drop_errors") == [2, 4, 5] and left("blank_or_error") == [2, 3, 4, 5] and left("missing_label") == [2, 3, 4, 5]
