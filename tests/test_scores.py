"""Metrics, substring search and replies on rows made for the awkward cases."""

import itertools

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus as cp
from tessera.operators import metrics, remote, resume, review


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_scorecard_has_null_for_a_slice_without_pairs(spark):
    pairs = spark.createDataFrame([("a", "q", "x", "x"), ("a", None, "x", "y"), ("b", "h", "y", "z")], "model string, source_type string, g string, p string")
    got = [tuple(r) for r in metrics.scorecard(pairs, ["x", "y"], ["q", "h"]).collect()]
    assert [r[0] for r in got] == ["a", "b"]
    assert got[0][1:] == (2 / 3 / 2, 0.5, None, 2 / 3, 0.0)
    assert got[1][1:] == (0.0, None, 0.0, 0.0, 0.0)
    assert metrics.scorecard(pairs.limit(0), ["x", "y"], ["q", "h"]).count() == 0
    assert metrics.label_matrix(metrics.scorecard(pairs, ["x", "y"], ["q", "h"])).columns == ["model", "x", "y"]


def test_of_kind_without_a_kind_is_all(spark):
    pairs = spark.createDataFrame([("q", 1), ("h", 2), (None, 3)], "source_type string, n int")
    assert metrics.of_kind(pairs).count() == metrics.of_kind(pairs, "").count() == 3
    assert rows(metrics.of_kind(pairs, "h")) == [("h", 2)]


def test_agreement_and_counts(spark):
    pairs = spark.createDataFrame([("t", "a", "a"), ("t", "a", "b"), ("t", None, "b")], "type string, g string, p string")
    (got,) = metrics.agreement(pairs, ["type"]).collect()
    assert (got.total, got.agree, got.rate, got.confusion) == (3, 1, 1 / 3, {"None|b": 1, "a|a": 1, "a|b": 1})
    spans = spark.createDataFrame([("q", "good"), ("new", None), ("q", "odd")], "type string, label string")
    assert rows(metrics.type_counts(spans, ["q", "h"])) == [("h", 0), ("new", 1), ("q", 2)]
    assert rows(metrics.label_columns(spans, ["type"], ["good", "bad"])) == [("new", 0, 0, 1, 0), ("q", 1, 0, 1, 1)]


def test_substring_equals_brute_force(spark):
    records = ["the cat sat on the mat", "cat", "a mat the cat sat", "", "catsat on"]
    ends = ["he cat", "cat sa", "e cat s", "t sat on the", "on the mat", "mat the", "cat", "", "at the ca", "sat  on", "x the cat", "the the"]
    corpus = spark.createDataFrame([("q", i, r) for i, r in enumerate(records)], "corpus string, seq long, text string")
    spans = spark.createDataFrame(list(enumerate([*ends, None])), "id long, text string")
    want = [(i, "q", j) for (i, s), (j, r) in itertools.product(enumerate(" ".join(e.split()) for e in ends), enumerate(records)) if len(s.split()) >= 2 and s in r]
    assert len(want) > 8
    assert rows(cp.substring_exact(spans, corpus, tx.LATIN)) == sorted(want, key=str)


def test_merge_in_order_drops_what_no_question_asks(spark):
    asked = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "place int, id string")
    old = spark.createDataFrame([("a", "old"), ("b", "old"), ("z", "old")], "id string, answer string")
    new = spark.createDataFrame([("a", "new")], "id string, answer string")
    assert [tuple(r)[:3] for r in resume.merge_in_order(asked, old, new).select("place", "id", "answer").collect()] == [(1, "b", "old"), (2, "a", "new")]


def test_question_labels(spark):
    good = '{"category": "c", "difficulty": 2, "divergence": 5}'
    raw = [good, "```json\n" + good + "\n```", "", None, "[1]", good.replace("5", "6"), good.replace("difficulty", "d")]
    frame = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = frame.select("id", remote.question_labels(F.col("raw")).alias("x")).orderBy("id").select("x.*").collect()
    assert [tuple(r) for r in got[:2]] == [("c", 2, 5, None)] * 2
    assert all(r[:3] == (None, None, None) and r.error for r in got[2:])
    assert [r.error for r in got[5:]] == ["ValueError: divergence out of range", "ValueError: no difficulty in the reply"]


def test_search_and_highlight(spark):
    frame = spark.createDataFrame([(1, "The (cat)"), (2, None), (12, "dog")], "id int, text string")
    assert rows(review.search(frame, " (CAT ", ["id", "text"])) == [(1, "The (cat)")]
    assert [r[0] for r in rows(review.search(frame, "2", ["id", "text"]))] == [12, 2] and review.search(frame, " ", ["text"]).count() == 3
    assert frame.select(tx.highlighted(F.col("text"), "(C").alias("x")).first()[0] == "The <mark>(c</mark>at)"
