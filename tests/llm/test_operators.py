"""The ten operators against brute force on small tables that hold the awkward cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_reuse, byte_bpe, chat, core, decontam, langid, license_scan, ngram_join, quality, queries, suffix_dedup, token_count, url_filter

RNG = random.Random(17)
VOCABULARY = ["".join(RNG.choice("abcdeéßü") for _ in range(RNG.randrange(1, 7))) for _ in range(60)]


def prose(n, rng=RNG):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", "  ", "\n", ", ", "\t"]) for _ in range(n))


def _texts():
    base, shared = prose(250), prose(90)
    words = base.split(" ")
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (3, 40, 90, 91)]
    out = [None, "", " \n ", "one", "two words", "a b c", "a b c d", base, base, *near, base.upper(), prose(40) + shared + prose(60), prose(30) + shared + prose(9), "x" * 3000, "ab " * 700, "line one two three four five\n" * 30, prose(6000), "😀 é <|endoftext|> ok", "<|endof" + "text|>" * 3, "12 34", "!!!"]
    return [(i, t) for i, t in enumerate(out)] + [(7, base), (None, prose(20)), (None, None)]


TEXTS = _texts()


def texts():
    return TEXTS


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "h1" if (d or 0) % 2 else None, 5, "row", 1, "x") for d, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string, n long, spans string").repartition(3)


def empty(docs):
    return docs.where("false")


def match(frame, want):
    assert sorted(map(repr, (tuple(r) for r in frame.collect()))) == sorted(map(repr, want))


WORD = re.compile(r"[^ \t-\r]+")


def lower(t):
    return (t or "").encode().lower().decode()


def test_licences(docs):
    more = docs.sparkSession.createDataFrame([(100, "The MIT-License; mit license mit LICENSE. CC BY cc by-nc GNU General Public License"), (101, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify")], "doc_id long, text string")
    want = []
    for d, t in [*texts(), *((r.doc_id, r.text) for r in more.collect())]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        want.append((d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = license_scan.scan(docs.select("doc_id", "text").unionByName(more))
    match(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), want)
    by = {r.doc_id: r for r in got.where("doc_id >= 100").collect()}
    assert by[101].labels == "mit" and by[101].base_labels == "" and 0.6 <= by[101].score <= 1
    assert by[100].labels == "cc-by,gpl,mit" and by[100].score == 1
    assert license_scan.scan(empty(docs)).count() == 0


def test_automaton_statistics():
    rng = random.Random(2)
    texts_ = [[rng.randrange(4) for _ in range(rng.randrange(2, 12))] for _ in range(5)]
    a = license_scan.Automaton(texts_)
    parts = {tuple(t[i:j]) for t in texts_ for i in range(len(t)) for j in range(i, len(t) + 1)}
    text, state, length = [rng.randrange(5) for _ in range(300)], 0, 0
    for i, word in enumerate(text):
        state, length = a.step(state, length, word)
        assert length == max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in parts)


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def jaccard_brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return [(d, len(s), find(d) if d is not None else None) for d, s in sets]


def test_jaccard_components(docs):
    match(ngram_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id"), jaccard_brute(texts()))
    assert ngram_join.jaccard_components(empty(docs)).count() == 0


def test_jaccard_of_chains_and_long_lists(spark, monkeypatch):
    """Near copies whose links chain, in lists that are split in blocks and walked in both rounds."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(8)
    rows, words = [], [f"w{i}" for i in range(120)]
    for i in range(45):
        words = list(words)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(120)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"w{j}" for j in range(i, i + 60))) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    match(ngram_join.jaccard_components(frame, heavy=0.9).select("doc_id", "n_shingles", "component_id"), jaccard_brute(rows))


def repeats_brute(rows, n=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i : i + n] for _, t in data for i in range(len(t) - n + 1))
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    match(suffix_dedup.repeats(docs).drop("kept"), repeats_brute(texts()))
    if hot > 1:
        assert suffix_dedup.repeats(empty(docs)).count() == 0


def test_quality(docs):
    want = []
    for d, t in texts():
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    got = quality.quality(docs)
    match(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), want)
    assert got.where("base_failed and kept").count() == 0
    assert quality.quality(empty(docs)).count() == 0


def test_bad_host_is_judged_by_soft_rules(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "###$$$ " * 2 + " ".join(f"#{i}{j}#" for j in range(30)), "bad") for i in range(30)] + [(30, good, "bad")] + [(100 + i, good + f" {i}", "fine") for i in range(30)]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {30, *range(100, 130)}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


def test_tokens(docs, library):
    encoded = [(d, t or "", library.encode(t or "", add_special_tokens=False).ids) for d, t in texts()]
    match(token_count.count_tokens(docs, queries.tokenizer(), huge=2000, chunk=700, overlap=8), [(d, len(t.encode()), len(ids)) for d, t, ids in encoded])
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    want = [(d, len(ids), digest(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for d, t, ids in encoded]
    match(bpe_reuse.encode(docs, queries.tokenizer(), mean=64), want)
    assert token_count.count_tokens(empty(docs), queries.tokenizer()).count() == bpe_reuse.encode(empty(docs), queries.tokenizer()).count() == 0


def test_every_character_is_encoded_alike(library):
    bpe = byte_bpe.load(queries.tokenizer())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in points[k : k + 4000])
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(points[k])


def test_url_filter(spark):
    events = url_filter.events_table(spark, [("l", "domain", "b.org", "add", "2024-01-10"), ("l", "domain", "b.org", "remove", "2024-02-10"), ("l", "prefix", "c.org/x", "add", "2024-01-01"), ("m", "domain", "org", "add", "2024-03-01")])
    rows = [(1, "http://A.b.org:80/z", "2024-01-10"), (2, "http://b.org", "2024-02-10"), (3, "https://u@c.org/x/y?q", "2024-02-01"), (4, "https://c.org/xy", "2024-02-01"), (5, None, "2024-01-01"), (6, "nonsense", "2024-01-01"), (7, "http://b.org.", None), (8, "http://b.org/", "2024-03-02"), (8, "http://b.org/", "2024-03-02")]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, fetched string"), events).select("page_id", "matched")
    match(got, [(1, "l:domain:b.org"), (2, ""), (3, "l:prefix:c.org/x"), (4, ""), (5, ""), (6, ""), (7, ""), (8, "m:domain:org"), (8, "m:domain:org")])


def test_url_filter_judges_by_the_time_of_day(spark):
    events = spark.createDataFrame([("l", "domain", "b.org", "add", "2024-01-10 09:00:00"), ("l", "domain", "b.org", "remove", "2024-01-10 18:00:00")], "list string, kind string, value string, action string, at string")
    rows = [(i, "http://b.org", f"2024-01-10 {t}") for i, t in enumerate(("08:59:59", "09:00:00", "15:00:00", "18:00:00"))]
    for at in (events, events.withColumn("at", F.to_timestamp("at")), url_filter.events_table(spark, [tuple(r) for r in events.collect()])):
        got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, fetched string"), at)
        match(got.select("page_id", "blocked"), [(0, False), (1, True), (2, True), (3, False)])


def test_chat_round_trip(spark):
    hard = ["", "a", "<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|", "<|", "\\<|", "x\n<|im_end|>\n", queries.HARD, None]
    rows = [(c, t, RNG.choice(["user", "assistant", None, "a\nb", "<|r", "\\n"]), RNG.choice(hard)) for c in (1, 2, None) for t in (0, 1, 1, 2, None)]
    want = []
    for c in (1, 2, None):
        own = sorted(((t, r or "", x or "") for cc, t, r, x in rows if cc == c), key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
        loss = "".join(x for _, r, x in own if r == "assistant")
        want.append((c, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("number", F.lit("x"))
    match(chat.digests(chat.pieces(frame)).drop("formatted_chars"), want)
    assert chat.digests(chat.pieces(frame.where("false"))).count() == 0


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        rng.choice([lambda: chars.__setitem__(at, "z"), lambda: chars.insert(at, "q"), lambda: chars.pop(at)])()
    return "".join(chars)


def distance(a, b):
    row = list(range(len(b) + 1))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_nearest_is_exact():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))).encode() for _ in range(2))
        d, x, y = decontam.nearest(a, b)
        assert d == distance(a, b) and (d == len(a) or distance(a, b[x:y]) == d)


def test_leaks_recall_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng.randrange(15, 50), rng)) for i in range(25)] + [(90, None), (91, ""), (92, "tiny 1")]
    rows = [(k, prose(30, rng) + edited(t, int(len(t) * rng.choice([0, 0.03, 0.08, 0.13])), rng) + prose(30, rng)) for k, (_, t) in enumerate(items[:25] * 2)]
    rows += [(200 + i, prose(80, rng)) for i in range(10)] + [(300, None), (301, ""), (302, "so Tiny  1 is here")]
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            a, b = decontam.fold_text(x), decontam.fold_text(t)
            if a and len(b) and (dist := distance(a, b)) <= int(0.2 * len(a) + 1e-9) and (len(a) >= 12 or dist == 0):
                want[d, i] = dist
    assert not set(got) - set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.9 * len(want) and (302, 92) in got
    assert decontam.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def leaks_brute(rows, items, similarity=0.8):
    """Every (doc, item): least distance within the threshold."""
    want = {}
    for d, t in rows:
        for i, x in items:
            a, b = decontam.fold_text(x), decontam.fold_text(t)
            found = decontam.nearest(a, b)[0]
            if found <= int((1 - similarity) * len(a) + 1e-9):
                want[d, i] = found
    return want


def leaks_found(spark, rows, items, parts=2, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts)
    return {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **options).collect()}


def test_leaks_near_the_threshold_are_all_found(spark):
    rng = random.Random(8)
    syllables = ["th", "er", "an", "in", "ing ", "or", "ha", "ti", "on ", "st ", "re", "en ", "wh"]
    few = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    items = [(i, (few(rng.randrange(35, 65)) if i % 2 else prose(rng.randrange(20, 100), rng)).strip()) for i in range(40)]
    rows = [(100 * k + i, few(60) + " " + edited(t, int(len(decontam.fold_text(t)) * share), rng) + " " + few(60)) for k, share in enumerate((0.15, 0.18, 0.2)) for i, t in items]
    want = leaks_brute(rows, items)
    assert sum(d >= 0.15 * len(decontam.fold_text(dict(items)[i])) for (_, i), d in want.items()) >= 30
    assert leaks_found(spark, rows, items) == want
    loose = {**leaks_brute(rows[:20], items, 0.6)}
    assert leaks_found(spark, rows[:20], items, similarity=0.6) == loose


def test_short_items_are_found(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(n, word(5) + " " + word(n - 6)) for n in range(12, 31)]
    rows = [(i, word(30) + " " + t + " " + word(30)) for i, t in items] + [(100 + i, word(30) + " " + t[:7] + "z" + t[8:] + word(30)) for i, t in items]
    want = leaks_brute(rows, items)
    assert len(want) >= 38 and leaks_found(spark, rows, items) == want


def test_leaks_of_a_text_that_begins_inside_an_item(spark):
    item = "the quick brown foxes jumped over all of the lazy dogs that were asleep beside the river bank in the sun"
    for rows in ([(1, item[3:])], [(1, item[3:]), (2, item[6:])], [(2, "other words"), (1, item[3:])], [(1, item[3:] + " and so on" * 60_000)]):
        assert leaks_found(spark, rows, [(5, item)], 1) == leaks_brute(rows, [(5, item)]) and rows


def test_leaks_of_unspaced_text(spark):
    rng = random.Random(10)
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))
    items = [(i, signs(n)) for i, n in enumerate((8, 20, 40, 90))]
    rows = [(i, signs(35) + t + signs(50)) for i, t in items] + [(10 + i, signs(35) + t[: len(t) // 2] + signs(1) + t[len(t) // 2 :] + signs(50)) for i, t in items]
    want = leaks_brute(rows, items)
    assert len(want) == 8 and leaks_found(spark, rows, items) == want


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    scores, moves, first = rng.normal(size=(700, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 5, 300, 700])
    got = langid.marginals(scores, first, moves)
    for a, b in zip(first[:-1], first[1:]):
        e, t = np.exp(scores[a:b]), np.exp(moves)
        x, forward = np.ones(3) / 3, []
        for row in e:
            x = x @ t * row
            x /= x.sum()
            forward.append(x)
        y, backward = np.ones(3), []
        for row in e[::-1]:
            backward.append(y)
            y = t @ (row * y)
            y /= y.sum()
        if b > a:
            p = np.array(forward) * np.array(backward[::-1])
            assert np.allclose(got[a:b], p / p.sum(1, keepdims=True))


def test_language_of_held_out_and_mixed(spark):
    rng = random.Random(9)
    make = {"xx": lambda: "".join(rng.choice(["ka", "to", "mi"]) for _ in range(3)), "yy": lambda: "".join(rng.choice(["schl", "ung", "öf"]) for _ in range(2))}
    text = lambda lang, n: " ".join(make[lang]() for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, sequences=300, epochs=2)
    test = spark.createDataFrame([(1, text("xx", 30), "yy"), (2, text("yy", 3000), None), (3, None, "xx"), (4, "12 !?", "xx"), (5, "😀", None), (6, text("xx", 5) + " " + text("yy", 40), None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(test, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "xx", 2: "yy", 3: "und", 4: "und", 5: "und", 6: "yy"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[6][1] < 0.98
    nothing = langid.train(frame.where("false"))
    assert {r.lang_pred for r in langid.predict(test, nothing).collect()} == {"und"}


def test_met_often_is_a_count_of_all_values():
    rng = np.random.default_rng(3)
    for size, least in ((0, 4), (1, 1), (3, 4), (500, 4), (500, 7.5), (500, 1), (20, 600)):
        found = rng.integers(0, 60, size, dtype=np.uint64) << np.uint64(58)
        values, count = np.unique(found, return_counts=True)
        got = ngram_join.met_often(found.copy(), least)
        assert [x.tolist() for x in got] == [values[count >= least].tolist(), count[count >= least].tolist()]


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_texts_that_collide_under_plain_rolling_hashes(spark, library):
    """A Thue-Morse string and its complement have one value under any polynomial modulo 2**64."""
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(i, t) for i, t in enumerate([a, b, a[:1024], b[:1024], f"{a} x y z w", f"{b} x y z w", f"{a}\n{b}\n{a} one\n", f"{'c' * 40}{a}{'d' * 40}", f"{'c' * 40}{b}{'d' * 40}"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    match(ngram_join.jaccard_components(frame).select("doc_id", "n_shingles", "component_id"), jaccard_brute(rows))
    match(suffix_dedup.repeats(frame).drop("kept"), repeats_brute(rows))
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(frame.withColumn("source", F.lit("h"))).collect()}[6] == 0
    encoded = [(d, library.encode(t, add_special_tokens=False).ids) for d, t in rows]
    got = {r.doc_id: r.ids_sha256 for r in bpe_reuse.encode(frame, queries.tokenizer(), mean=1 << 20).collect()}
    assert got == {d: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for d, ids in encoded}


def test_hashes_are_those_of_the_prime():
    rng = np.random.default_rng(5)
    prime, data = int(core.PRIME), rng.integers(0, 256, 300).astype(np.uint8)
    a, b = rng.integers(0, prime, 500, dtype=np.uint64), rng.integers(0, prime, 500, dtype=np.uint64)
    assert core.times(a, b).tolist() == [x * y % prime for x, y in zip(a.tolist(), b.tolist())]
    want = [0]
    for i, c in enumerate(data.tolist()):
        want.append((want[-1] + (c + 1) * pow(core._BASE, i, prime)) % prime)
    assert core.Hashes(data).sums.tolist() == want


def test_a_chunk_whose_digest_is_another_ones(library):
    bpe, text = byte_bpe.load(queries.tokenizer()), b"some words stand here, and some more of them there "
    wrong = {7: np.array(bpe.encode("quite another chunk "), np.uint32)}
    assert bpe_reuse.assemble(bpe, text, [(0, 23), (23, len(text))], wrong, [7, 7]).tolist() == library.encode(text.decode(), add_special_tokens=False).ids


def test_repeats_of_another_length_and_kept_texts(docs):
    got = suffix_dedup.repeats(docs, passage=60)
    match(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), repeats_brute(texts()))
    match(got.select("doc_id", "n_bytes", "passage_removed", "passage_spans"), [(d, n, gone, runs) for d, n, gone, runs, _ in repeats_brute(texts(), 60)])
    for r in got.where("n_spans > 0").collect():
        assert len(r.kept.encode()) <= r.n_bytes - r.n_removed
    assert got.where("n_spans = 0 and kept is not null").count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.Shape(8)


def test_token_counts_of_texts_without_spaces(library):
    rng, bpe = random.Random(3), byte_bpe.load(queries.tokenizer())
    pools = [[chr(c) for c in range(0x4E00, 0x4E80)], [*map(chr, range(0x4E00, 0x4E40)), "\u3002", "\uff0c"], [chr(c) for c in range(0xE01, 0xE3A)], [*map(chr, range(0x430, 0x450)), " "], [*"ab1'<|>s \u3002\u4e2d\u00e9\n\u00a0\u3000 \u0663", "<|endoftext|>", "'s", "<|endof"]]
    for pool in pools:
        text = "".join(rng.choice(pool) for _ in range(6000))
        want = library.encode(text, add_special_tokens=False).ids
        assert {token_count.count_spliced(bpe, text.encode(), chunk, overlap) for chunk, overlap in ((700, 8), (2000, 64), (50, 4))} == {len(want)}
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, digest = bpe_reuse.digests(data, np.array([0, len(data)]), 64)
        assert bpe_reuse.assemble(bpe, text.encode(), list(zip(starts.tolist(), ends.tolist())), {}, digest.tolist()).tolist() == want


def test_token_counts_take_time_in_proportion_to_the_text():
    bpe, encoded = byte_bpe.load(queries.tokenizer()), []

    class Counting:
        lengths, special = bpe.lengths, bpe.special

        def encode(self, text):
            encoded.append(len(text))
            return bpe.encode(text)

    for n in (40_000, 160_000):
        encoded.clear()
        token_count.count_spliced(Counting(), "".join(chr(0x4E00 + i * i % 97) for i in range(n)).encode(), 1 << 12, 64)
        assert sum(encoded) <= 8 * n


def test_url_filter_of_unreadable_times_and_ipv6(spark):
    events = url_filter.events_table(spark, [("l", "domain", "[2001:db8::1]", "add", "2024-01-01"), ("l", "domain", "b.org", "add", "31st of May"), ("l", "prefix", "[::1]/x", "add", "2024-01-01")])
    rows = [(1, "http://[2001:DB8::1]:80/z", "2024-02-01"), (2, "http://b.org/", "2024-02-01"), (3, "http://[::1]/x/y", "2024-02-01"), (4, "http://[2001:db8::1]/", "yesterday")]
    frame = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumns({"host": F.lit("x"), "value": F.lit("x"), "list": F.lit("x"), "row": F.lit(1)})
    match(url_filter.url_filter(frame, events).select("page_id", "matched"), [(1, "l:domain:[2001:db8::1]"), (2, ""), (3, "l:prefix:[::1]/x"), (4, "")])
    assert url_filter.url_filter(frame.where("false"), events).count() == 0
    assert url_filter.url_filter(frame, events.where("false")).where("blocked").count() == 0


def test_gradient_of_the_moves_against_finite_differences():
    rng = np.random.default_rng(1)
    first, scores, moves = np.array([0, 0, 4, 5, 9]), rng.normal(size=(9, 3)), rng.normal(size=(3, 3))

    def log_sum(inner):
        total = 0.0
        for a, b in zip(first[:-1], first[1:]):
            if b > a:  # a row's first word has a move from all states alike, which stays as it is
                each = [np.log(np.exp(moves[:, path[0]]).sum()) + sum(scores[a + i, x] for i, x in enumerate(path)) + sum(inner[x, y] for x, y in zip(path, path[1:])) for path in itertools.product(range(3), repeat=b - a)]
                total += np.logaddexp.reduce(each)
        return total

    got, expected = langid.expected_moves(scores, first, moves)
    assert np.allclose(got, langid.marginals(scores, first, moves))
    for i, j in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        assert abs((log_sum(moves + step) - log_sum(moves - step)) / 2e-5 - expected[i, j]) < 1e-6


def test_language_query_holds_out_by_crc(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    learned = {d.lang for d in docs.values() if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2}
    assert all(r.lang_pred in learned | {"und"} and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang and len(docs[r.doc_id].text or "") > 40]
    assert sum(judged) >= 0.9 * len(judged)


def test_language_does_not_depend_on_more_columns_copies_or_order(spark):
    rows = [(i, "ka to mi ka to" if i % 2 else "schl ung schl ung", "xx" if i % 2 else "yy") for i in range(40)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(3)).withColumn("spot", F.lit("x"))
    one, two = langid.train(frame, sequences=100, epochs=1), langid.train(frame.orderBy(F.desc("doc_id")), sequences=100, epochs=1)
    assert one.languages == two.languages == ["xx", "yy"] and np.array_equal(one.weights, two.weights)
    test = spark.createDataFrame([(1, "ka ka", 1), (1, "ka ka", 1), (2, "", 1)], "doc_id long, text string, score int")
    match(langid.predict(test, one).select("doc_id", "lang_pred"), [(1, "xx"), (1, "xx"), (2, "und")])
    assert langid.predict(test.where("false"), one).count() == 0


def test_leaks_of_very_short_items_with_edits(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(n, word(n)) for n in range(5, 12)]
    rows = [(i, word(20) + t[:2] + "#" + t[3:] + word(20)) for i, t in items] + [(50, items[0][1]), (51, "")]
    want = leaks_brute(rows, items)
    assert len(want) >= 7 and {k: v for k, v in leaks_found(spark, rows, items).items()} == {k: v for k, v in want.items() if k[0] != 51}


def test_leaks_do_not_depend_on_partitions_or_copies(spark):
    rng = random.Random(13)
    items = [(i, prose(25, rng).strip()) for i in range(12)]
    rows = [(i, prose(rng.randrange(0, 60), rng) + edited(t, len(t) // 6, rng) + prose(20, rng)) for i, t in items] + [(100, items[3][1])] * 3 + [(101, prose(20_000, rng) + items[4][1] + prose(9000, rng)), (None, items[5][1]), (102, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "start": F.lit(2), "distance": F.lit(None).cast("int")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    results = [sorted(map(repr, (tuple(r) for r in decontam.leaks(frame.repartition(n), bench).collect()))) for n in (1, 7)]
    assert results[0] == results[1] and sum(r.startswith("(100, 3, 0") for r in results[0]) == 3 and any(r.startswith("(101, 4, 0") for r in results[0]) and any(r.startswith("(None, 5, 0") for r in results[0])


def test_patterns_are_those_of_one_at_a_time():
    rng = random.Random(3)
    texts_ = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    data = bytes(rng.choice(b"abcd") for _ in range(4000))
    item, start = np.array([rng.randrange(40) for _ in range(300)]), np.array([rng.randrange(3500) for _ in range(300)])
    stop = start + np.array([rng.randrange(1, 400) for _ in range(300)])
    best, end = decontam.Patterns(texts_).distances(np.frombuffer(data, np.uint8), item, start, stop)
    for k in range(300):
        assert decontam.best_place(texts_[item[k]], data[start[k] : stop[k]]) == (best[k], end[k])


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf)  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        core.shared_dir(Session)


def test_very_long_conversation(spark):
    frame = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text <| ', id) AS text", "1 AS piece")
    got = chat.digests(chat.pieces(frame)).collect()
    want = "".join(f"text <| {i}" for i in range(1, 30_000, 2))
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in got] == [(7, 30_000, len(want), hashlib.sha256(want.encode()).hexdigest())]


def test_licences_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "MIT License", 9)], "doc_id long, text string, n_words int").withColumns({"labels": F.lit(1), "score": F.lit("x")})
    match(license_scan.scan(frame).select("doc_id", "n_words", "base_labels"), [(1, 2, "mit")])


def test_a_longer_length_is_sought_in_the_runs_of_the_shorter_one(spark, monkeypatch):
    """Repeats that overlap, touch and stand at the ends of texts; the second length sees their bytes alone."""
    rng = random.Random(44)
    a, b, c = ("".join(rng.choice("abcdefghij é") for _ in range(n)) for n in (150, 90, 64))

    def odd(n):
        return "".join(rng.choice("klmnopqrst ü") for _ in range(n))

    bodies = [a + b, b + a, a, odd(50) + b + odd(200), odd(300) + a[:120] + odd(1) + a[20:], b[:70] + odd(9) + c, c + odd(400) + c, odd(900), odd(30) + a + c + odd(30), odd(2000), "", None]
    rows = list(enumerate(bodies)) + [(3, bodies[3]), (None, bodies[4])]
    sought, method = {}, suffix_dedup.suffixes

    def seen(docs, batches, shape):
        lists = docs.select("runs").collect() if "runs" in docs.columns else None
        sought[shape.length] = sum(x.stop - x.start for r in lists for x in r.runs) if lists is not None else None
        return method(docs, batches, shape)

    monkeypatch.setattr(suffix_dedup, "suffixes", seen)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for length, passage in ((100, 60), (60, 100)):
        sought.clear()
        got = suffix_dedup.repeats(frame, length=length, passage=passage)
        match(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), repeats_brute(rows, length))
        match(got.select("doc_id", "n_bytes", "passage_removed", "passage_spans"), [(d, n, gone, runs) for d, n, gone, runs, _ in repeats_brute(rows, passage)])
        assert sought[60] is None and 0 < sought[100] < sum(len((t or "").encode()) for _, t in rows) / 2
