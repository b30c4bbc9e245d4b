"""Licence scans (2): a generalised suffix automaton of licence templates, matching statistics of
every text against it, and chains of long matches as covered template spans.

Method. The automaton holds the word sequences of all templates. For each word of a text, its
matching statistic is the longest run of words ending there that stands in some template. Where a
word and the one before it are next to each other in no template, the statistic is below two; the
pass finds all other places with array operations and walks the automaton there only. Matches that
can't be extended are chained by template, in the order of both text and template; a template is
labelled where its chain covers ``min_cover`` of it. The base phrases are templates too: each place
where one stands is counted, and gives its label.

Defined cases. Null or empty text: no words, no labels, score 0. Repeated rows: a result each.
Overlapping places all count. Very long texts are walked whole. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import ALNUM, LOWER, Hashes, slices, words

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening sentences of well-known licences, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("all-rights-reserved", "All rights reserved"),
)
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,cover:double>>"


def tokens(text: str) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


class Automaton:
    """A suffix automaton of several word sequences (Blumer et al. 1985), built one after another."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: for each state, a place (the end) where its strings stand in each text that has them
        self.places: list[dict[int, int]] = [{}]
        for number, text in enumerate(texts):
            last = 0
            for end, word in enumerate(text):
                last = self._extend(last, word)
                self.places[last].setdefault(number, end + 1)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for number, end in self.places[state].items():
                up = self.places[self.link[state]]
                up[number] = min(up.get(number, end), end)

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        self.places.append({})
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The part of ``target`` that ends the strings of ``state`` plus ``word``."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, target)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (there := self.next[last].get(word)) is not None:
            return self._split(last, word, there)
        state = self._new(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        self.link[state] = 0 if last < 0 else self._split(last, word, self.next[last][word])
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    """The automaton with what each state says, and the tables that find where to walk it."""

    def __init__(self, base: dict[str, str], templates: Sequence[tuple[str, str]], min_match: int, min_cover: float):
        texts = [tokens(x) for x in base] + [tokens(x) for _, x in templates]
        self.labels = [*base.values(), *(label for label, _ in templates)]
        self.base, self.min_match, self.min_cover = len(base), min_match, min_cover
        if any(len(t) < 2 for t in texts):
            raise ValueError("a template needs two words or more")
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.coded = [[number[w] for w in t] for t in texts]
        flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary])
        hashes = Hashes(flat)(ends - [len(w) for w in vocabulary], ends)
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], (order + 1).astype(np.int32)
        self.pairs = np.zeros((len(vocabulary) + 1,) * 2, bool)
        for t in self.coded:
            self.pairs[t[:-1], t[1:]] = True
        self.automaton = a = Automaton(self.coded)
        self.phrases: list[list[int]] = [[] for _ in a.link]  # base phrases that end a state's strings
        home = {}
        for p in range(self.base):
            state = length = 0
            for word in self.coded[p]:
                state, length = a.step(state, length, word)
            home[state] = p
        for state in range(1, len(a.link)):
            up = state
            while up > 0:
                if up in home:
                    self.phrases[state].append(home[up])
                up = a.link[up]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.codes[at], 0)

    def walk(self, codes: list[int], start: int, places: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        """Matching statistics over a run of words: places (phrase, start) and the matches (state,
        length, end) that the next word doesn't extend."""
        a, state, length = self.automaton, 0, 0
        for i, word in enumerate(codes):
            to, longer = a.step(state, length, word)
            if longer != length + 1 and length >= 2:
                matches.append((state, length, start + i))
            state, length = to, longer
            for p in self.phrases[state]:
                if length >= len(self.coded[p]):
                    places.append((p, start + i + 1 - len(self.coded[p])))
        if length >= 2:
            matches.append((state, length, start + len(codes)))

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, start, stop, cover) of the template spans that chained matches cover."""
        spans = []
        for t in range(self.base, len(self.coded)):  # base phrases are found as places
            size = len(self.coded[t])
            parts = []
            for state, length, end in matches:
                if length >= min(self.min_match, size) and (at := self.automaton.places[state].get(t)) is not None:
                    parts.append((end - length, end, at - length, at))
            i = 0
            while i < len(parts):
                start, stop, _, done = parts[i]
                covered, i = stop - start, i + 1
                while i < len(parts) and parts[i][3] > done and parts[i][0] - stop <= size:
                    fresh = min(parts[i][1] - max(parts[i][0], stop), parts[i][3] - max(parts[i][2], done))
                    covered, stop, done, i = covered + max(fresh, 0), parts[i][1], parts[i][3], i + 1
                if covered >= self.min_cover * size:
                    spans.append((self.labels[t], start, stop, min(1.0, covered / size)))
        return sorted(spans)


def scan(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES, min_match: int = 4, min_cover: float = 0.6) -> DataFrame:
    """One row of ``RESULT`` for each document. One pass, no shuffle."""

    def run(batches):
        scanner = Scanner(base, templates, min_match, min_cover)
        for rows, data, offsets in slices(batches, "text"):
            data = LOWER[data]
            starts, ends, first = words(data, offsets, ALNUM)
            codes = scanner.encode(Hashes(data)(starts, ends)) if len(starts) else np.empty(0, np.int32)
            joined = np.zeros(len(codes) + 1, bool)  # word i follows word i-1 in some template and in its row
            joined[1:-1] = scanner.pairs[codes[:-1], codes[1:]]
            joined[first] = False
            edge = np.diff(joined.astype(np.int8))
            begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            found: dict[int, tuple[list, list]] = {}
            for b, e, r in zip(begins.tolist(), stops.tolist(), (np.searchsorted(first, begins, "right") - 1).tolist()):
                places, matches = found.setdefault(r, ([], []))
                scanner.walk(codes[b:e].tolist(), b - int(first[r]), places, matches)
            out = []
            for r, (doc, n) in enumerate(zip(rows.column("doc_id").to_pylist(), np.diff(first).tolist())):
                places, matches = found.get(r, ((), ()))
                spans = scanner.chain(matches) if matches else []
                at = [p[1] for p in places]
                basic = sorted({scanner.labels[p] for p, _ in places})
                out.append((doc, n, len(at), min(at, default=None), max(at, default=None), ",".join(basic), ",".join(sorted({*basic, *(s[0] for s in spans)})), max([float(bool(at)), *(s[3] for s in spans)]), [dict(zip(("label", "start", "stop", "cover"), s)) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())])))])
