"""Benchmark decontamination (1): passages of benchmark items in documents, edits included.

Method. Texts are lower-cased (A-Z) with white space folded. The CGK embedding (Chakraborty, Goldenberg
and Koucky 2016) walks along a text: at each step it emits the byte that it stands on and moves on by a
random bit that depends on the step and the byte. Two texts at a small edit distance fall into step
again after an edit, so their walks are at a small Hamming distance. Bit sampling keys a walk by the
bytes of some of its steps; equal keys propose a place. Walks start at every byte of items and texts
(so spaces don't matter), in ``REPETITIONS`` independent repetitions. The proposals of an item are
counted by diagonal (place in the text less place in the item) over windows of the item's size; windows
with enough of them are verified by edit distance (bit-parallel, Myers 1999, many windows at a time).

What is enough follows from ``recall``: for each class of lengths, copies of items with as many random
edits as the threshold allows are keyed, and the count that all but 1 - recall of them reach is asked
for, of the longest walks of ``LADDER`` where that is one proposal at least. Items too short for any
(about 12 bytes at similarity 0.8) are compared with every place of every text, so that none is passed
over for its size.

Scale. One pass over the documents for each block of ``block`` items; items are the stated query set
and reach executors in blocks of bounded size. Nothing is shuffled, and memory is bounded by a slice.
What is found in a document depends on its text and the items alone, not on its place in a batch.

Defined cases. Null or empty texts and items: no leak. An item that stands in a text is found whatever
its length; one of which a text has a part only, where that is within the threshold. Repeated rows:
a result each. Ties: the leftmost window of least distance. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import LOWER, NOT_SPACE, U, slices

RESULT = "doc_id long, item_id long, distance long, similarity double, start long, stop long"
#: Walks, longest first: (steps, 32 at most, and how many of them are sampled). A walk of n steps covers
#: about n / 2 bytes.
LADDER = ((32, 16), (24, 12), (16, 8), (10, 6))
REPETITIONS = 3
TABLE, RUN, HITS, LANES = 20, 1 << 14, 1 << 20, 1 << 12
PAD = LADDER[0][0]  # zeros after each row, so that no walk reaches the next


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, runs of white space as one space, none at the ends of rows: (bytes, offsets,
    where each byte was)."""
    ink = NOT_SPACE[data]
    keep = ink.copy()
    keep[1:] |= ink[:-1]  # the first space after a word
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    keep[inner] = ink[inner]
    at = np.flatnonzero(keep)
    out = np.where(ink[at], LOWER[data[at]], 32).astype(np.uint8)
    bounds = np.searchsorted(at, offsets)
    lead = np.zeros(len(out), bool)  # spaces that end a row
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    lead[ends] = out[ends] == 32
    stay = np.flatnonzero(~lead)
    return out[stay], np.searchsorted(stay, bounds), at[stay]


def fold_text(text: str) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return fold(raw, np.array([0, len(raw)]))[0].tobytes()


class Walks:
    """One repetition: the moves, and which steps are sampled."""

    def __init__(self, level: int, repetition: int):
        rng = np.random.default_rng((57, level, repetition))
        self.steps, sampled = LADDER[level]
        self.moves = rng.integers(0, 2, (self.steps, 256)).astype(bool)
        self.sampled = np.zeros(self.steps, bool)
        self.sampled[rng.permutation(self.steps)[:sampled]] = True
        self.bits = (self.moves.T << np.arange(self.steps, dtype=np.uint32)).sum(1, dtype=np.uint32)  # a byte's moves
        self.values = rng.integers(0, 1 << 32, 256, dtype=np.uint32)
        self.factors = rng.integers(0, 1 << 31, self.steps, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def keys(self, data: np.ndarray) -> np.ndarray:
        """The key of the walk from each byte on. ``data`` ends with PAD zeros; these have none.

        A walk from a byte at a step goes on, at the next step, from this byte or the one after it. So
        all walks are made together, from the last step back."""
        n = len(data) - PAD
        out = np.empty(n, np.uint32)
        for a in range(0, n, RUN):
            part = data[a : a + RUN + PAD]
            value, moves, key = self.values[part], self.bits[part], np.zeros(len(part) + 1, np.uint32)
            here, after, change, mask = key[:-1], key[1:], np.empty(len(part), np.uint32), np.empty(len(part), np.uint32)
            signed = mask.view(np.int32)
            for t in range(self.steps - 1, -1, -1):
                np.left_shift(moves, np.uint32(31 - t), out=mask)
                np.right_shift(signed, 31, out=signed)  # all ones where the walk moves on
                np.bitwise_xor(here, after, out=change)
                np.bitwise_and(change, mask, out=change)
                np.bitwise_xor(here, change, out=here)
                if self.sampled[t]:
                    np.multiply(here, self.factors[t], out=here)
                    np.add(here, value, out=here)
            out[a : a + RUN] = key[: min(RUN, n - a)]
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x85EBCA6B)
        return out ^ (out >> np.uint32(13))

    def ends(self, data: np.ndarray) -> np.ndarray:
        """Where the walk from each byte ends; ``data`` as for keys()."""
        end = np.arange(len(data) + 1)
        for t in range(self.steps - 1, -1, -1):
            end[:-1] = np.where(self.moves[t][data], end[1:], end[:-1])
        return end[: len(data) - PAD]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with PAD zeros after each text, where each begins, and the end)."""
    zeros = bytes(PAD)
    return np.frombuffer(b"".join(x + zeros for x in texts), np.uint8), np.cumsum([0, *(len(x) + PAD for x in texts)])


class Index:
    """The keys of items at one level of the ladder, by repetition."""

    def __init__(self, level: int, texts: list[bytes], slack: list[int]):
        data, begin = padded(texts)
        self.size, self.slack = np.array([len(x) for x in texts]), np.array(slack)
        self.wide = np.maximum(16, self.slack + 1)  # a match's diagonals lie in two neighbouring bins
        self.walks = [Walks(level, r) for r in range(REPETITIONS)]
        self.tables = []
        for walks in self.walks:
            at = np.arange(begin[-1] - PAD)
            item = np.searchsorted(begin, at, "right") - 1
            place = at - begin[item]
            inside = walks.ends(data) - begin[item] < self.size[item]  # the walk stays in the item
            key, item, place = walks.keys(data)[inside], item[inside], place[inside]
            order = np.argsort(key, kind="stable")
            there = np.zeros(1 << TABLE, bool)
            there[key >> np.uint32(32 - TABLE)] = True
            self.tables.append((there, key[order], item[order], place[order]))

    def proposals(self, data: np.ndarray, row: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, diagonal) of equal keys, HITS or so at a time. ``begin``: where rows begin."""
        for walks, (there, keys, items, places) in zip(self.walks, self.tables):
            key = walks.keys(data)
            at = np.flatnonzero(there[key >> np.uint32(32 - TABLE)])
            low, high = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            some = high > low
            at, low, n = at[some], low[some], (high - low)[some]
            ends, i = np.cumsum(n), 0
            while i < len(at):
                done = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, done + HITS, "right")))
                entry = np.repeat(low[i:j] - (ends[i:j] - n[i:j] - done), n[i:j]) + np.arange(int(ends[j - 1]) - done)
                where = np.repeat(at[i:j], n[i:j])
                r = np.searchsorted(begin, where, "right") - 1
                yield row[r], items[entry], where - begin[r] - places[entry]
                i = j

    def counted(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, how many, least and largest diagonal) of the proposals in each two neighbouring
        bins of diagonals. The bins are the row's own."""
        shape = (len(begin), len(self.size))
        base = int(self.size.max()) + 1
        room = int((np.diff(begin).max() + base) // 16) + 3
        held = np.empty((4, 0), np.int64)
        for row, item, diagonal in self.proposals(data, np.arange(len(begin)), begin[:-1]):
            bin_ = (diagonal + base) // self.wide[item]
            fresh = np.stack([(row * shape[1] + item) * room + bin_, np.ones_like(bin_), diagonal, diagonal])
            held = _summed(np.concatenate([held, _summed(fresh)], axis=1))
        if not held.shape[1]:
            return (np.empty(0, np.int64),) * 5
        cell, n, low, high = held
        pair = np.flatnonzero(np.diff(cell) == 1)  # bins that both have proposals
        n, low, high = n.copy(), low.copy(), high.copy()
        n[pair] += held[1, pair + 1]
        low[pair], high[pair] = np.minimum(low[pair], held[2, pair + 1]), np.maximum(high[pair], held[3, pair + 1])
        return cell // room // shape[1], cell // room % shape[1], n, low, high


def _summed(rows: np.ndarray) -> np.ndarray:
    """One column for each cell: (cell, sum, least, largest)."""
    order = np.argsort(rows[0], kind="stable")
    rows = rows[:, order]
    first = np.flatnonzero(np.append(True, np.diff(rows[0]) != 0)) if rows.shape[1] else np.empty(0, np.int64)
    if not len(first):
        return rows
    return np.stack([rows[0, first], np.add.reduceat(rows[1], first), np.minimum.reduceat(rows[2], first), np.maximum.reduceat(rows[3], first)])


def edited_copy(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    out = list(text)
    for kind, place, value in zip(rng.integers(0, 3, edits).tolist(), rng.random(edits).tolist(), rng.integers(0, len(text), edits).tolist()):
        at = int(place * len(out))
        if kind == 0 and out:
            out[at] = text[value]
        elif kind == 1:
            out.insert(at, text[value])
        elif out:
            out.pop(at)
    return bytes(out)


def enough(texts: list[bytes], slack: list[int], recall: float, trials: int = 300) -> tuple[int, int] | None:
    """(level, proposals to ask for) for items of like length, or None if no level reaches the
    recall. Measured on copies with ``slack`` random edits each, the most that are allowed."""
    rng = np.random.default_rng(len(texts[0]))
    trials = max(60, min(trials, (1 << 20) // max(map(len, texts))))
    which = [int(x) for x in rng.integers(0, len(texts), trials)]
    copies = [edited_copy(texts[i], slack[i], rng) for i in which]
    data, begin = padded(copies)
    known = sorted(set(which))
    number = {i: k for k, i in enumerate(known)}
    for level in range(len(LADDER)):
        index = Index(level, [texts[i] for i in known], [slack[i] for i in known])
        row, item, n, _, _ = index.counted(data, begin)
        best = np.zeros(trials, np.int64)
        own = np.array([number[i] for i in which])
        hit = own[row] == item
        np.maximum.at(best, row[hit], n[hit])
        least = int(np.sort(best)[int((1 - recall) * trials)])
        if least >= 1:
            return level, least
    return None


class Items:
    """A block of items, with what proposes and verifies places."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float):
        folded = sorted((len(t), i, t) for i, t in ((i, fold_text(x)) for i, x in items) if t)
        self.texts = [(i, t) for _, i, t in folded]
        self.size = np.array([len(t) for _, t in self.texts], np.int64)
        self.slack = np.array([int((1 - similarity) * len(t) + 1e-9) for _, t in self.texts], np.int64)
        alike: dict[int, list[int]] = {}
        for n, (_, t) in enumerate(self.texts):
            alike.setdefault(int(4 * math.log2(len(t))), []).append(n)
        self.everywhere, by_level = [], {}
        self.least = np.ones(len(self.texts), np.int64)
        for own in alike.values():
            found = enough([self.texts[n][1] for n in own], self.slack[own].tolist(), recall)
            if found is None:
                self.everywhere += own
            else:
                by_level.setdefault(found[0], []).extend(own)
                self.least[own] = found[1]
        self.levels = [(np.array(own), Index(level, [self.texts[n][1] for n in own], self.slack[own].tolist())) for level, own in sorted(by_level.items())]
        self.patterns = Patterns([t for _, t in self.texts])

    def regions(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Columns (row, item, start, stop), in order, places within rows: what is to be verified;
        overlapping ones of a row and item merged. ``data``, ``begin``: as of padded()."""
        out = [np.empty((4, 0), np.int64)]
        for own, index in self.levels:
            row, item, n, low, high = index.counted(data, begin)
            item = own[item]
            keep = n >= self.least[item]
            row, item, low, high = row[keep], item[keep], low[keep], high[keep]
            out.append(np.stack([row, item, low - self.slack[item], high + self.size[item] + self.slack[item]]))
        for n in self.everywhere:
            rows = np.flatnonzero(size)
            out.append(np.stack([rows, np.full(len(rows), n), np.zeros(len(rows), np.int64), size[rows]]))
        row, item, start, stop = np.concatenate(out, axis=1)
        start, stop = np.maximum(start, 0), np.minimum(stop, size[row])
        order = np.lexsort((start, item, row))
        order = order[(stop - start >= self.size[item] - self.slack[item])[order] & (stop > start)[order]]
        row, item, start, stop = row[order], item[order], start[order], stop[order]
        if not len(row):
            return np.stack([row, item, start, stop])
        group = np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0))
        far = np.maximum.accumulate(stop + np.cumsum(group) * (1 << 40)) - np.cumsum(group) * (1 << 40)  # the furthest stop so far
        new = group.copy()
        new[1:] |= start[1:] > far[:-1]
        first = np.flatnonzero(new)
        return np.stack([row[first], item[first], start[first], np.maximum.reduceat(stop, first)])


class Patterns:
    """Least edit distances of items to stretches of text, many at a time (Myers 1999, in words of 64
    bits)."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        used = np.unique(np.frombuffer(b"".join(texts), np.uint8))
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        self.masks, self.of = {}, np.zeros(len(texts), np.int64)
        self.words = (self.size + 127) // 128 * 2  # few kinds, so that many run side by side
        for words in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == words)
            self.of[own] = np.arange(len(own))
            masks = np.zeros((words, len(own), len(used) + 1), U)
            for k, n in enumerate(own.tolist()):
                at = np.arange(len(texts[n]))
                np.bitwise_or.at(masks, (at // 64, k, self.code[np.frombuffer(texts[n], np.uint8)]), U(1) << (at % 64).astype(U))
            self.masks[words] = masks

    def distances(self, data: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least distance of the item to a substring of data[start:stop], the first place where one
        of these ends, counted from ``start``)."""
        best, end = self.size[item].copy(), np.zeros(len(item), np.int64)
        words = self.words[item]
        code = self.code[data]
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            own = own[np.argsort(start[own] - stop[own], kind="stable")]  # the longest stretches first
            for k in range(0, len(own), LANES):
                some = own[k : k + LANES]
                best[some], end[some] = self._run(code, self.masks[w], self.of[item[some]], self.size[item[some]], start[some], stop[some] - start[some])
        return best, end

    @staticmethod
    def _run(code, masks, number, size, start, length):
        words, n = len(masks), len(number)
        vp, vn = np.full((words, n), ~U(0)), np.zeros((words, n), U)
        top, last = ((size - 1) % 64).astype(U), (size - 1) // 64 + 1
        score, best, end = size.copy(), size.copy(), np.zeros(n, np.int64)
        one = U(1)
        running = np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist()
        for j, m in enumerate(running):
            symbol, own = code[start[:m] + j], number[:m]
            up = down = np.zeros(m, U)  # what the bits below hand on: +1, -1
            for w in range(words):
                eq, p, q = masks[w, own, symbol], vp[w, :m], vn[w, :m]
                xv = eq | q
                eq |= down
                xh = (((eq & p) + p) ^ p) | eq
                hp, hn = q | ~(xh | p), p & xh
                if w + 2 >= words:  # the item ends in one of the last two words
                    ends = last[:m] == w + 1
                    score[:m] += np.where(ends, (hp >> top[:m]) & one, 0).astype(np.int64) - np.where(ends, (hn >> top[:m]) & one, 0).astype(np.int64)
                up_next, down_next = hp >> U(63), hn >> U(63)
                hp, hn = (hp << one) | up, (hn << one) | down
                vp[w, :m], vn[w, :m] = hn | ~(xv | hp), hp & xv
                up, down = up_next, down_next
            less = np.flatnonzero(score[:m] < best[:m])
            best[less], end[less] = score[less], j + 1
        return best, end


def _masks(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_place(pattern: bytes, text: bytes, masks: dict[int, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to ``pattern``; the first such end."""
    masks = _masks(pattern) if masks is None else masks
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best[0]:
                best = (score, j + 1)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
    return best


def nearest(pattern: bytes, text: bytes, masks: dict[int, int] | None = None) -> tuple[int, int, int]:
    """(distance, start, end) of the nearest substring: least distance, first end, then shortest."""
    distance, end = best_place(pattern, text, masks)
    _, back = best_place(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


class Search:
    """Finds places to verify slice by slice, and verifies many at a time."""

    def __init__(self, table: Items):
        self.table, self.held, self.lanes = table, [], 0

    def add(self, ids: list, raw: np.ndarray, raw_offsets: np.ndarray) -> list[tuple]:
        """Takes in the rows of a flat text column; gives leaks of these or earlier ones."""
        table = self.table
        data, offsets, origin = fold(raw, raw_offsets)
        whole, size = data.tobytes(), np.diff(offsets)
        walked, begin = padded([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        row, item, start, stop = table.regions(walked, begin, size)
        # long stretches in parts that overlap by as much as a match takes
        step = np.maximum(256, 4 * table.size[item])
        parts = np.maximum(1, -(-(stop - start) // step))
        which = np.repeat(np.arange(len(row)), parts)
        a = start[which] + (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * step[which]
        b = np.minimum(a + step[which] + table.size[item[which]] + table.slack[item[which]], stop[which])
        row, item = row[which], item[which]
        for k in range(0, len(row), LANES):
            n = (b - a)[k : k + LANES]
            at = np.repeat((offsets[row] + a)[k : k + LANES] - np.cumsum(n) + n, n) + np.arange(n.sum())
            self.held.append((ids, row[k : k + LANES], item[k : k + LANES], n, data[at], (origin[at] - np.repeat(raw_offsets[row[k : k + LANES]], n)).astype(np.int32 if len(raw) < 1 << 31 else np.int64)))
            self.lanes += len(n)
        return self.close() if self.lanes >= LANES else []

    def close(self) -> list[tuple]:
        """(doc_id, number of the item, distance, start, stop) of the leaks in what is held."""
        if not self.held:
            return []
        ids, rows, items, sizes, data, origin = zip(*self.held)
        self.held, self.lanes = [], 0
        table, item, n = self.table, np.concatenate(items), np.concatenate(sizes)
        stop, data, origin = np.cumsum(n), np.concatenate(data), np.concatenate(origin)
        distance, end = table.patterns.distances(data, item, stop - n, stop)
        lists: dict[int, int] = {}  # the lists of ids, each row a document of its own
        home = np.repeat([lists.setdefault(id(x), k) for k, x in enumerate(ids)], [len(x) for x in rows])
        row, best = np.concatenate(rows), {}
        for k in np.flatnonzero(distance <= table.slack[item]).tolist():
            key, d = (int(home[k]), int(row[k]), int(item[k])), int(distance[k])
            if key not in best or d < best[key][0]:
                first, text = int(stop[k] - n[k]), table.texts[key[2]][1]
                _, back = best_place(text[::-1], data[first : first + int(end[k])].tobytes()[::-1])
                if d < len(text) and back:
                    last = first + int(end[k]) - 1
                    best[key] = (d, int(origin[last + 1 - back]), int(origin[last]) + 1)
        return [(ids[h][r], i, *x) for (h, r, i), x in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = 0.8, block: int = 4096, recall: float = 0.995) -> DataFrame:
    """(doc_id, item_id, distance, similarity, start, stop) for each document and item whose best
    window has an edit similarity 1 - distance / item length from ``similarity`` on; start and stop
    are byte offsets in the document's text. The best window is the one of least distance; lengths
    and distances are of folded bytes. ``recall``: the share of leaks at the threshold that the
    search is to find; nearer ones are found more often, and what is found is exact."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["b"] or 0) // (1 << 23)))

    def search(own: list[tuple[int, str]]):
        table = docs.sparkSession.sparkContext.broadcast(own)  # a block of items

        def run(batches):
            known = Items(table.value, similarity, recall)
            search = Search(known)

            def told(found):
                out = [(doc, known.texts[n][0], d, 1 - d / len(known.texts[n][1]), x, y) for doc, n, d, x, y in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 3 else pa.int64()) for k, c in enumerate(zip(*out))], names=["doc_id", "item_id", "distance", "similarity", "start", "stop"])

            for rows, raw, raw_offsets in slices(batches, "text") if known.texts else ():
                yield from told(search.add(rows.column("doc_id").to_pylist(), raw, raw_offsets))
            yield from told(search.close())

        return docs.mapInArrow(run, RESULT)

    out = None
    for k in range(blocks):
        own = [tuple(x) for x in (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)).collect()]
        out = search(own) if out is None else out.unionByName(search(own))
    return out
