"""Language ID (9): a linear-chain conditional random field over the words of a text.

Method. A word's state is its language. Its score sums learned weights of hashed features: affixes of
one to three bytes, byte trigrams with word edges, the word itself if it is in the lexicon of words
that the training sample has often, and its shape. Transitions between languages are learned too, from
sequences that switch between pieces of documents of several languages. Forward-backward gives each
word's probabilities; a text's are their mean, and the best is the prediction, its mean the score.

Training is on a bounded sample: about ``per_language`` documents of each language that occurs (the
model and the time grow with the number of languages), and of each one stretch of up to ``stretch`` characters from a place
chosen by hash. Prediction reads whole texts. Long texts are cut in segments whose transfer matrices
are multiplied up first, so the result is that of the whole sequence.

Defined cases. Null text, or no letter: ``und``, score 0. Rows without lang aren't learned from. No row
to learn from: every text is ``und``. Ties: the first language in order. Repeated rows: a result each.
Only the named columns are read; lang is read for training only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import LOWER, Hashes, Stage, U, byte_class, flat, mix, slices, words

LETTERS = byte_class(b"", (0x61, 0x7A), (0x80, 0xFF))
ASCII_LETTERS = byte_class(b"", (0x41, 0x5A), (0x61, 0x7A))
SLOTS = 1 << 17
SEGMENT = 128
RESULT = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (SLOTS + size of the lexicon + 1, languages)
    moves: np.ndarray  # log weights of transitions, (languages, languages)
    lexicon: np.ndarray  # sorted hashes


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: Hashes, lexicon: np.ndarray) -> list[np.ndarray]:
    """Slots of the word features, one array for each kind."""
    out = []
    for size in (1, 2, 3):
        for k, (a, b) in enumerate(((starts, np.minimum(starts + size, ends)), (np.maximum(ends - size, starts), ends))):
            out.append((mix(hashes(a, b) + U(2 * size + k)) % U(SLOTS)).astype(np.int64))
    whole = hashes(starts, ends)
    at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1) if len(lexicon) else np.zeros(len(starts), np.int64)
    known = lexicon[at] == whole if len(lexicon) else np.zeros(len(starts), bool)
    out.append(SLOTS + np.where(known, at + 1, 0))
    out.append((mix(np.minimum(ends - starts, 12).astype(U) + U(99)) % U(SLOTS)).astype(np.int64))
    return out


def trigram_slots(data: np.ndarray) -> np.ndarray:
    """The slot of the three bytes from each position on (edges of the array as spaces)."""
    padded = np.concatenate([data, np.full(2, 32, np.uint8)]).astype(np.uint32)
    code = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17)).astype(np.int64)


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: Hashes) -> np.ndarray:
    """Scores (words, languages). Trigrams run from one byte before a word to its end."""
    out = np.zeros((len(starts), len(model.languages)), np.float64)
    if not len(starts):
        return out
    for slot in features(data, starts, ends, hashes, model.lexicon):
        out += model.weights[slot]
    spaced = np.where(LETTERS[data], data, 32).astype(np.uint8)
    slot = trigram_slots(spaced)
    low, high = np.maximum(starts - 1, 0), np.maximum(ends - 1, np.maximum(starts - 1, 0) + 1)
    for k in range(out.shape[1]):
        sums = np.concatenate([[0.0], np.cumsum(model.weights[slot, k], dtype=np.float64)])
        out[:, k] += (sums[high] - sums[low]) / (high - low)
    return out


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability of each state at each word of each row; first: of words()."""
    if not len(scores):
        return scores.copy()
    forward, backward, _, _ = forward_backward(scores, first, moves)
    out = forward * backward
    return out / out.sum(1, keepdims=True)


def expected_moves(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, expected number of moves from each state to each, over all rows). A pair's
    probability is that of what comes before, of the move, and of what comes from the second on."""
    forward, backward, e, t = forward_backward(scores, first, moves)
    out = forward * backward
    inner = np.ones(len(scores), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    here = np.flatnonzero(inner)
    pair = forward[here - 1][:, :, None] * t[None] * (e[here] * backward[here])[:, None, :]
    return out / out.sum(1, keepdims=True), (pair / pair.sum((1, 2), keepdims=True)).sum(0)


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(forward and backward messages of each word, up to a factor for each; the weights of words and
    of moves they are made of). Exact over whole rows: segments of a row run side by side, joined by
    their transfer matrices. A row's first word has a move from all states alike."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(1, keepdims=True))
    t = np.exp(moves - moves.max())
    length = np.diff(first)
    pieces = -(-length // SEGMENT)
    row = np.repeat(np.arange(len(length)), pieces)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[row] + within * SEGMENT
    size = np.minimum(length[row] - within * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")  # running segments are always the first ones
    row, within, begin, size = row[order], within[order], begin[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    running = np.searchsorted(-size, -np.arange(int(size.max())), "left")
    # transfer[s] = product of (moves, emission) over segment s's words
    transfer = np.broadcast_to(np.eye(k), (len(row), k, k)).copy()
    for i, m in enumerate(running.tolist()):
        step = transfer[:m] @ t * e[begin[:m] + i][:, None, :]
        transfer[:m] = step / step.sum((1, 2), keepdims=True)
    start, after = np.full((len(row), k), 1.0 / k), np.full((len(row), k), 1.0 / k)
    start_of = np.cumsum(pieces) - pieces
    for j in range(1, int(pieces.max())):  # from each segment to the next of its row
        to = place[start_of[pieces > j] + j]
        back = place[start_of[pieces > j] + j - 1]
        x = np.einsum("sk,skl->sl", start[back], transfer[back])
        start[to] = x / x.sum(1, keepdims=True)
    for j in range(int(pieces.max()) - 1, 0, -1):
        here = place[start_of[pieces > j] + j]
        back = place[start_of[pieces > j] + j - 1]
        x = np.einsum("skl,sl->sk", transfer[here], after[here])
        after[back] = x / x.sum(1, keepdims=True)
    forward, backward = np.empty((n, k)), np.empty((n, k))
    state = start.copy()
    for i, m in enumerate(running.tolist()):
        x = state[:m] @ t * e[begin[:m] + i]
        state[:m] = x / x.sum(1, keepdims=True)
        forward[begin[:m] + i] = state[:m]
    state = after.copy()
    for i in range(len(running) - 1, -1, -1):
        m = int(running[i])
        at = begin[:m] + i
        backward[at] = state[:m]
        x = (state[:m] * e[at]) @ t.T
        state[:m] = x / x.sum(1, keepdims=True)
    return forward, backward, e, t


def sample(docs: DataFrame, text: str, lang: str, per_language: int, stretch: int) -> list[tuple[str, str]]:
    """About ``per_language`` stretches of each language, chosen by hash alone: the first in the order
    of a hash, should more be chosen than twice as many."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    stage = Stage(docs.sparkSession, "languages")
    sizes = stage.write(rows.groupBy("lang").agg(F.count("*").alias("n")), "sizes")  # of a known size for the join
    spot = F.pmod(F.xxhash64("doc_id", F.lit("spot")), F.lit(1 << 30))
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("at")), F.greatest(F.length("text") - stretch, F.lit(1)))
    piece = F.substring("text", start.cast("int"), F.lit(stretch))
    chosen = rows.select("doc_id", "lang", spot.alias("spot"), piece.alias("text")).join(sizes, "lang").where(F.col("spot") < F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")) * (1 << 30))
    n = sizes.count()
    got = chosen.orderBy("spot", "doc_id", "lang", "text").limit(2 * per_language * n).select("doc_id", "lang", "text").collect() if n else []
    stage.drop_all()
    return [(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["lang"], r["text"]))]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 200, stretch: int = 2000, sequences: int = 1500, epochs: int = 4, lexicon_from: int = 5, seed: int = 11) -> Model:
    """Fits the field by AdaGrad on the driver; the sample's size doesn't depend on the corpus."""
    rows = sample(docs, text, lang, per_language, stretch)
    rng = np.random.default_rng(seed)
    languages = sorted({x for x, _ in rows})
    data, offsets = flat(pa.array([x.encode() for _, x in rows], pa.binary())) if rows else (np.empty(0, np.uint8), np.zeros(1, np.int64))
    data = LOWER[data]
    starts, ends, first = words(data, offsets, LETTERS)
    k = len(languages)
    if not len(starts):
        return Model(languages[:0], np.zeros((SLOTS + 1, 0)), np.zeros((0, 0)), np.empty(0, U))
    hashes = Hashes(data)
    values, count = np.unique(hashes(starts, ends), return_counts=True)
    lexicon = values[count >= lexicon_from]
    model = Model(languages, np.zeros((SLOTS + len(lexicon) + 1, k)), np.zeros((k, k)), lexicon)
    kinds = np.stack(features(data, starts, ends, hashes, lexicon), 1)
    slot = trigram_slots(np.where(LETTERS[data], data, 32).astype(np.uint8))
    low, high = np.maximum(starts - 1, 0), np.maximum(ends - 1, np.maximum(starts - 1, 0) + 1)
    label = np.repeat([languages.index(x) for x, _ in rows], np.diff(first))
    of = [np.flatnonzero((np.diff(first) > 0) & (np.array([x for x, _ in rows]) == lang)) for lang in languages]
    of = [x for x in of if len(x)]
    grow, grow_moves = np.full(model.weights.shape, 1e-2), np.full((k, k), 1e-2)
    for _ in range(epochs):
        for batch in range(sequences // 50):
            which, bounds = [], [0]
            for _ in range(50):  # a sequence: pieces of one to four documents of any languages
                parts = []
                for _ in range(int(rng.integers(1, 5))):
                    doc = rng.choice(of[int(rng.integers(len(of)))])
                    size = int(rng.integers(3, 25))
                    at = int(rng.integers(first[doc], max(first[doc] + 1, first[doc + 1] - size)))
                    parts.append(np.arange(at, min(at + size, int(first[doc + 1]))))
                which += parts
                bounds.append(bounds[-1] + sum(map(len, parts)))
            w, f = np.concatenate(which), np.array(bounds)
            n = high[w] - low[w]
            grams = slot[np.repeat(low[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            gram_word = np.repeat(np.arange(len(w)), n)
            scores = model.weights[kinds[w]].sum(1)
            np.add.at(scores, gram_word, model.weights[grams] / n[gram_word][:, None])
            p, expected = expected_moves(scores, f, model.moves)
            miss = -p
            miss[np.arange(len(w)), label[w]] += 1
            index = np.concatenate([kinds[w].ravel(), grams])
            change = np.concatenate([np.repeat(miss, kinds.shape[1], 0), miss[gram_word] / n[gram_word][:, None]])
            used, inverse = np.unique(index, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, change[:, c], len(used)) for c in range(k)], 1) - 1e-4 * model.weights[used]
            grow[used] += gradient**2
            model.weights[used] += 0.3 * gradient / np.sqrt(grow[used])
            # transitions: the counts that are, less those expected under the model
            inner = np.ones(len(w), bool)
            inner[f[:-1]] = False
            here = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (label[w[here - 1]], label[w[here]]), 1)
            gradient = seen - expected - 1e-2 * model.moves
            grow_moves += gradient**2
            model.moves += 0.3 * gradient / np.sqrt(grow_moves)
    return model


def has_letter(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        model = shared.value
        for rows, data, offsets in slices(batches, "text"):
            ascii_letters = np.concatenate([[0], np.cumsum(ASCII_LETTERS[data])])
            letters = (ascii_letters[offsets[1:]] - ascii_letters[offsets[:-1]]) > 0
            for r in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
                letters[r] = has_letter(data[offsets[r] : offsets[r + 1]].tobytes())
            low = LOWER[data]
            starts, ends, first = words(low, offsets, LETTERS)
            k = len(model.languages)
            if k:
                p = marginals(emissions(model, low, starts, ends, Hashes(low)), first, model.moves)
                sums = np.concatenate([np.zeros((1, k)), np.cumsum(p, 0)])
                mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
                best = np.where(letters, mean.argmax(1), -1)
                score = np.where(letters, np.clip(mean.max(1), 0, 1), 0.0)
            else:
                best, score = np.full(rows.num_rows, -1), np.zeros(rows.num_rows)
            names = [*model.languages, "und"]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return plain.mapInArrow(run, RESULT)
