"""Suffix-array dedup (4): bytes inside strings of ``length`` bytes that start anywhere else too.

Method, a logarithmic index family over sparse suffix arrays. Of the windows of ``length`` bytes, each
names one suffix: where the smallest hash of a gram (an eighth of the length) in the window is, the
leftmost of equals. That depends on the window's bytes alone, so equal windows name suffixes at the
same place in them; of 400 bytes, about one position in 176 is named. A batch's suffix array has its
named suffixes in order of a
fingerprint of the bytes that all the windows naming it on one side hold. (Any order that puts
equal beginnings side by side serves a merge scan; a fingerprint's is cheaper than the bytes'.) A new
batch's array is merge-scanned against its own and each existing level; levels of equal size merge,
so a suffix is rewritten log2(batches) times. A suffix whose fingerprint is met again is a candidate.
With two lengths, the longer one is sought in what the shorter one would cut: a repeated string's
own windows are repeats, so none is lost.

Candidates whose windows' bytes are all the same are repeats as they are. For the rest, one of each
kind is read from its text, and its windows are compared one by one. Removed are the bytes of every
window with an equal. Fingerprints are 64 bits; bytes of two suffixes count as the same when two of
them agree.

Scale. Texts are read to name suffixes, at the end, and in between for documents with candidates that
differ or with long runs (a bit set of fixed size, then an exact join). A hot string's suffixes are
counted before they meet; joins on a fingerprint have a written table on either side, so that Spark
can split a hot one; and what differs under one fingerprint ``HOT`` times or more is spread by window.
The two semi-joins of suffixes hash one shuffle partition's distinct fingerprints at a time.

Defined cases. Null or short text: nothing removed. Rows with the same doc_id, and repeated rows, are
documents of their own (a repeated row is a copy of the other). Matches never cross documents. Cut
characters: removal is by bytes; ``kept`` drops the rest of a cut character. Only the named columns
are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import Hashes, Stage, U, bloom, flat, mix, rolling, slices, thinned, whole_groups

LENGTH = 400
#: Shorter than 50 words of prose are in any of the languages at hand (a word and its space have six
#: bytes or so), so that a passage of over 50 words holds strings of this length.
PASSAGE = 240
HOT = 4096
BITS = 1 << 24
#: So many bytes of text at a time: what is worked out for each then stays in the processor's cache.
NEAR = 1 << 16
#: Dictionaries of values that hardly repeat cost time and save nothing.
PLAIN = {"parquet.enable.dictionary#key": "false", "parquet.enable.dictionary#digest": "false"}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


class Shape:
    """The sizes that follow from a string length (16 bytes at least)."""

    def __init__(self, length: int):
        if length < 16:
            raise ValueError("length: 16 bytes at least")
        self.length, self.gram = length, length // 8
        self.span = length - self.gram + 1  # places for a gram in a window
        self.half = self.span // 2
        self.reach = self.gram + self.half


def with_ids(docs: DataFrame) -> DataFrame:
    """The rows with ``rid``, an id of doc_id and text."""
    return docs.withColumn("rid", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def named_suffixes(data: np.ndarray, offsets: np.ndarray, hashes: Hashes, shape: Shape, begin: np.ndarray | None = None, end: np.ndarray | None = None):
    """(row, lo, hi, fingerprint, digest): the windows that start in [lo, hi] name one suffix and
    hold its fingerprint's bytes; the digest is of all their bytes and of where the suffix is.
    ``begin`` and ``end``: the stretches of data whose windows are meant, in order, apart from each
    other and each in one row (by default, the rows)."""
    begin, end = (offsets[:-1], offsets[1:]) if begin is None else (begin, end)
    count = np.maximum(end - begin - shape.length + 1, 0)
    if not count.sum():
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    least = rolling(data, shape.gram)
    least &= U(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=U)
    width = 1
    while width * 2 <= shape.span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    rest = shape.span - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    starts = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    anchor = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    right = anchor - starts < shape.half
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, q, side = starts[first], starts[last], anchor[first], right[first]
    begin = np.where(side, q, q - shape.half)
    fingerprint = mix(hashes(begin, begin + shape.reach) + side.astype(U))
    digest = mix(hashes(lo, hi + shape.length) + (q - lo).astype(U) * U(0x9FB21C651E98DF25))
    row = np.searchsorted(offsets, lo, "right") - 1
    return row, lo - offsets[row], hi - offsets[row], fingerprint.view(np.int64), digest.view(np.int64)


def suffixes(docs: DataFrame, batches: int, shape: Shape) -> DataFrame:
    """Named suffixes of all texts (text, rid), dealt to batches by document; with a column ``runs``,
    of the windows inside those alone."""
    inside = "runs" in docs.columns

    def run(parts):
        for rows, data, offsets in slices(parts, "text", NEAR):
            stretches = ()
            if inside:
                runs = rows.column("runs")
                base = np.repeat(offsets[:-1], pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                stretches = [base + runs.flatten().field(k).to_numpy() for k in ("start", "stop")]
            row, lo, hi, fingerprint, digest = named_suffixes(data, offsets, Hashes(data), shape, *stretches)
            rid = rows.column("rid").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(fingerprint), pa.array(digest), pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array((mix(rid.view(U)) % U(batches)).astype(np.int32))], names=["key", "digest", "rid", "lo", "hi", "batch"])

    return docs.select("text", "rid", *["runs"] * inside).mapInArrow(run, "key long, digest long, rid long, lo int, hi int, batch int")


class IndexFamily:
    """Suffix arrays of batches seen so far, as levels of doubling size. A level has one row for each
    fingerprint, in order, and how many suffixes have it."""

    def __init__(self, stage: Stage):
        self.stage, self.levels, self.made = stage, [], 0

    def _array(self, rows: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"level-{self.made}"
        return name, self.stage.write(rows.sortWithinPartitions("key"), name, **PLAIN)

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch (key); gives the fingerprints of it that are met twice or more, in it or
        in an existing level (some again for each of these). Levels of equal size merge first; after
        the last batch, none does, since nothing will be scanned against them."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one, a), (_, other, b) = self.levels.pop(), self.levels.pop()
            merged, both = self._array(a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n")))
            self.stage.drop(one, other)
            self.levels.append((2 * size, merged, both))
        name, array = self._array(batch.groupBy("key").agg(F.count("*").alias("n")))
        met = array.where("n > 1").select("key")
        for _, _, level in self.levels:
            met = met.unionByName(array.select("key").join(level.select("key"), "key", "left_semi"))
        met = self.stage.write(met, f"met-{self.made}")
        self.levels.append((1, name, array))
        return met

    def close(self) -> None:
        self.stage.drop(*(name for _, name, _ in self.levels))


def _contexts(parts, length: int):
    """The bytes of all windows of each asked suffix; parts: texts with the list of them."""
    for rows, data, offsets in slices(parts, "text"):
        whole, out = data.tobytes(), []
        for r, (rid, asked) in enumerate(zip(rows.column("rid").to_pylist(), rows.column("asked").to_pylist())):
            base = int(offsets[r])
            out += [(x["key"], x["digest"], x["single"], rid, x["lo"], whole[base + x["lo"] : base + x["hi"] + length]) for x in asked]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "digest", "single", "rid", "lo", "bytes"])


CONTEXT = "key long, digest long, single boolean, rid long, lo int, bytes binary"


def _windows(table: pa.Table, length: int):
    """(context, place in it, hash) of each window of each context."""
    data, offsets = flat(table["bytes"].combine_chunks() if table["bytes"].num_chunks != 1 else table["bytes"].chunk(0))
    count = np.diff(offsets) - length + 1
    context = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[context] + place
    return context, place, Hashes(data)(start, start + length)


def _compare(parts, length: int):
    """Spans of windows that another context of the same key has too; parts: in order of the key."""
    for table in whole_groups(parts, ["key"], rows=4000):
        key, digest = table["key"].to_numpy(), table["digest"].to_numpy()
        order = np.lexsort((digest, key))
        again = np.zeros(len(key), bool)  # one of each kind, should a row be there twice
        again[order[1:]] = (key[order][1:] == key[order][:-1]) & (digest[order][1:] == digest[order][:-1])
        table = table.filter(pa.array(~again)).combine_chunks()
        key = table["key"].to_numpy()
        context, place, value = _windows(table, length)
        order = np.lexsort((value, key[context]))
        same = (value[order][1:] == value[order][:-1]) & (key[context[order]][1:] == key[context[order]][:-1])
        hit = np.zeros(len(value), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        hit &= table["single"].to_numpy(zero_copy_only=False)[context]
        out = _runs(context[hit], place[hit], table["rid"].to_numpy(), table["lo"].to_numpy(), length)
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["rid", "start", "stop"])


def _runs(context, place, rid, lo, length):
    """Byte spans (rid, start, stop) of windows in order of (context, place)."""
    new = np.ones(len(place), bool)
    new[1:] = (context[1:] != context[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    which = context[first]
    return rid[which], lo[which].astype(np.int64) + place[first], lo[which].astype(np.int64) + place[last] + length


def _spread(parts, length: int):
    """One row for each window of each context of a hot key."""
    for batch in parts:
        for start in range(0, batch.num_rows, 500):
            table = pa.Table.from_batches([batch.slice(start, 500)])
            context, place, value = _windows(table, length)
            lo = table["lo"].to_numpy().astype(np.int64)[context]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(table["rid"].to_numpy()[context]), pa.array(lo + place), table["single"].combine_chunks().take(pa.array(context)) if table["single"].num_chunks != 1 else table["single"].chunk(0).take(pa.array(context))], names=["window", "rid", "start", "single"])


def repeated_spans(docs: DataFrame, stage: Stage, batches: int, length: int) -> DataFrame:
    """(rid, start, stop): byte spans whose union is what is to be removed of docs (text, rid; with
    ``runs``, of the windows inside those)."""
    named = stage.write(suffixes(docs, batches, Shape(length)), "suffixes", **PLAIN)
    family = IndexFamily(stage)
    met = None
    for b in range(batches):
        found = family.add(named.where(F.col("batch") == b).select("key"))
        met = found if met is None else met.unionByName(found)
    family.close()
    met = stage.write(met.distinct(), "met")
    candidates = stage.write(named.drop("batch").join(met.hint("shuffle_hash"), "key", "left_semi"), "candidates")
    stage.drop("suffixes", "met", *(f"met-{i}" for i in range(1, 2 * batches)))
    kinds = candidates.groupBy("key", "digest").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("rid", "lo", "hi")))  # all three of one row
    kinds = stage.write(kinds, "kinds")
    same = kinds.where("n > 1").select("key", "digest")
    whole = candidates.join(same.hint("shuffle_hash"), ["key", "digest"], "left_semi").select("rid", F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("stop"))
    differ = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1).cast("int")).alias("open")).where("kinds > 1 and open = 1")
    differ = stage.write(differ.select("key", "kinds"), "differ")
    asked = stage.write(kinds.join(differ, "key").select("key", "digest", (F.col("n") == 1).alias("single"), "rid", "lo", "hi", (F.col("kinds") > HOT).alias("hot")), "asked")
    texts = thinned(docs.select("text", "rid"), "rid", bloom(asked, "rid", BITS))
    for_text = asked.groupBy("rid").agg(F.collect_list(F.struct("key", "digest", "single", "lo", "hi")).alias("asked"))
    contexts = texts.join(for_text.hint("merge"), "rid").mapInArrow(lambda parts: _contexts(parts, length), CONTEXT)
    out = whole
    hot = asked.where("hot").select("key").distinct()
    if hot.isEmpty():
        usual = contexts
    else:
        hot = stage.write(hot.withColumn("hot", F.lit(True)), "hot")
        contexts = stage.write(contexts.join(hot, "key", "left"), "contexts")
        usual = contexts.where("hot is null").drop("hot")
        windows = contexts.where("hot").drop("hot").dropDuplicates(["key", "digest"]).mapInArrow(lambda parts: _spread(parts, length), "window long, rid long, start long, single boolean")
        spread = stage.write(windows, "spread")
        twice = stage.write(spread.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "twice")
        out = out.unionByName(spread.where("single").join(twice, "window", "left_semi").select("rid", "start", (F.col("start") + length).alias("stop")))
    compared = usual.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(lambda parts: _compare(parts, length), "rid long, start long, stop long")
    return out.unionByName(compared)


def cut(body: np.ndarray, runs: list[dict] | None) -> np.ndarray:
    """The bytes outside all runs."""
    if not runs:
        return body
    kept = np.ones(len(body), bool)
    for x in runs:
        kept[x["start"] : x["stop"]] = False
    return body[kept]


def runs_by_row(spans: DataFrame) -> DataFrame:
    """(rid, runs): the maximal runs, in order, that spans (rid, start, stop) cover."""

    def run(parts):
        for rows in parts:
            if not rows.num_rows:
                continue
            found = rows.column("spans")
            row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            begin, end = (found.flatten().field(k).to_numpy() + (row << 32) for k in ("start", "stop"))  # texts are under 2 GB
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
            begin, end = begin[first], end[np.append(first[1:], len(end)) - 1]
            row = begin >> 32
            at = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(x - (row << 32)) for x in (begin, end)], names=["start", "stop"])
            yield pa.RecordBatch.from_arrays([rows.column("rid"), pa.ListArray.from_arrays(pa.array(at), runs)], names=["rid", "runs"])

    by_row = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return by_row.mapInArrow(run, "rid long, runs array<struct<start: long, stop: long>>")


def with_runs(docs: DataFrame, batches: int, lengths: set[int]) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(docs with ``rid``; those that may hold repeats, with what each length would cut as
    ``runs_<length>``: start, stop; the bit set of their ids) of docs (doc_id long, text string and
    any other columns but those). All windows of a repeated string are repeats, too: of a longer
    length, only the runs of the next shorter one are looked at that are long enough."""
    stage, docs = Stage(docs.sparkSession, "suffix"), with_ids(docs)
    texts, found = docs.select("text", "rid"), {}
    meant = texts
    for length in sorted(lengths):
        if found:
            runs = runs.select("rid", F.filter("runs", lambda x: x["stop"] - x["start"] >= length).alias("runs")).where(F.size("runs") > 0)
            meant = stage.write(thinned(texts, "rid", bloom(runs, "rid", BITS)).join(runs.hint("merge"), "rid"), "meant")
        runs = found[length] = stage.write(runs_by_row(repeated_spans(meant, stage, batches, length)), f"runs-{length}")
        stage.drop("candidates", "kinds", "differ", "asked", "hot", "contexts", "spread", "twice", "meant")
    bits = bloom(found[min(lengths)], "rid", BITS)
    hit = thinned(docs, "rid", bits)
    for length, runs in found.items():
        hit = hit.join(runs.withColumnRenamed("runs", f"runs_{length}").hint("merge"), "rid", "left")
    return docs, hit, bits


def repeats(docs: DataFrame, text: str = "text", batches: int = 4, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """One row of ``RESULT`` for each document: what is cut of strings of ``length`` bytes. ``kept``
    is the text that stays, null where nothing is cut. With ``passage``, a second and shorter
    length, also ``passage_removed`` and ``passage_spans``: the bytes and runs that it would cut."""
    result = RESULT + (", passage_removed long, passage_spans long" if passage else "")
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * (2 if passage else 0)

    def digest(parts):
        for rows, data, offsets in slices(parts, "text"):
            own, other = (rows.column(f"runs_{n}").to_pylist() if f"runs_{n}" in rows.schema.names else [None] * rows.num_rows for n in (length, passage))
            out = []
            for r, doc in enumerate(rows.column("doc_id").to_pylist()):
                body = data[offsets[r] : offsets[r + 1]]
                runs, kept = len(own[r] or ()), cut(body, own[r]).tobytes()
                out.append((doc, len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if runs else None))
                if passage:
                    out[-1] += (sum(x["stop"] - x["start"] for x in other[r] or ()), len(other[r] or ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in result.split(", ")])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs, hit, bits = with_runs(docs, batches, {length, passage or length})
    return hit.mapInArrow(digest, result).unionByName(thinned(docs, "rid", bits, inside=False, then=digest, schema=result))


def without_repeats(docs: DataFrame, batches: int = 4, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id long, text string, other columns) with the repeats cut from the texts."""
    schema = docs.schema

    def strip(parts):
        for rows, data, offsets in slices(parts, "text"):
            texts = []
            for r, own in enumerate(rows.column(f"runs_{length}").to_pylist()):
                texts.append(cut(data[offsets[r] : offsets[r + 1]], own).tobytes().decode("utf-8", "ignore"))
            fresh = pc.if_else(pc.is_valid(rows.column("text")), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([fresh if f.name == "text" else rows.column(f.name) for f in schema], names=schema.names)

    docs, hit, bits = with_runs(docs, batches, {length})
    return hit.mapInArrow(strip, schema).unionByName(thinned(docs, "rid", bits, inside=False).drop("rid"))
