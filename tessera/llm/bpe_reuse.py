"""BPE encoding and decoding (8): chunks that documents share are encoded once.

Method, content-defined chunk reuse. A rolling hash over ``WINDOW`` bytes cuts texts where it hits a
pattern, so equal passages give equal chunks in any document. Chunk digests (no texts) are counted
over the corpus; each digest found twice or more is encoded once, in the document that owns it, and
its ids are joined to the documents that refer to it. A document's own chunks are encoded where it
is. At a joint the ids of both chunks are kept up to the nearest places that split tokens in any
context (byte_bpe.stable); the text between is encoded again, further out if a chunk has no such
place, so that the ids on both sides agree with those of the whole text.

Scale. Only documents that may hold shared chunks (a bit set of fixed size, then an exact join) are
shuffled. A hot chunk's references are a skewed join side, which Spark splits; its ids are one row.

Defined cases. Null or empty text: no ids. Repeated rows: a result each. Texts without any stable
place are encoded whole. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, load, stable
from .core import Hashes, Stage, U, bloom, rolling, slices, thinned

WINDOW = 32
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cuts(data: np.ndarray, offsets: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first): chunk starts of all rows, and the number of each row's first chunk. A cut
    follows a window whose hash is a multiple of ``mean`` (a power of two), never inside a
    character, nor in a row's first or last WINDOW bytes."""
    hit = np.flatnonzero((rolling(data, WINDOW)[:-1] & U(mean - 1)) == 0) + WINDOW
    hit = hit[(data[hit] & 0xC0) != 0x80]
    row = np.searchsorted(offsets, hit, "right") - 1
    hit = hit[(hit - offsets[row] >= WINDOW) & (offsets[row + 1] - hit >= WINDOW)]
    starts = np.unique(np.concatenate([hit, offsets[:-1][np.diff(offsets) > 0]]))
    return starts, np.searchsorted(starts, offsets)


def digests(data: np.ndarray, offsets: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, digest); the digest also holds the length."""
    hashes = Hashes(data)
    starts, first = cuts(data, offsets, mean)
    ends = np.append(starts[1:], len(data))
    return starts, ends, first, hashes(starts, ends).view(np.int64)


def assemble(bpe: ByteBPE, text: bytes, parts: list[tuple[int, int]], known: dict[int, np.ndarray], keys: list[int]) -> np.ndarray:
    """Ids of a whole text from those of its chunks. ``known``: ids of some chunks, by digest."""
    out, pending, special = [], 0, tuple(bpe.special)  # the text is encoded up to ``pending``
    for k, (a, b) in enumerate(parts):
        last = k + 1 == len(parts)
        inner = stable(np.frombuffer(text, np.uint8, b - a, a), special) + a
        head = 0 if k == 0 else int(inner[0]) if len(inner) else None
        tail = len(text) if last else int(inner[-1]) if len(inner) else None
        if head is None or tail is None:
            continue  # no place in this chunk: the next joint's text begins before it
        ids = known.get(keys[k])
        if ids is None or bpe.decode(ids.tolist()) != text[a:b]:  # a digest may be another chunk's too
            ids = np.array(bpe.encode(text[a:b].decode()), np.uint32)
        bounds = np.concatenate([[a], a + np.cumsum(bpe.lengths[ids])])
        if pending < head:
            out.append(np.array(bpe.encode(text[pending:head].decode()), np.uint32))
        out.append(ids[np.searchsorted(bounds, head) : np.searchsorted(bounds, tail)])
        pending = tail
    if pending < len(text):
        out.append(np.array(bpe.encode(text[pending:].decode()), np.uint32))
    return np.concatenate(out).astype(np.uint32) if out else np.empty(0, np.uint32)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", mean: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row of ``RESULT`` for each document, with the ids (array<int>) if asked for."""
    if mean & (mean - 1):
        raise ValueError("mean must be a power of two")
    stage = Stage(docs.sparkSession, "bpe")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def cut(batches):
        for rows, data, offsets in slices(batches, "text"):
            starts, ends, first, digest = digests(data, offsets, mean)
            doc = rows.column("doc_id").take(pa.array(np.repeat(np.arange(rows.num_rows), np.diff(first))))
            yield pa.RecordBatch.from_arrays([pa.array(digest), doc], names=["digest", "doc_id"])

    def encode_owned(batches):
        """The chunks that a document owns, of texts with the list of them."""
        bpe = load(tokenizer)
        for rows, data, offsets in slices(batches, "text"):
            starts, ends, first, digest = digests(data, offsets, mean)
            owned, keys, ids = rows.column("owned").to_pylist(), [], []
            for r, mine in enumerate(owned):
                mine = set(mine or ())
                for k in range(first[r], first[r + 1]):
                    if (key := int(digest[k])) in mine:
                        mine.discard(key)
                        keys.append(key)
                        ids.append(np.array(bpe.encode(data[starts[k] : ends[k]].tobytes().decode()), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["digest", "ids"])

    def finish(batches):
        bpe = load(tokenizer)
        for rows, data, offsets in slices(batches, "text"):
            starts, ends, first, digest = digests(data, offsets, mean)
            whole, out = data.tobytes(), []
            known = rows.column("known").to_pylist() if "known" in rows.schema.names else [None] * rows.num_rows
            for r, doc in enumerate(rows.column("doc_id").to_pylist()):
                at, chunks = int(offsets[r]), slice(first[r], first[r + 1])
                body = whole[at : int(offsets[r + 1])]
                parts = list(zip((starts[chunks] - at).tolist(), (np.minimum(ends[chunks], offsets[r + 1]) - at).tolist()))
                got = {x["digest"]: np.frombuffer(x["ids"], np.uint32) for x in known[r] or ()}
                ids = assemble(bpe, body, parts, got, digest[chunks].tolist())
                decoded = bpe.decode(ids.tolist()).decode("utf-8", "replace")
                out.append((doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids if with_ids else None))
            cols = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 5 if with_ids else 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(types)])

    schema = RESULT + (", ids array<int>" if with_ids else "")
    # distinct (chunk, document) references of the chunks that occur twice or more in the corpus
    refs = stage.write(docs.mapInArrow(cut, "digest long, doc_id long").groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "refs")
    shared = stage.write(refs.groupBy("digest").agg(F.sum("n").alias("n"), F.min("doc_id").alias("owner")).where("n > 1 and owner is not null"), "shared")
    owned = shared.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("digest").alias("owned"))
    texts = thinned(docs, "doc_id", bloom(shared.select(F.col("owner").alias("doc_id")), "doc_id"))
    encoded = stage.write(texts.join(owned.hint("merge"), "doc_id").mapInArrow(encode_owned, "digest long, ids binary").dropDuplicates(["digest"]), "encoded")
    wanted = stage.write(refs.where("doc_id is not null").join(shared.select("digest"), "digest").select("digest", "doc_id"), "wanted")
    stage.drop("refs", "shared")
    bits = bloom(wanted, "doc_id")
    known = wanted.join(encoded, "digest").groupBy("doc_id").agg(F.collect_list(F.struct("digest", "ids")).alias("known"))
    with_shared = thinned(docs, "doc_id", bits).join(known.hint("merge"), "doc_id", "left").mapInArrow(finish, schema)
    return thinned(docs, "doc_id", bits, inside=False, then=finish, schema=schema).unionByName(with_shared)
