"""Token counts (6): exact counts, huge texts by overlapping chunks that are spliced.

Method, overlap resynchronisation. A text over ``huge`` bytes is cut into chunks of ``chunk`` bytes,
each encoded with ``overlap`` bytes of the next. Token offsets of both chunks at a joint are compared;
the splice is at a token boundary that both have and that is proven stable (byte_bpe.stable). If the
overlap has none, it is widened until it has one and the left chunk is encoded again; when the overlap
reaches the next joint, chunks become one, of twice the length at least, so that the time is in
proportion to the text's length. Counts equal those of the whole text, and the working memory is one
text's.

Defined cases. Null or empty text: 0 bytes, 0 tokens. Repeated rows: a result each. Text without any
stable place is encoded whole. Only the named columns are read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, load, stable
from .core import slices

RESULT = "doc_id long, n_bytes long, n_tokens long"


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_spliced(bpe: ByteBPE, data: bytes, chunk: int, overlap: int) -> int:
    """Tokens of a whole text, from overlapping chunks."""
    cuts = sorted({_char_start(data, i) for i in range(0, len(data), chunk)} | {0})

    def ends(begin: int, stop: int) -> np.ndarray:
        return begin + np.cumsum(bpe.lengths[bpe.encode(data[begin:stop].decode())])

    def reach(k: int, wide: int) -> int:
        return _char_start(data, min((cuts[k + 1] if k + 1 < len(cuts) else len(data)) + wide, len(data)))

    special = tuple(bpe.special)
    total = start = i = 0  # chunk i's tokens count from the splice at ``start``
    left = ends(0, reach(0, overlap))
    while i + 1 < len(cuts):
        joint, wide = cuts[i + 1], overlap
        places = np.empty(0, np.int64)
        while not len(places):  # an overlap that holds a stable place, up to the next joint
            stop = min(reach(i, wide), reach(i + 1, 0))
            places = joint + stable(np.frombuffer(data, np.uint8, stop - joint, joint), special)
            if stop >= reach(i + 1, 0):
                break
            wide *= 2
        both = np.empty(0, np.int64)
        if len(places):
            if stop > reach(i, overlap):
                left = ends(cuts[i], stop)
            right = ends(joint, reach(i + 1, overlap))
            both = np.intersect1d(left, right, assume_unique=True)
            both = np.intersect1d(both[both > start], places, assume_unique=True)
        if len(both):
            total += int(np.count_nonzero((left > start) & (left <= both[0])))
            start, left, i = int(both[0]), right, i + 1
        else:  # no place up to the next joint: chunks become one, twice as long each time
            last = max(i + 2, bisect.bisect_left(cuts, 2 * joint - cuts[i]))
            del cuts[i + 1 : last]
            left = ends(cuts[i], reach(i, overlap))
    return total + int(np.count_nonzero(left > start))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", huge: int = 1 << 15, chunk: int = 1 << 14, overlap: int = 256) -> DataFrame:
    """One row of ``RESULT`` for each document. One pass, no shuffle."""

    def run(batches):
        bpe = load(tokenizer)
        for rows, data, offsets in slices(batches, "text"):
            whole, counts = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                counts.append(count_spliced(bpe, whole[a:b], chunk, overlap) if b - a > huge else len(bpe.encode(whole[a:b].decode())))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)
