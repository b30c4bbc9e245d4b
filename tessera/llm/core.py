"""What the operators of this subpackage share: staged tables, and text as flat byte arrays.

Text work is done on whole Arrow batches. A batch's text column is one byte array with row
offsets; words, windows and their 64-bit hashes come from vectorised passes over it. Nothing here
looks at a prefix of a text, and memory is bounded by ``SLICE_BYTES`` plus the longest single text.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 18
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
U = np.uint64


# ---------------------------------------------------------------- staged tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one machine
    (master ``local``, as in tests) gets a temporary folder that is removed at exit, and a cluster
    an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stage:
    """Tables of one operator run, written to the shared folder: they cut lineage, and a lost
    executor costs no more than the tasks it ran.

    An operator drops the tables that its result doesn't read. Those that it does read are needed
    as long as the result is; they go when the driver's Python ends, or by ``drop_all``. Making a
    stage also holds the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes."""

    def __init__(self, spark: SparkSession, name: str):
        jvm = spark.sparkContext._jvm
        # texts reach Python in batches; by default, of up to 10,000 rows or 64 MB
        for setting, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
            held = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.execution.arrow.{setting}"))
            if held <= 0 or held > most:
                spark.conf.set(f"spark.sql.execution.arrow.{setting}", str(most))
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        self._path, self._settings = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self._at_exit)

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        path = self._path(path)
        path.getFileSystem(self._settings).delete(path, True)

    def drop(self, *names: str) -> None:
        """Removes tables no later step reads."""
        for name in names:
            self._remove(f"{self.root}/{name}")

    def drop_all(self) -> None:
        """Removes the stage's tables; the results that read them can't be read any more."""
        self._remove(self.root)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            self.drop_all()


# ---------------------------------------------------------------- bytes and slices


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, beside other tasks' workers."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of at most ``limit`` text bytes, or of one longer
    row. A null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop
        del batch, data
        give_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, one after the other, and where each row starts (and the end)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def byte_class(spans: str | bytes = b"", *ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans."""
    table = np.zeros(256, bool)
    for x in spans.encode() if isinstance(spans, str) else spans:
        table[x] = True
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: The byte classes of the word rules [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = ~byte_class(b" ", (0x09, 0x0D))
ALNUM = byte_class(b"", (0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of word bytes that don't cross rows; ``first[i]`` is the
    number of the first word of row i, and ``first[-1]`` the number of words."""
    n = len(data)
    flags = np.zeros(n + 2, np.int8)
    flags[1:-1] = in_word[data]
    step = np.diff(flags)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    inner = inner[(flags[inner] & flags[inner + 1]).astype(bool)]
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner]), kind="stable"), np.sort(np.concatenate([ends, inner]), kind="stable")
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes

#: The prime 2**61 - 1. A base was drawn at random once: two different texts of n bytes have the same
#: value for at most n of all the bases.
PRIME = U((1 << 61) - 1)
_BASE = 0x0B7E_1516_28AE_D2A7
_BASE_INVERSE = pow(_BASE, -1, int(PRIME))
_LOW30, _LOW31 = U((1 << 30) - 1), U((1 << 31) - 1)
RUN = 1 << 14  # so many at a time stay in the processor's cache
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U(61))
    return np.minimum(x, x - PRIME)  # the difference wraps where x is below the prime


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + a0 * b0)


def _power(kind: str, n: int) -> np.ndarray:
    base = _BASE if kind == "up" else _BASE_INVERSE
    while len(have := _powers[kind]) < n:
        more = times(have, np.full(1, pow(base, len(have), int(PRIME)), U))
        _powers[kind] = np.concatenate([have, more])
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Hashes of any stretches of a byte array, each in constant time: equal bytes give equal
    hashes, wherever they stand. Polynomials modulo a prime, so that no kind of text (repeats of
    repeats, say) makes different bytes meet."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U)
        up, carry = _power("up", len(data)), U(0)
        for a in range(0, len(data), RUN):  # sums of so many terms fit
            part, power = data[a : a + RUN].astype(U) + U(1), up[a : a + RUN]
            high = _reduced(np.cumsum(part * (power >> U(31))))
            low = np.cumsum(part * (power & _LOW31))
            self.sums[a + 1 : a + 1 + len(part)] = _reduced(((high & _LOW30) << U(31)) + (high >> U(30)) + (low & PRIME) + (low >> U(61)) + carry)
            carry = self.sums[a + len(part)]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down, out = _power("down", len(self.sums)), np.empty(len(starts), U)
        for a in range(0, len(starts), RUN):
            s, e = starts[a : a + RUN], ends[a : a + RUN]
            here = _reduced(self.sums[e] + (PRIME - self.sums[s]))
            out[a : a + RUN] = mix(times(here, down[s]) + (e - s).astype(U))
        return out


_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A quick hash of the ``width`` bytes from each position on. It chooses places by content (equal
    bytes, equal hash); whether bytes are equal is for ``Hashes`` to say."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, U)
    out, done = _BYTES[data], 1  # hashes of the ``done`` bytes from each position on
    single = out
    for bit in bin(width)[3:]:
        factor = U(pow(0x9FB21C651E98DF25, done, 1 << 64))
        out, done = out[: len(out) - done] * factor + out[done:], 2 * done
        if bit == "1":
            out, done = out[: len(data) - done] * U(0x9FB21C651E98DF25) + single[done:], done + 1
    return mix(out)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every window of k words within a row. ``first``: as of words()."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * U(0x9FB21C651E98DF25) + hashes[i : n + i]
    inside = np.ones(n, bool)
    for back in range(1, k):  # a window must not start in the last k-1 words of a row
        cut = first[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    # rows of fewer than k words: their starts are covered only if clipped to the row
    starts = np.flatnonzero(inside)
    row = np.searchsorted(first, starts, "right") - 1
    starts = starts[starts + k <= first[row + 1]]
    return mix(out[starts] + U(k)), starts


def word_shingles(data: np.ndarray, offsets: np.ndarray, k: int, in_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by both. A row with fewer
    words has its whole sequence as one shingle; one without words has none."""
    starts, ends, first = words(data, offsets, in_word)
    each = Hashes(data)(starts, ends) if len(starts) else np.empty(0, U)
    found, at = windows(each, first, k)
    row = np.searchsorted(first, at, "right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = []
        for r in short.tolist():
            x = U(0)
            with np.errstate(over="ignore"):
                for h in each[first[r] : first[r + 1]]:
                    x = x * U(0x9FB21C651E98DF25) + h
                whole.append(mix(np.array([x + U(count[r])], U))[0])
        found, row = np.concatenate([found, np.array(whole, U)]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        found, row = found[new], row[new]
    return row, found


# ---------------------------------------------------------------- groups that stream


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that hold whole groups; batches: in order of ``keys``."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        other = np.zeros(n, bool)
        for k in keys:
            column = table[k].to_numpy()
            other |= column != column[-1]
        last = n - int(np.argmax(other[::-1])) if other.any() else 0
        if last:
            yield table.slice(0, last).combine_chunks()
        held, n = table.slice(last).combine_chunks().to_batches(), n - last
        del table
        give_back()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    give_back()


# ---------------------------------------------------------------- components


def components(stage: Stage, edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b: long): the smallest id reachable.

    Alternating large and small stars (Kiveris et al. 2014), as joins and aggregates; labels stay
    on the executors, and each round is a staged table."""
    from pyspark.sql import functions as F

    now = stage.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    if now.isEmpty():
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    last = None
    for r in range(1, max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        step = stage.write(small, f"{name}-{r}")
        mark = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.countDistinct("u")).first())
        stage.drop(f"{name}-{r - 1}")
        now = step
        # a forest of stars that a round leaves as it is: every id has one, smallest, neighbour
        if mark == last and mark[0] == mark[2]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = mark
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def bloom(ids: DataFrame, column: str, bits: int = 1 << 22) -> np.ndarray:
    """A bit set of fixed size (512 KB whatever the input) that holds every id of ``column``
    (long): the driver gets bits/64 words at most. It only thins rows ahead of an exact join."""
    from pyspark.sql import functions as F

    slot = F.pmod(F.col(column), F.lit(bits))
    got = ids.select(F.floor(slot / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64L) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out


def may_hold(table: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Whether each id may be in the set; a null isn't."""
    slot = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False) % (len(table) * 64)
    return ((table[slot // 64] >> (slot % 64)) & 1 == 1) & pc.is_valid(ids).to_numpy(zero_copy_only=False)


def thinned(df: DataFrame, column: str, bits: np.ndarray, inside: bool = True, then=None, schema=None) -> DataFrame:
    """The rows of ``df`` whose id may be in the set, or (inside=False) all others, those without
    an id included. Both together are all rows. ``then``: a step for mapInArrow to ``schema``, which
    runs in the same Python worker: a stage with two such steps would hold two workers for a task.
    (For that, a join between two steps is a merge join, whose sides end a stage.)"""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def keep(batches):
        for batch in batches:
            hit = may_hold(shared.value, batch.column(column))
            yield batch.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(keep, df.schema) if then is None else df.mapInArrow(lambda batches: then(keep(batches)), schema)
