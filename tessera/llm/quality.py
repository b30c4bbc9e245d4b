"""Quality rules (5): rule failures of documents, rates of their hosts, and verdicts from both.

Method. One pass over the texts counts what the rules need. Failures are summed by host, an
empirical beta prior (method of moments over all hosts) shrinks each host's failure rate, and the
host's verdict is joined back: a document of a host whose shrunk rate passes ``host_rate`` is kept
only if it breaks none of the rules, base and soft. Documents of other hosts need the base rules
only.

Defined cases. Null text: no words (so it fails ``min_words``). Null host: a host of its own.
Repeated rows are judged each on its own. An empty table gives an empty result. Only the named
columns are read, so extra ones can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import Hashes, NOT_SPACE, Stage, byte_class, slices, windows, words

#: The symbols that count.
SYMBOLS = byte_class("#*$%&|<>")
COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, later): whether each item's (row, key) is there twice or more, and whether an
    earlier item has it."""
    order = np.lexsort((np.arange(len(key)), key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    repeated, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    repeated[order[1:]] = same
    repeated[order[:-1]] |= same
    later[order[1:]] = same
    return repeated, later


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a flat text column."""
    starts, ends, first = words(data, offsets)
    hashes = Hashes(data)
    n_words = np.diff(first)
    chars = NOT_SPACE[data] & ((data & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": _per_row(chars, offsets), "n_symbols": _per_row(SYMBOLS[data], offsets)}
    # lines: stretches between \n and the ends of rows, those with a word
    cuts = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))[: len(begin)]
    stop = stop - (data[stop - 1] == 10) if len(stop) else stop
    row = np.searchsorted(offsets, begin, "right") - 1
    with_word = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    begin, stop, row = begin[with_word], stop[with_word], row[with_word]
    _, later = _repeats(row, hashes(begin, stop))
    out["n_dup_lines"] = np.bincount(row[later], minlength=len(n_words))
    # words inside a five-word window that the row has twice or more
    found, at = windows(hashes(starts, ends), first, 5)
    row = np.searchsorted(first, at, "right") - 1
    repeated, _ = _repeats(row, found)
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, at[repeated], 1)
    np.add.at(covered, at[repeated] + 5, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(covered)[: len(starts)] > 0, first)
    return out


def counts(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """One row of counts for each document; texts go no further than this pass."""

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            found = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("host"), *(pa.array(found[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text")).mapInArrow(run, COUNTS)


def quality(docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 10, repeat_percent: int = 20, symbol_percent: int = 10, dup_lines_percent: int = 30, host_rate: float = 0.5) -> DataFrame:
    """Counts, failures, the host's shrunk failure rate and ``kept`` for every document."""
    stage = Stage(docs.sparkSession, "quality")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > dup_lines_percent * F.col("n_words"))
    # a host's failures are summed in each task before they meet
    judged = stage.write(counts(docs, text, host).withColumn("base_failed", base).withColumn("soft_failed", soft), "counts")
    rates = host_rates(judged)
    back = judged.join(rates.select("host", "host_rate"), judged["host"].eqNullSafe(rates["host"]), "left").drop(rates["host"])
    bad = F.coalesce(F.col("host_rate") > host_rate, F.lit(False))
    return back.withColumn("kept", ~F.col("base_failed") & ~(bad & F.col("soft_failed")))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, failed, host_rate): failure rates shrunk towards the mean of all hosts.

    The beta prior's mean m and strength s come from the hosts' rates by the method of moments:
    s = m (1 - m) / v - 1, with v the variance of the rates less what binomial noise explains, at
    least 1e-6; s is held to [1, 1e6]. Two hosts are needed for a variance; one alone gets s = 1."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"))
    p = F.col("failed") / F.col("n")
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_samp(p).alias("v"), F.avg(1 / F.col("n")).alias("inverse_n"))
    m, noise = F.col("m"), F.col("m") * (1 - F.col("m")) * F.col("inverse_n")
    strength = F.coalesce(F.least(F.greatest(m * (1 - m) / F.greatest(F.col("v") - noise, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1e6)), F.lit(1.0))
    # one row: the two moments of all hosts
    return hosts.crossJoin(F.broadcast(prior.select("m", strength.alias("s")))).withColumn("host_rate", (F.col("failed") + m * F.col("s")) / (F.col("n") + F.col("s")))
