"""N-gram Jaccard join (3): documents whose word-shingle sets are similar, and their components.

Method, a grouped prefix join. A document's set is ordered by one order for all documents: shingles
that very many documents have come last, others by hash. Two sets of Jaccard similarity >= t share a
shingle among the first n - ceil(t n) + 1 of each. Documents with equal sets are one class; classes
with the same prefix and size are one group. Groups meet in the lists of their prefix shingles; lists
of two groups or more are expanded to members, and pairs of members are filtered by size and by a
bound on the symmetric difference (each differing shingle flips one bit of a signature, which has more
bits for larger sets). What
passes is verified on the texts' whole sets.

Lists of few members emit all their passing pairs. As only components are asked for, longer ones
don't: from the first member on, those
not yet reached are compared with each member reached, and the pairs that reach a new member are
emitted. If all of them verify, no other pair can join two components. Where one fails, or a list was
long and split in blocks, a second round emits every pair that passes between two components (long
lists: members outside a list's largest component go to all of its blocks), and with that all links
that matter are known. No cap anywhere; hashes are 64 bits, set digests 128.

Scale. Text is read twice for shingles, and texts of candidate documents only are shuffled. The
order's list of frequent shingles holds those in at least ``heavy`` / 2 of documents: at most
2 * (mean set size) / heavy of them, whatever the corpus. Hot shingles, groups of copies and long
lists are collapsed or split in blocks of ``BLOCK``.

Defined cases. Null text, or no words: size 0, linked with nothing, component_id its doc_id. Fewer than
k words: the whole sequence is the one shingle. Rows without a doc_id: component_id null, no links.
Rows that share a doc_id: judged each on its own set. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import LOWER, Stage, U, bloom, components, flat, mix, slices, thinned, whole_groups, word_shingles

BLOCK = 8192
FEW = 9
SIG_BITS = (512, 1024, 2048, 4096)


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def allowed_difference(total, percent: int):
    """The largest symmetric difference of two sets of ``total`` shingles that are similar."""
    return (100 - percent) * total // (100 + percent)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return word_shingles(LOWER[data], offsets, k)


def met_often(found: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of those met ``least`` times or more. Sorts ``found`` in place: beside it,
    there is a byte for each of its values."""
    found.sort()
    apart = max(1, int(np.ceil(least))) - 1
    values = np.unique(found[: max(0, len(found) - apart)][found[: max(0, len(found) - apart)] == found[apart:]])
    return values, np.searchsorted(found, values, "right") - np.searchsorted(found, values, "left")


def frequent(docs: DataFrame, k: int, heavy: float) -> np.ndarray:
    """Hashes of frequent shingles, rarest first. Each task counts blocks of 4M shingles and tells
    those in at least ``heavy`` of the block's documents (4 at least); a shingle of the corpus's
    rate reaches it in some block. The driver gets those that sum to heavy / 2 of all documents."""

    def run(batches):
        held, n, size = [], 0, 0

        def told():
            found = np.concatenate(held) if held else np.empty(0, U)
            held.clear()
            values, count = met_often(found, max(4, heavy * n))
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count.astype(np.int64)), pa.array(np.full(len(values), False))], names=["h", "n", "total"])

        for rows, data, offsets in slices(batches, "text"):
            _, found = shingle_sets(data, offsets, k)
            held.append(found)
            n, size = n + rows.num_rows, size + len(found)
            if size >= 1 << 22:
                yield told()
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([True])], names=["h", "n", "total"])
                held, n, size = [], 0, 0
        yield told()
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([True])], names=["h", "n", "total"])

    told = docs.select("text").mapInArrow(run, "h long, n long, total boolean").groupBy("total", "h").agg(F.sum("n").alias("n"))
    stage = Stage(docs.sparkSession, "frequent")
    told = stage.write(told, "told")
    n = told.where("total").agg(F.sum("n")).first()[0] or 0
    got = told.where(~F.col("total") & (F.col("n") >= max(8.0, heavy * n / 2))).select("h", "n").toPandas()
    stage.drop_all()
    return got.sort_values(["n", "h"])["h"].to_numpy(dtype=np.int64).view(U)


def document_sets(docs: DataFrame, k: int, percent: int, order: np.ndarray) -> DataFrame:
    """For each document the size, digest, prefix, group id and signature of its set; the prefix of
    a group is there once from each task, and empty in the group's other rows."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        order = shared.value
        by_hash = np.argsort(order)
        known, seen = order[by_hash], set()
        for rows, data, offsets in slices(batches, "text"):
            row, found = shingle_sets(data, offsets, k)
            rank = np.zeros(len(found), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                rank = np.where(known[at] == found, by_hash[at] + 1, 0)
                if rank.any():
                    turn = np.lexsort((found, rank, row))
                    row, found = row[turn], found[turn]
            n = np.bincount(row, minlength=rows.num_rows)
            first = np.concatenate([[0], np.cumsum(n)])
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.concatenate([[U(0)], np.cumsum(mix(found ^ U(salt)))])
                sums.append(total[first[1:]] - total[first[:-1]])
            length = np.where(n > 0, prefix_length(n, percent), 0)
            within = np.arange(len(found)) - np.repeat(first[:-1], n)
            prefix, bounds = found[within < np.repeat(length, n)], np.concatenate([[0], np.cumsum(length)])
            total = np.concatenate([[U(0)], np.cumsum(mix(prefix ^ U(0x2545F4914F6CDD1D)))])
            group = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U))
            for r, (g, there) in enumerate(zip(group.tolist(), pc.is_valid(rows.column("doc_id")).to_pylist())):
                if g in seen:  # a group's prefix once from each task
                    length[r] = 0
                elif there:
                    seen.add(g)
            prefix, bounds = found[within < np.repeat(length, n)], np.concatenate([[0], np.cumsum(length)])
            bits = sig_bits(n)
            at = np.concatenate([[0], np.cumsum(bits)])
            odd = np.bincount(at[row] + (found & (bits[row] - 1).astype(U)).astype(np.int64), minlength=at[-1]) & 1
            sig = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(group.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(prefix.view(np.int64))), sig],
                names=["doc_id", "n", "d1", "d2", "gid", "prefix", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, gid long, prefix array<long>, sig binary")


def sig_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the signature of a set of n: the least of SIG_BITS that is n or more, or the last."""
    return np.array(SIG_BITS)[np.minimum(np.searchsorted(SIG_BITS, n), len(SIG_BITS) - 1)]


class Signatures:
    """Signatures of a table's rows. Sets of similar size have the same number of bits or one half
    of the other's, which is then folded."""

    def __init__(self, n: np.ndarray, column: pa.ChunkedArray):
        data, _ = flat(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))
        self.n, self.bits = n, sig_bits(n)
        at = np.concatenate([[0], np.cumsum(self.bits // 8)])
        self.at = {b: np.full(len(n), -1) for b in SIG_BITS}
        self.rows = {}
        for b in SIG_BITS:
            own, wide = np.flatnonzero(self.bits == b), np.flatnonzero(self.bits == 2 * b)
            take = lambda which, b: data[at[which][:, None] + np.arange(b // 8)].reshape(len(which), b // 8).view(np.uint64)
            folded = take(wide, 2 * b)
            self.rows[b] = np.concatenate([take(own, b), folded[:, : b // 64] ^ folded[:, b // 64 :]])
            self.at[b][own], self.at[b][wide] = np.arange(len(own)), len(own) + np.arange(len(wide))

    def pass_on(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether each pair of rows (i, j) can be similar, by sizes and signatures."""
        a, b = self.n[i], self.n[j]
        out = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        which = np.flatnonzero(out)
        common = np.minimum(self.bits[i[which]], self.bits[j[which]])
        for bits in np.unique(common).tolist():
            some = which[common == bits]
            x, y = self.rows[bits][self.at[bits][i[some]]], self.rows[bits][self.at[bits][j[some]]]
            out[some] = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= allowed_difference(a[some] + b[some], percent)
        return out


def reach(sigs: Signatures, first: int, size: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows of [first, first + size) that pass and join all that passing pairs can join:
    breadth first."""
    left, out = np.arange(first, first + size), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            ok = sigs.pass_on(np.full(len(left), i), left, percent)
            out += [(i, int(j)) for j in left[ok]]
            front += left[ok].tolist()
            left = left[~ok]
    return out


def candidate_pairs(lists: DataFrame, percent: int, every: bool) -> DataFrame:
    """Distinct pairs a < b of classes. lists: token, blk, cls, n, sig, comp, together and in order
    of (token, blk, cls). every: all passing pairs of two components, each in the first list that both
    are in (tokens: all lists of a row's class, in order), else a joining part."""

    def first_here(bounds, values, i, j, token):
        """Of the rows j, those that share no earlier list with row i."""
        own = values[bounds[i] : bounds[i + 1]]
        own, n = own[own < token], bounds[j + 1] - bounds[j]
        at = np.repeat(bounds[j] - np.cumsum(n) + n, n) + np.arange(n.sum())
        met = np.bincount(np.repeat(np.arange(len(j)), n), np.isin(values[at], own), len(j))
        return j[met == 0]

    def run(batches):
        for table in whole_groups(batches, ["token", "blk"]):
            token, blk, cls, n, comp = (table[c].to_numpy() for c in ("token", "blk", "cls", "n", "comp"))
            sigs = Signatures(n, table["sig"])
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (blk[1:] != blk[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(token)))
            if every:
                lists_of = table["tokens"].combine_chunks()
                lists_of = lists_of if isinstance(lists_of, pa.Array) else lists_of.chunk(0)
                bounds, values = lists_of.offsets.to_numpy(), lists_of.values.to_numpy()
            pairs = []
            for f, s in zip(first.tolist(), size.tolist()):
                if every:
                    for i in range(f, f + s - 1):
                        j = np.arange(i + 1, f + s)
                        j = j[comp[j] != comp[i]]
                        j = j[sigs.pass_on(np.full(len(j), i), j, percent)]
                        j = first_here(bounds, values, i, j, token[i]) if len(j) else j
                        pairs.append(np.stack([np.full(len(j), cls[i]), cls[j]], 1))
                elif found := reach(sigs, f, s, percent):
                    pairs.append(cls[np.array(found)])
            if pairs and len(found := np.concatenate(pairs)):
                found = np.unique(np.sort(found, axis=1), axis=0)
                found = found[found[:, 0] != found[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return lists.select("token", "blk", "cls", "n", "comp", "sig", *(["tokens"] if every else [])).mapInArrow(run, "a long, b long").distinct()


def pairs_of_few(lists: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The passing pairs of lists (token, cls, n) of few members; signatures are joined to distinct
    pairs, not to list rows."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            n = np.concatenate([table["na"].to_numpy(), table["nb"].to_numpy()])
            sigs = Signatures(n, pa.chunked_array([*table["sig_a"].chunks, *table["sig_b"].chunks]))
            i = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(sigs.pass_on(i, i + batch.num_rows, percent)))

    x, y = lists.select("token", F.col("cls").alias("a"), F.col("n").alias("na")), lists.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"))
    near = x.join(y, "token").where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b", "na", "nb").distinct()
    with_a = near.join(sigs.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a")), ["a", "na"])
    both = with_a.join(sigs.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b")), ["b", "nb"])
    return both.select("a", "b", "na", "nb", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked): pairs of doc_ids, judged on the whole sets of their texts."""

    def run(batches):
        for batch in batches:
            a = batch.select(["a", "b", "text_a"])
            b = batch.column("text_b")
            done = 0
            for rows, data, offsets in slices([a], "text_a"):
                other = pa.RecordBatch.from_arrays([b.slice(done, rows.num_rows)], names=["text_b"])
                done += rows.num_rows
                row, found = shingle_sets(data, offsets, k)
                left = np.split(found, np.searchsorted(row, np.arange(1, rows.num_rows)))
                right = []
                for some, data_b, offsets_b in slices([other], "text_b"):
                    row, found = shingle_sets(data_b, offsets_b, k)
                    right += np.split(found, np.searchsorted(row, np.arange(1, some.num_rows)))
                ok = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    bits = bloom(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    texts = thinned(docs, "doc_id", bits)
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def jaccard_components(docs: DataFrame, text: str = "text", k: int = 4, percent: int = 85, heavy: float = 1 / 512) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each document: the size of its set, the
    smallest doc_id with the same set, and the smallest that links lead to."""
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = stage.write(document_sets(docs, k, percent, frequent(docs, k, heavy)), "sets")
    own = sets.where("n > 0 and doc_id is not null")
    classes = stage.write(own.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("cls"), F.first("gid").alias("gid"), F.first("sig").alias("sig")), "classes")
    posting = own.select("gid", F.explode("prefix").alias("token"))
    # shingles that one group has are of no use. Counts go by partial aggregates and each join on a
    # shingle has a written table on either side, so that no task gets all of a hot one
    shared = stage.write(posting.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low <> high").select("token"), "shared")
    met = stage.write(posting.join(shared, "token", "left_semi"), "met")
    within = classes.groupBy("gid").agg(F.count("*").alias("members")).where("members > 1").select(F.xxhash64("gid").alias("token"), "gid")
    met = stage.write(met.dropDuplicates(["token", "gid"]).unionByName(within), "met-once")
    lists = stage.write(met.join(classes.select("gid", "cls", "n"), "gid").select("token", "cls", "n"), "members")
    sizes = stage.write(lists.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    lists = stage.write(lists.join(sizes, "token"), "lists")
    stage.drop("shared", "met", "met-once", "members", "sizes")
    any_long = not lists.where(F.col("size") > BLOCK).isEmpty()
    sigs = classes.select("cls", "n", "sig")
    # lists of many: each member's signature goes along; long ones are split in blocks
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    many = lists.where(F.col("size") > FEW).withColumn("blk", F.pmod(F.xxhash64("token", "cls"), blocks)).withColumn("comp", F.col("cls"))
    dealt = many.join(sigs, ["cls", "n"]).repartition("token", "blk").sortWithinPartitions("token", "blk", "cls")
    pairs = candidate_pairs(dealt, percent, every=False).unionByName(pairs_of_few(lists.where(F.col("size") <= FEW), sigs, percent))
    pairs = stage.write(pairs.distinct(), "pairs")
    judged = stage.write(verify(docs, pairs, k, percent), "judged")
    stage.drop("pairs")
    links = judged.where("linked").select("a", "b")
    failed = judged.where("not linked").select("a", "b")
    found = components(stage, links, "links")
    if any_long or not failed.isEmpty():
        maybe = components(stage, judged.select("a", "b"), "maybe")
        dirty = maybe.join(maybe.join(failed, F.col("id") == F.col("a")).select("component").distinct(), "component", "left_semi").select(F.col("id").alias("cls"))
        if any_long:
            dirty = dirty.unionByName(lists.where(F.col("size") > BLOCK).select("cls"))
        dirty = stage.write(dirty.distinct(), "dirty")
        again = lists.select("token", "cls", "n").join(dirty, "cls").join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
        again = stage.write(again.select("token", "cls", "n", "comp"), "again")
        share = again.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("size"), F.count("*").alias("comps")).where("comps > 1")
        blocks = F.ceil(F.col("size") / BLOCK).cast("long")
        where = F.when(F.col("comp") == F.col("main"), F.array(F.pmod(F.xxhash64("token", "cls"), blocks))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
        split = again.join(share, "token").withColumn("blk", F.explode(where)).select("token", "blk", "cls", "n", "comp")
        own_lists = stage.write(again.groupBy("cls").agg(F.sort_array(F.collect_set("token")).alias("tokens")), "own-lists")  # a prefix's length at most
        more = candidate_pairs(split.join(sigs, ["cls", "n"]).join(own_lists, "cls").repartition("token", "blk").sortWithinPartitions("token", "blk", "cls"), percent, every=True)
        more = stage.write(more.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            links = links.unionByName(stage.write(verify(docs, more, k, percent), "judged-again").where("linked").select("a", "b"))
            found = components(stage, links, "all-links")
    found = stage.write(found, "found")
    stage.drop("lists", "again", "own-lists", "dirty", "judged", "more", "judged-again")
    of_class = classes.select("n", "d1", "d2", "cls").join(found.withColumnRenamed("id", "cls"), "cls", "left").select("n", "d1", "d2", "cls", F.coalesce("component", "cls").alias("component"))
    out = sets.select("doc_id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id")).alias("class_id"), alone.alias("component_id"))
