"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The product A.A' counts the n-grams that two documents share. Its columns (n-grams) are cut
into blocks by their hash. Two documents of sizes x and y reach similarity g only if at most
(1 - g) / (1 + g) * (x + y) n-grams belong to one of them alone; with more blocks than that,
one block's columns must be the same in both. So only rows (documents) that agree on a whole
block meet, and all other cells of the product lie below the bound that follows from the
sizes and are discarded without being computed. For pairs that meet, the overlap is
accumulated over all blocks (the exact intersection) and held against the threshold. In a
row block of near copies the product is taken cell block by cell block (see ``linking``).

There are some blocks more than that, so that linked documents agree on several; documents
that share fewer blocks with others than a partner needs (a common passage makes them share
a few) are discarded, and empty blocks are left out where the count of blocks allows it.

The number of blocks depends on the size: sizes are cut into intervals, and a document is
also blocked as a member of the next interval if a partner there can be near enough.
Documents with the same set are one row of the product (their first document).

Rules: a null text or one without words has an empty set, links with nothing and is its own
component. A text of fewer than ``n`` words has its whole word sequence as its only n-gram.
Rows with a null id have counts but no component; rows that share an id are one node. Other
columns of the input are ignored. An empty table gives an empty result. N-grams are compared
as 52-bit hashes (two texts of 1,000 n-grams get a false common one in about one of 10**9
pairs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linking
from .packing import packed, unpacked
from .textarrays import SPACED, U64, Chunk, chunks, lists, mix, runs, word_hashes, words

_LOW52 = U64((1 << 52) - 1)
#: Spare blocks at least: linked documents agree on more blocks than these.
SPARE = 2


def set_bits(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): each row's distinct word n-grams, by row and hash (52 bits)."""
    w = words(chunk, SPACED)
    h = word_hashes(chunk, w)
    counts = w.counts(len(chunk))
    acc = np.zeros(max(len(h) - n + 1, 0), U64)
    for i in range(n if len(acc) else 0):
        acc = mix(acc * U64(0x9FB21C651E98DF25) + h[i:len(h) - n + 1 + i])
    whole = w.row[:len(acc)] == w.row[n - 1:] if len(acc) else np.zeros(0, bool)
    row, acc = w.row[:len(acc)][whole], acc[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        at = np.searchsorted(w.row, short)
        left = h[at]
        for i in range(1, n - 1):
            more = counts[short] > i
            left[more] = mix(left[more] * U64(0x9FB21C651E98DF25) + h[at[more] + i])
        row, acc = np.concatenate([row, short]), np.concatenate([acc, mix(left + counts[short].astype(U64))])
    both = np.sort((row.astype(U64) << U64(52)) | (acc >> U64(12)))
    both = both[runs(both)]
    return (both >> U64(52)).astype(np.int64), both & _LOW52


class Sizes:
    """Set sizes cut into intervals, and the number of blocks of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first, self.last = [1], [1]
        self.blocks, self.spare = ([x] for x in self._blocks(1))

    def _blocks(self, most: int) -> tuple[int, int]:
        """(blocks, spare): one block more than the n-grams that only one of two linked sets
        can have, and ``spare`` further ones, so that linked sets agree on more than
        ``spare`` blocks. 0 blocks: sets of this size link only if they are the same."""
        apart = 2 * most * (self.den - self.num) // (self.den + self.num)
        spare = max(SPARE, apart // 4)
        return (apart + 1 + spare, spare) if apart else (0, 0)

    def upto(self, n: int) -> None:
        while self.last[-1] < n:
            first = self.last[-1] + 1
            last = max(first, first * self.den // self.num)
            self.first.append(first)
            self.last.append(last)
            blocks, spare = self._blocks(last)
            self.blocks.append(blocks)
            self.spare.append(spare)

    def roles(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which rows, interval, blocks, spare) for the own interval and for the next one."""
        if not len(n):
            return []
        self.upto(int(n.max()) * self.den // self.num + 1)
        last, blocks, spare = np.array(self.last), np.array(self.blocks), np.array(self.spare)
        own = np.searchsorted(last, n)
        reach = np.flatnonzero((n * self.den // self.num > last[own]) & (n > 0))
        out = []
        for at, interval in ((np.flatnonzero(n > 0), own), (reach, own + 1)):
            at = at[blocks[interval[at]] > 0]
            out.append((at, interval[at], blocks[interval[at]], spare[interval[at]]))
        return out


def _signatures(row: np.ndarray, bits: np.ndarray, n: np.ndarray, sizes: Sizes) -> list[tuple]:
    """For both roles (rows, signatures, need, parity): hashes of each row's blocks, how many
    of them a partner must share, and the parity of the row's interval in this role, which is
    also the signatures' last bit.

    Linked sets agree on more than ``spare`` blocks. Empty blocks say nothing: a set with at
    most ``spare`` of them leaves them out, as it must still share more than ``spare`` less
    its empty blocks; a set with more emits them too and must share one."""
    out = []
    for at, interval, blocks, spare in sizes.roles(n):
        per_row, kind, spares = (np.zeros(len(n), np.int64) for _ in range(3))
        per_row[at], kind[at], spares[at] = blocks, interval + 1, spare
        use = per_row[row] > 0
        r, b = row[use], bits[use]
        block = ((b >> U64(20)) * per_row[r].astype(U64)) >> U64(32)  # rises with the hash
        salt = mix(kind[r].astype(U64) * U64(0x1000003) + block)
        begin = runs(r, block)
        need = np.zeros(len(n), np.int64)
        if not len(begin):
            out.append((np.zeros(0, np.int64), np.zeros(0, U64), need, kind & 1))
            continue
        sums = mix(np.add.reduceat(mix(b ^ salt), begin) ^ salt[begin])
        owner = r[begin]
        empty_blocks = per_row - np.bincount(owner, minlength=len(n))
        few = empty_blocks <= spares
        need[at] = np.where(few, 1 + spares - empty_blocks, 1)[at]
        rows, sigs = [owner], [sums]
        for x in at[~few[at]]:
            full = block[begin][owner == x].astype(np.int64)
            empty = np.setdiff1d(np.arange(per_row[x]), full)
            rows.append(np.full(len(empty), x))
            sigs.append(mix(mix(U64(kind[x]) * U64(0x1000003) + empty.astype(U64)) ^ U64(0x5BD1E995)))
        rows, sigs = np.concatenate(rows), np.concatenate(sigs)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        out.append((rows, (sigs[order] & ~U64(1)) | (kind[rows] & 1).astype(U64), need, kind & 1))
    none = np.zeros(len(n), np.int64)
    return out or [(np.zeros(0, np.int64), np.zeros(0, U64), none, none)] * 2


def _incidence(n: int, num: int, den: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(num, den)
        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                row, bits = set_bits(c, n)
                size = np.bincount(row, minlength=len(c)).astype(np.int64)
                begin = runs(row)
                keys = []
                for salt in (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)):
                    key = np.zeros(len(c), U64)
                    if len(begin):
                        key[row[begin]] = np.add.reduceat(mix(bits ^ salt), begin)
                    keys.append(mix(key).view(np.int64))
                (own, own_sigs, *own_need), (up, up_sigs, *up_need) = _signatures(row, bits, size, sizes)
                needs = np.zeros((2, len(c)), np.int64)
                for need, parity in (own_need, up_need):
                    at = np.flatnonzero(need)
                    needs[parity[at], at] = need[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.start, len(c)).cast(pa.int64()), pa.array(size), pa.array(keys[0]),
                     pa.array(keys[1]), pa.array(needs[0]), pa.array(needs[1]),
                     lists(own_sigs.view(np.int64), np.bincount(own, minlength=len(c)), pa.int64()),
                     lists(up_sigs.view(np.int64), np.bincount(up, minlength=len(c)), pa.int64())],
                    names=["id", "size", "k1", "k2", "need0", "need1", "sigs0", "sigs1"])
    return task


def _sets(n: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids = batch.column(0).slice(at, 200)
                for c in chunks(unpacked(batch.column(1).slice(at, 200)), lower=True):
                    row, bits = set_bits(c, n)
                    counts = np.bincount(row, minlength=len(c))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(c.start, len(c)).cast(pa.int64()),
                         lists(bits.view(np.int64), counts, pa.int64()), pa.array(counts, pa.int32())],
                        names=["id", "value", "size"])
    return task


def set_values(column: pa.Array) -> list[np.ndarray]:
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _enough(shared: DataFrame, needs: DataFrame) -> DataFrame:
    """The (key, id) rows, of distinct ones whose keys several ids have, of the ids that share as
    many keys of an interval (an id's two intervals differ in the key's last bit) as a partner
    needs: one shuffle by id, in which the rows are counted and filtered."""
    odd = F.col("key").bitwiseAND(1)
    own = Window.partitionBy("id")
    return shared.withColumn("odd", odd).withColumn("n0", F.sum(1 - F.col("odd")).over(own)) \
        .withColumn("n1", F.sum("odd").over(own)).join(needs.hint("merge"), "id") \
        .where(F.when(F.col("odd") == 0, F.col("n0") >= F.col("need0")).otherwise(F.col("n1") >= F.col("need1"))) \
        .select("key", "id")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3,
                     num: int = 90, den: int = 100) -> DataFrame:
    """id_col, n_shingles, component_id for each row: documents link when their sets of word
    n-grams have a Jaccard similarity of num / den or more; component_id is the smallest id
    reachable by links."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    incidence = linking.landed(texts.mapInArrow(
        _incidence(n, num, den), "id long, size long, k1 long, k2 long, need0 long, need1 long, "
                                 "sigs0 array<long>, sigs1 array<long>"), "incidence")
    classes = linking.landed(
        incidence.where("size > 0 and id is not null").groupBy("k1", "k2", "size").agg(F.min("id").alias("rep")),
        "classes")
    blocks = incidence.select("id", F.explode(F.concat("sigs0", "sigs1")).alias("sig"))
    members = linking.landed(linking.shared_keys(blocks, "sig", "id"), "members")
    needs = incidence.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi") \
        .groupBy("id").agg(F.min("need0").alias("need0"), F.min("need1").alias("need1"))
    needs = linking.landed(needs, "needs")
    for turn in range(3):  # who shares too few blocks links with nobody; without them, others do
        # the first time the rows are those of shared keys already
        shared = linking.repeated_keys(members, "key") if turn else members
        stored, members = members, linking.landed(_enough(shared, needs), "members")
        linking.release(stored)
    linking.release(needs)
    grouped = linking.landed(linking.shared_groups(members, "key", "id"), "groups")
    wanted = grouped.select("id").distinct()
    # the texts are shuffled packed, whatever the size of ``wanted``: no task packs and unpacks
    sets = linking.landed(packed(texts.where("id is not null and text is not null"))
                          .join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
                          .mapInArrow(_sets(n), "id long, value array<long>, size int"), "sets")
    comp = linking.linked_components(spark, grouped, sets, set_values, num, den)
    of_class = classes.join(comp, classes["rep"] == comp["id"], "left") \
        .select("k1", "k2", "size", F.coalesce("comp", "rep").alias("comp"))
    return incidence.select("id", "size", "k1", "k2").join(of_class, ["k1", "k2", "size"], "left") \
        .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
