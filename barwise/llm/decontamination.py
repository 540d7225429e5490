"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark's words (lower-cased runs of letters and digits) are the features; words in
   more than ``common`` of the items are left out unless an item would keep fewer than four.
   Passages are windows of 32 words, 16 apart, of every whole text. One pass over the whole
   table writes each passage's features to the shared folder; from these the features'
   passages are counted for TF-IDF.
2. A randomised SVD of the TF-IDF matrix of passages gives the latent space: Z = A'A G for a
   Gaussian G is summed over distributed blocks of rows, its orthonormal basis Q is refined
   to the leading eigenvectors of Q'A'AQ, again a distributed sum. A's rows are the passages
   of all texts and, with the same total weight, the benchmark's.
3. A leak as step 4 defines it holds so many of the item's words that one of its passages has a
   number of hits of the item's own features that follows from the item
   (``Benchmark.least_hits``). Passages of every text are counted against all items by their
   features, those with hits enough for an item are projected, and their cosines with the
   item's passages computed; those over ``cosine`` are candidates.
4. A candidate is held against the whole item, in every window of 1.5 times the item's words
   around the passage: the longest common subsequence of words as a share of the item's
   words, and whether the item's answer (its last sentence, or its last third) is in the same
   window. It is a leak if the share is ``lcs`` or more, or ``lcs_with_answer`` or more with
   the answer found. What a window holds doesn't grow with the text.

Items of fewer than ``min_words`` words are looked up as they are: their words, one after the
other, anywhere in a text.

The item set is worked through in blocks of ``block`` items, so what a task holds does not
grow with the benchmark. Rules: null and empty texts and items (items without words too)
match nothing. Rows with a null id can't be reported by it and are ignored (``without_leaks`` keeps them). Repeated rows give one result. Other columns are
ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .textarrays import ALNUM, U64, Chunk, chunks, mix, runs, word_hashes, words

STRIDE = 16
WINDOW = 2 * STRIDE
#: Bytes of text whose hits are fitted on at a time (their vectors stay in a core's cache).
FIT_BYTES = 1 << 15
#: Bytes of text that are searched at a time.
SEARCH_BYTES = 1 << 16
RESULT = "id long, item long, start_word long, cosine double, lcs double, answer_found boolean"


class Benchmark:
    """A block of items: their words as hashes, features, search passages and answers."""

    def __init__(self, items: list[tuple[int, str]], common: float, min_words: int):
        self.items, self.hashes, self.answers = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # words: hash of them all: items
        for item, text in items:
            h = _hashes(text)
            if len(h) < min_words:
                if len(h):
                    self.short.setdefault(len(h), {}).setdefault(int(_sequences(h, len(h))[0]), []).append(item)
                continue
            self.items.append(item)
            self.hashes.append(h)
            self.answers.append(_answer(text, h))
        seen: dict[int, int] = {}
        for h in self.hashes:
            for x in set(h.tolist()):
                seen[x] = seen.get(x, 0) + 1
        keep = set()
        most = max(3, common * len(self.items))
        for h in self.hashes:
            own = sorted(set(h.tolist()), key=lambda x: (seen[x], x))
            keep.update(own[:4])
            keep.update(x for x in own if seen[x] <= most)
        self.features = np.array(sorted(keep), U64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.features >> U64(44)).astype(np.int64)] = True
        owner, at = [], []  # search passages: item index, first word
        for i, h in enumerate(self.hashes):
            starts = [0] if len(h) <= WINDOW else [*range(0, len(h) - WINDOW, STRIDE // 2), len(h) - WINDOW]
            owner += [i] * len(starts)
            at += starts
        self.owner, self.at = np.array(owner, np.int64), at
        pairs = sorted({(int(f), i) for i, h in enumerate(self.hashes) for f in self.lookup(h)[1]})
        self.items_of = np.array([i for _, i in pairs], np.int64)
        self.items_from = np.searchsorted(np.array([f for f, _ in pairs], np.int64), np.arange(len(self.features) + 1))
        self.where = [places_of(h.tolist()) for h in self.hashes]
        self.answer_where = [places_of(h.tolist()) for h in self.answers]
        self.pieces = [self.hashes[i][a:a + WINDOW] for i, a in zip(owner, at)]

    def least_hits(self, share: float) -> np.ndarray:
        """For each item the hits of its own features that a passage of any leak of it has at least.

        A window of 1.5 n words that shares ``share`` of an item's n words in order holds as
        many of them, less the item's words that are no features. The passages that begin at
        every other block from the window's first one cover it, so one of them has its part
        of these hits or more."""
        out = []
        for h in self.hashes:
            n, shared = len(h), int(np.ceil(share * len(h) - 1e-9))
            hits = shared - (n - len(self.lookup(h)[0]))
            blocks = (-(-3 * n // 2) + 2 * (STRIDE - 1)) // STRIDE
            out.append(max(1, -(-hits // -(-blocks // 2))))
        return np.array(out, np.int64)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, features): where a hash is a feature's, and which."""
        at = np.flatnonzero(self.maybe[(h >> U64(44)).astype(np.int64)])
        f = np.minimum(np.searchsorted(self.features, h[at]), len(self.features) - 1)
        ok = self.features[f] == h[at]
        return at[ok], f[ok]


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    out = h[:len(h) - n + 1]
    for k in range(1, n):
        out = mix(out) + h[k:len(h) - n + 1 + k]
    return out


def _hashes(text: str) -> np.ndarray:
    c = next(chunks(pa.array([text or ""], pa.string()), lower=True))
    return word_hashes(c, words(c, ALNUM))


def _answer(text: str, h: np.ndarray) -> np.ndarray:
    """The words of the last sentence if there are more sentences than it; else the last third."""
    for mark in range(len(text) - 2, 0, -1):
        if text[mark] in ".!?\n":
            last = _hashes(text[mark + 1:])
            if 2 <= len(last) < len(h):
                return last
    return h[-max(1, len(h) // 3):]


class Passages:
    """The features of a chunk's passages: for each hit its block of STRIDE words and feature.
    A passage is a block and the next one of the same text."""

    def __init__(self, c: Chunk, bench: Benchmark):
        w = words(c, ALNUM)
        self.row, self.hash = w.row, word_hashes(c, w)
        counts = w.counts(len(c))
        self.first_word = np.cumsum(counts) - counts
        blocks = -(-counts // STRIDE)
        self.first_block = np.cumsum(blocks) - blocks
        self.total = int(blocks.sum())
        self.row_of_block = np.repeat(np.arange(len(c)), blocks)
        at, f = bench.lookup(self.hash)
        r = w.row[at]
        self.block = self.first_block[r] + (at - self.first_word[r]) // STRIDE
        self.feature = f

    def candidates(self, bench: Benchmark, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first block, item) of the passages that have ``least[item]`` hits of an item's features."""
        first = bench.items_from[self.feature]
        counts = bench.items_from[self.feature + 1] - first
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        n = len(least)
        key, hits = np.unique(np.repeat(self.block, counts) * n + bench.items_of[at], return_counts=True)
        if not len(key):
            return key, key
        # a passage is a block and the one after it, or a single block at the end of a text
        after = np.minimum(np.searchsorted(key, key + n), len(key) - 1)
        block, item = key // n, key % n
        last = np.append(self.row_of_block[1:] != self.row_of_block[:-1], True)
        both = hits + np.where((key[after] == key + n) & ~last[block], hits[after], 0)
        ok = both >= least[item]
        return block[ok], item[ok]

    def vectors(self, blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Summed rows of the table of the passages that begin at these blocks (ascending)."""
        more = (blocks + 1 < self.total) & (self.row_of_block[np.minimum(blocks + 1, self.total - 1)] == self.row_of_block[blocks])
        first = np.searchsorted(self.block, blocks)
        end = np.searchsorted(self.block, blocks + more, "right")
        counts = end - first
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.add.reduceat(table[self.feature[at]], np.cumsum(counts) - counts, axis=0)  # every count is 1 or more


def _row_sums(table: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the table's rows ``at``, from each place of ``begin`` (ascending, the first 0) to
    the next: the groups' first rows, then their second ones and so on, so that each step
    adds whole arrays."""
    counts = np.diff(np.append(begin, len(at)))
    order = np.argsort(-counts, kind="stable")
    first, left = begin[order], np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), "left")
    sums = table[at[first]]
    for k, n in enumerate(left[1:].tolist(), 1):
        if n < 16:  # few long groups are left
            for i in range(n):
                sums[i] += table[at[first[i] + k:first[i] + counts[order[i]]]].sum(axis=0)
            break
        sums[:n] += table[at[first[:n] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _hits(bench):
    """(passages, keys) of stretches of text: how many passages, and block * features + feature
    of each hit in ascending order (differences, compressed)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, squeeze = bench.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for c in chunks(batch.column(0), FIT_BYTES, lower=True):
                p = Passages(c, b)
                keys = np.sort(p.block * len(b.features) + p.feature)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.total]), pa.array([squeeze.compress(np.diff(keys, prepend=0).tobytes())], pa.binary())],
                    names=["passages", "keys"])
    return task


def _keys(column: pa.Array) -> Iterator[np.ndarray]:
    unzip = zstandard.ZstdDecompressor()
    for x in column:
        yield np.cumsum(np.frombuffer(unzip.decompress(x.as_buffer()), np.int64))


def _document_frequency(features: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(features, np.int64)
        for batch in batches:
            total += pc.sum(batch.column(0)).as_py() or 0
            for keys in _keys(batch.column(1)):
                df += np.bincount(keys[runs(keys)] % features, minlength=features)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], names=["feature", "n"])
    return task


def _gram_sums(idf: np.ndarray, basis: np.ndarray, back: bool):
    """Sums over passages: (feature, vector) of A'A.basis if ``back``, else of (A.basis)'(A.basis)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = basis.shape[1]
        z = np.zeros((len(basis), width) if back else (width, width))
        weighted = idf[:, None] * basis
        for batch in batches:
            for keys in _keys(batch.column(1)):
                if not len(keys):
                    continue
                # rows of A: blocks of words, scaled to length one
                block, feature = keys // len(idf), keys % len(idf)
                begin = runs(block)
                norm = np.sqrt(np.add.reduceat(idf[feature] ** 2, begin))
                y = _row_sums(weighted, feature, begin)
                y /= norm[:, None]
                if back:
                    y /= norm[:, None]
                    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(block))))
                    order = np.argsort(feature, kind="stable")
                    own = feature[order]
                    z[own[runs(own)]] += _row_sums(y, of[order], runs(own))
                else:
                    z += y.T @ y
        if back:
            z *= idf[:, None]
        at = np.flatnonzero(np.abs(z).sum(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(list(z[at]), pa.list_(pa.float64()))], names=["row", "vector"])
    return task


def _summed(frame: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Adds the rows' vectors by row: a table of fixed size."""
    z = np.zeros(shape)
    parts = frame.select("row", F.posexplode("vector")).groupBy("row", "pos").agg(F.sum("col").alias("v")).toArrow()
    z[np.asarray(parts["row"]), np.asarray(parts["pos"])] = np.asarray(parts["v"])
    return z


def latent_space(hits: DataFrame, bench, idf: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """(features, rank) orthonormal columns: the leading right singular vectors of all the
    texts' passages (``_hits``) and the benchmark's, by randomised SVD."""
    b = bench.value
    own = np.zeros((len(b.pieces), len(idf)))
    for i, piece in enumerate(b.pieces):
        at, f = b.lookup(piece)
        np.add.at(own[i], f, idf[f])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    width = min(rank + 16, len(idf))
    g = np.random.default_rng(seed).normal(size=(len(idf), width))

    def both(basis: np.ndarray, back: bool) -> np.ndarray:
        """The corpus's sum and the benchmark's, each scaled to the same trace."""
        shape = basis.shape if back else (width, width)
        corpus = _summed(hits.mapInArrow(_gram_sums(idf, basis, back), "row long, vector array<double>"), shape)
        y = own @ basis
        mine = own.T @ y if back else y.T @ y
        size = [max(np.linalg.norm(x), 1e-12) for x in (corpus, mine)]
        return corpus / size[0] + mine / size[1]

    q, _ = np.linalg.qr(both(g, True))
    _, vectors = np.linalg.eigh(both(q, False))
    return q @ vectors[:, ::-1][:, :rank]


def places_of(words_: list[int]) -> dict[int, int]:
    """Each word's places as a bit mask."""
    where: dict[int, int] = {}
    for i, x in enumerate(words_):
        where[x] = where.get(x, 0) | (1 << i)
    return where


def lcs_length(where: dict[int, int], n: int, text: list[int], least: int = 0) -> int:
    """Length of the longest common subsequence of n words (by ``places_of``) and a text,
    bit-parallel over the n words; 0 if too few words of the text are among them."""
    masks = [where[x] for x in text if x in where]
    if len(masks) < least:
        return 0
    full = (1 << n) - 1
    v = full
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _exact(p: Passages, b: Benchmark) -> list[tuple[int, int, int]]:
    """(row, item, start word) of the first place of each short item in each row of a chunk."""
    found: dict[tuple[int, int], int] = {}
    for n, items in b.short.items():
        if len(p.hash) < n:
            continue
        table = np.array(sorted(items), U64)
        h = _sequences(p.hash, n)
        at = np.flatnonzero((table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h)
                            & (p.row[:len(h)] == p.row[n - 1:]))
        for i in at.tolist():
            for item in items[int(h[i])]:
                found.setdefault((int(p.row[i]), item), i)
    return [(row, item, int(i - p.first_word[row])) for (row, item), i in found.items()]


def _finder(bench, projected: np.ndarray | None, cosine: float, lcs: float, lcs_with_answer: float):
    """A function that gives (row, item, start word, cosine, LCS share, answer found) of a column.
    Without a projection only short items are searched."""
    def start():
        b = bench.value
        if projected is not None:
            table = projected.astype(np.float32)
            queries = np.zeros((len(b.pieces), table.shape[1]), np.float32)
            for i, piece in enumerate(b.pieces):
                _, f = b.lookup(piece)
                queries[i] = table[f].sum(axis=0)
            queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
            least = b.least_hits(min(lcs, lcs_with_answer))
            of_item = np.searchsorted(b.owner, np.arange(len(b.items) + 1))  # each item's queries

        def find(column: pa.Array) -> list[tuple]:
            found = []
            for c in chunks(column, SEARCH_BYTES, lower=True):
                p = Passages(c, b)
                found += [(c.start + row, item, at, 1.0, 1.0, True) for row, item, at in _exact(p, b)]
                if projected is None:
                    continue
                block, item = p.candidates(b, least)
                near: dict[tuple[int, int], dict[int, float]] = {}
                for a in range(0, len(block), 16384):
                    some, of = block[a:a + 16384], item[a:a + 16384]
                    own, which = np.unique(some, return_inverse=True)
                    v = p.vectors(own, table)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    n = of_item[of + 1] - of_item[of]
                    pair = np.repeat(np.arange(len(some)), n)
                    q = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - of_item[of], n)
                    dots = np.einsum("nd,nd->n", v[which[pair]], queries[q])
                    for k in np.flatnonzero(dots >= cosine).tolist():
                        at, i = int(some[pair[k]]), int(of[pair[k]])
                        row = int(p.row_of_block[at])
                        places = near.setdefault((row, i), {})
                        at -= int(p.first_block[row])
                        places[at] = max(places.get(at, 0.0), float(dots[k]))
                for (row, item), places in near.items():
                    leak = _verified(p, b, row, item, places, lcs, lcs_with_answer)
                    if leak:
                        found.append((c.start + row, b.items[item], *leak))
            return found
        return find
    return start


def _search(start):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = start()
        for batch in batches:
            found = find(batch.column(1))
            if found:
                row, *rest = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in rest)],
                    names=["id", "item", "start_word", "cosine", "lcs", "answer_found"])
    return task


def _clean(start, text_at: int, id_at: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = start()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in find(batch.column(text_at).cast(pa.string()))]] = False
            keep |= ~np.asarray(batch.column(id_at).is_valid())
            yield batch.filter(pa.array(keep))
    return task


def _verified(p: Passages, b: Benchmark, row: int, item: int, places: dict[int, float], lcs: float,
              lcs_with_answer: float) -> tuple | None:
    """(start word, cosine, LCS share, answer found) of the best window around the candidate places."""
    n, first, where = len(b.hashes[item]), int(p.first_word[row]), b.where[item]
    end = int(p.first_word[row + 1]) if row + 1 < len(p.first_word) else len(p.hash)
    least = int(np.ceil(min(lcs, lcs_with_answer) * n - 1e-9))
    answer, answer_where = b.answers[item], b.answer_where[item]
    best = None
    ordered = sorted(places)
    group = [ordered[0]]
    for block in [*ordered[1:], None]:
        if block is not None and (block - group[-1]) * STRIDE <= n + WINDOW:
            group.append(block)
            continue
        lo = max(first, first + group[0] * STRIDE - n)
        hi = min(end, first + group[-1] * STRIDE + WINDOW + n)
        region = p.hash[lo:hi].tolist()
        own = None  # of the group: the last of its best windows, the one that begins with the match
        for a, z in _windows(region, where, n, least):
            window = region[a:z]
            share = lcs_length(where, n, window, least) / n
            if share * n < least:
                continue
            answered = lcs_length(answer_where, len(answer), window) >= 0.8 * len(answer)
            if share >= lcs or answered and share >= lcs_with_answer:
                got = (lo - first + a, max(places[x] for x in group), share, bool(answered))
                if own is None or got[2:] >= own[2:]:
                    own = got
        if own and (best is None or (own[2], own[1]) > (best[2], best[1])):
            best = own
        group = [block]
    return best


def _windows(region: list[int], where: dict[int, int], n: int, least: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the windows of 1.5 n words that begin with a word of the item and share
    ``least`` words with it, a word as often as both have it. Any other window holds no more
    of the item than one that begins with the item's next word."""
    at = [i for i, x in enumerate(region) if x in where]
    width = -(-3 * n // 2)
    # most regions have no window with so many of the item's words, however often one counts
    if not any(z - a < width for a, z in zip(at, at[max(least, 1) - 1:])):
        return
    spare = {x: where[x].bit_count() for x in where}
    shared = z = 0
    for a in at:
        while z < len(at) and at[z] < a + width:
            x = region[at[z]]
            shared += spare[x] > 0
            spare[x] -= 1
            z += 1
        if shared >= least:
            yield a, min(a + width, len(region))
        x = region[a]
        spare[x] += 1
        shared -= spare[x] > 0


def _finders(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
             rank: int = 64, cosine: float = 0.5, lcs: float = 0.75, lcs_with_answer: float = 0.55,
             common: float = 0.1, min_words: int = 8, block: int = 2000) -> list:
    """One search for each block of items, with its IDF and latent space fitted."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where("id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")) \
        .where("item is not null and text is not null").dropDuplicates(["item"])
    out, blocks = [], -(-items.count() // block)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item").collect()
        own = Benchmark([(r.item, r.text) for r in rows], common, min_words)
        if not own.items and not own.short:
            continue
        bench = spark.sparkContext.broadcast(own)
        if not own.items:
            out.append(_finder(bench, None, cosine, lcs, lcs_with_answer))
            continue
        df, total = np.zeros(len(own.features)), 0
        hits = linking.landed(texts.select("text").mapInArrow(_hits(bench), "passages long, keys binary"), "hits")
        try:
            for r in hits.mapInArrow(_document_frequency(len(own.features)), "feature long, n long") \
                    .groupBy("feature").agg(F.sum("n").alias("n")).collect():
                if r.feature < 0:
                    total = r.n
                else:
                    df[r.feature] = r.n
            idf = np.log((total + 1) / (df + 1)) + 0.1
            space = latent_space(hits, bench, idf, rank)
        finally:
            linking.release(hits)
        out.append(_finder(bench, idf[:, None] * space, cosine, lcs, lcs_with_answer))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """id_col, item_col, start_word, cosine, lcs, answer_found: each document and benchmark
    item found in it, once."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where("id is not null and text is not null")
    found = docs.sparkSession.createDataFrame([], RESULT)
    for start in _finders(docs, benchmark, id_col, text_col, item_col, item_text_col, **options):
        found = found.union(texts.mapInArrow(_search(start), RESULT))
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)) \
        .agg(F.max(F.struct("lcs", "cosine", (-F.col("start_word")).alias("back"), "answer_found")).alias("m")) \
        .select(id_col, item_col, (-F.col("m.back")).alias("start_word"), "m.cosine", "m.lcs", "m.answer_found")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """The rows in which no benchmark item was found, unchanged."""
    clean = docs
    for start in _finders(docs, benchmark, id_col, text_col, item_col, item_text_col, **options):
        clean = clean.mapInArrow(_clean(start, docs.columns.index(text_col), docs.columns.index(id_col)), docs.schema)
    return clean
