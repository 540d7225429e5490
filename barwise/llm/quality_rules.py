"""Quality rules by distribution divergence from language references.

Base counts of each whole text: words (runs of other than white space), their code points,
symbols, repeated lines, and words in repeated five-word windows. On top, two histograms of
the text, of character classes and of common words, are compared with references by the
Jensen-Shannon distance (base 2, 0 to 1).

References are counted over the whole table by language: all characters by class, and all
words (lower-cased) in ``buckets`` hash buckets, of which the ``common`` fullest of a
language stand for its common words and the rest is one class. Every language of at least
``least_words`` words has a reference. A text is held against each and keeps the least
distance, so that a text of another language than its label says isn't rejected for it.

Guards: a text of fewer than ``min_words`` words or ``min_chars`` code points in words is too
short for the histograms and is judged by the base rules alone. So is a text whose language
has no reference, or that has no language: its distances from the others' are given if there
are any, but say nothing against it. Rules: a null or empty text has no words and fails the base rules. Each input
row has one output row, whatever its id; repeated rows count repeatedly in the references.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import LOWER, SPACED, U64, Chunk, Words, chunks, mix, runs, word_hashes, words

CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "mark", "control", "other")
SYMBOLS = b"#*$%&|<>"
POINTS = b".,;:'\"-?()"
WINDOW = 5


def _class_table() -> np.ndarray:
    """The class of each byte; a byte that continues a character has none (9)."""
    t = np.full(256, 6)  # marks: other ASCII punctuation
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A] = 0, 1, 2
    t[:0x20], t[0x7F] = 7, 7
    t[[0x20, *range(0x09, 0x0E)]] = 3
    t[list(POINTS)], t[list(SYMBOLS)] = 4, 5
    t[0x80:] = 8
    t[0x80:0xC0] = 9
    return t


_CLASS = _class_table()


def per_row(c: Chunk, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[c.bounds[1:]] - total[c.bounds[:-1]]


def repeated_lines(c: Chunk, w: Words) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier line of the row."""
    if not len(w.first):
        return np.zeros(len(c), np.int64)
    breaks = np.flatnonzero(c.data == 0x0A)
    starts = np.unique(np.concatenate([breaks + 1, c.bounds[:-1]]))
    starts = starts[starts < len(c.data)]
    ends = np.minimum(np.append(breaks, len(c.data))[np.searchsorted(breaks, starts)],
                      c.bounds[np.searchsorted(c.bounds, starts, "right")])
    used = np.unique(np.searchsorted(starts, w.first, "right") - 1)
    first, end = starts[used], ends[used]
    row = np.searchsorted(c.bounds, first, "right") - 1
    h = c.span_hash(c.prefix_hash(), first, end)
    order = np.lexsort((h, row))
    again = np.ones(len(order), bool)
    again[runs(row[order], h[order])] = False
    return np.bincount(row[order][again], minlength=len(c))


def repeated_words(w: Words, h: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row in five-word windows that the row has twice or more."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return np.zeros(rows, np.int64)
    acc = np.zeros(n, U64)
    for i in range(WINDOW):
        acc = mix(acc * U64(0x9FB21C651E98DF25) + h[i:i + n])
    start = np.flatnonzero(w.row[:n] == w.row[WINDOW - 1:])
    both = (w.row[start].astype(U64) << U64(52)) | (acc[start] >> U64(12))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    at = start[order[same[1:] | same[:-1]]]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return np.bincount(w.row[np.cumsum(step)[:-1] > 0], minlength=rows)


def _buckets(c: Chunk, w: Words, buckets: int) -> np.ndarray:
    lower = Chunk(c.start, c.stop, LOWER[c.data], c.bounds)
    return (word_hashes(lower, w) % U64(buckets)).astype(np.int64)


def _count(buckets: int):
    """(lang, cell, n): characters by class and words by bucket, for each language."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for c in chunks(batch.column(1)):
                w = words(c, SPACED)
                row_of = np.repeat(np.arange(len(c)), np.diff(c.bounds))
                own = langs[c.start:c.stop]
                for lang in set(own.tolist()):
                    if lang is None:
                        continue
                    mine = own == lang
                    total = totals.setdefault(lang, np.zeros(10 + buckets, np.int64))
                    total[:10] += np.bincount(_CLASS[c.data[mine[row_of]]], minlength=10)
                    total[10:] += np.bincount(_buckets(c, w, buckets)[mine[w.row]], minlength=buckets)
                if len(totals) > 200:
                    yield from rows(totals)
                    totals.clear()
        yield from rows(totals)

    def rows(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at),
                                              pa.array(total[at])], names=["lang", "cell", "n"])
    return task


class References:
    """Of each language: the shares of character classes, its common words' buckets and their
    shares (the last share is that of all other words)."""

    def __init__(self, rows: list, buckets: int):
        self.langs, self.chars, self.slots, self.words = [], [], [], []
        for r in sorted(rows, key=lambda r: r.lang):
            chars = np.zeros(9)
            for x in r.chars:
                chars[x.cell] = x.n
            counts = np.array([x.n for x in r.top], float)
            slot = np.full(buckets, len(counts), np.min_scalar_type(len(counts)))
            slot[[x.cell - 10 for x in r.top]] = np.arange(len(counts))
            self.langs.append(r.lang)
            self.chars.append(chars / chars.sum())
            self.slots.append(slot)
            self.words.append(np.append(counts, r.words - counts.sum()) / r.words)


def references(docs: DataFrame, text_col: str, lang_col: str, buckets: int, common: int, least_words: int) -> References:
    """Counted over the whole table; of each language nine classes and ``common`` buckets come back."""
    counted = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_count(buckets), "lang string, cell long, n long") \
        .groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # the fullest buckets first, of equally full ones the first; by parts of the buckets, then of all
    best = lambda c: F.slice(F.array_sort(c), 1, common)
    parts = counted.groupBy("lang", F.pmod("cell", F.lit(32)).alias("part")).agg(
        F.sum(F.when(F.col("cell") >= 10, F.col("n"))).alias("words"),
        F.collect_list(F.when(F.col("cell") < 9, F.struct("cell", "n"))).alias("chars"),
        best(F.collect_list(F.when(F.col("cell") >= 10, F.struct((-F.col("n")).alias("m"), "cell", "n")))).alias("top"))
    return References(parts.groupBy("lang").agg(
        F.sum("words").alias("words"), F.flatten(F.collect_list("chars")).alias("chars"),
        best(F.flatten(F.collect_list("top"))).alias("top")).where(F.col("words") >= least_words).collect(), buckets)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance (root of the divergence in bits) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _judge(shipped, buckets: int, min_words: int, min_chars: int, most_chars: float, most_words: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shipped.value
        have = set(refs.langs)
        for batch in batches:
            own = np.array([x in have for x in batch.column(2).to_pylist()], bool)
            for c in chunks(batch.column(1)):
                w = words(c, SPACED)
                h = word_hashes(c, w)
                rows = len(c)
                n_words = w.counts(rows)
                kind = _CLASS[c.data]
                word_chars = per_row(c, SPACED[c.data] & (kind != 9))
                n_symbols = per_row(c, kind == 5)
                dup_lines, repeated = repeated_lines(c, w), repeated_words(w, h, rows)
                failed = (n_words < 10) | (100 * repeated > 20 * n_words)
                by_char, by_word = np.full(rows, np.inf), np.full(rows, np.inf)
                if refs.chars:
                    row_of = np.repeat(np.arange(rows), np.diff(c.bounds))
                    chars = _shares(np.bincount(row_of * 10 + kind, minlength=rows * 10).reshape(rows, 10)[:, :9])
                    bucket = _buckets(c, w, buckets)
                    for ref, slot, share in zip(refs.chars, refs.slots, refs.words):
                        found = _shares(np.bincount(w.row * len(share) + slot[bucket],
                                                    minlength=rows * len(share)).reshape(rows, len(share)))
                        one, two = jensen_shannon(chars, ref), jensen_shannon(found, share)
                        better = one + two < by_char + by_word
                        by_char, by_word = np.where(better, one, by_char), np.where(better, two, by_word)
                known = (n_words >= min_words) & (word_chars >= min_chars) & np.isfinite(by_char)
                kept = ~failed & ~(known & own[c.start:c.stop] & ((by_char > most_chars) | (by_word > most_words)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.start, rows), pa.array(n_words), pa.array(word_chars.astype(np.int64)),
                     pa.array(n_symbols.astype(np.int64)), pa.array(dup_lines.astype(np.int64)),
                     pa.array(repeated.astype(np.int64)), pa.array(failed), pa.array(kept),
                     pa.array(by_char, mask=~known), pa.array(by_word, mask=~known)], names=NAMES)
    return task


NAMES = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
         "char_distance", "word_distance"]


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_words: int = 50, min_chars: int = 200, most_chars: float = 0.28, most_words: float = 0.5,
                    buckets: int = 8192, common: int = 64, least_words: int = 1000) -> DataFrame:
    """id_col, the base counts, base_failed, kept, and the two distances from the nearest
    reference (null where a guard applies)."""
    refs = docs.sparkSession.sparkContext.broadcast(
        references(docs, text_col, lang_col, buckets, common, least_words))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        _judge(refs, buckets, min_words, min_chars, most_chars, most_words),
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, char_distance double, word_distance double") \
        .withColumnRenamed("id", id_col)
