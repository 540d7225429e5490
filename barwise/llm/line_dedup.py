"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Every line that has a word takes part, by its trimmed form (A-Z lower-cased). Lines of fewer
than ``k`` characters have no shingle: they are linked to their exact copies only, by hash. Lines are counted as distinct rows first,
so a line that stands everywhere is one row in the join. Each longer line gets a one-permutation MinHash of
its distinct character ``k``-shingles in ``bands`` bands of ``rows`` values; lines that
agree on a band meet, and pairs that meet are verified by the exact Jaccard similarity of
their shingle sets (``similarity`` or more links them). At 0.8 a pair meets with a
probability of 1 - (1 - 0.8**4)**9 = 0.99; equal lines always do. Components of linked
lines come from a distributed union-find. Of each component one line stays in the whole
table: the first, by document id and line number.

Rules: a null text stays null, an empty one empty. Rows with a null id are kept as they are
and their lines are not compared. Rows that share an id count as one document: a repeated
row gets the decisions of the first. Columns other than id and text pass through. An empty
table gives an empty result. No line, group or candidate is capped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import linking
from .packing import packed
from .textarrays import SPACED, U64, Chunk, chunks, mix, runs

_NONE = U64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.flatnonzero(~SPACED).astype(np.uint8).tobytes()
_BITS = 44
_BLOCK = 1 << 15  # shingles that are held at a time (they stay in a core's cache)
_LINES = 1 << 11  # lines whose shingle sets are held at a time
#: Bytes of text whose lines are signed at a time.
SIGN_BYTES = 1 << 17


def line_spans(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, first, end) of the trimmed form of each line that has a word."""
    breaks = np.flatnonzero(c.data == 0x0A) + 1
    starts = np.unique(np.concatenate([breaks, c.bounds[:-1]]))
    starts = starts[starts < len(c.data)]
    inside = np.flatnonzero(SPACED[c.data])
    at = np.append(np.searchsorted(inside, starts), len(inside))
    filled = np.flatnonzero(at[1:] > at[:-1])
    first, end = inside[at[filled]], inside[at[filled + 1] - 1] + 1
    row = np.searchsorted(c.bounds, first, "right") - 1
    before = np.searchsorted(breaks, c.bounds[row], "right")
    return row, np.searchsorted(breaks, first, "right") - before, first, end


def shingles(c: Chunk, prefix: np.ndarray, chars: np.ndarray, first: np.ndarray, end: np.ndarray,
             k: int) -> np.ndarray:
    """Sorted distinct (span << 44 | shingle hash) of byte spans with k characters or more."""
    lo = np.searchsorted(chars, first)
    counts = np.searchsorted(chars, end) - lo - k + 1
    span = np.repeat(np.arange(len(first)), counts)
    at = np.arange(len(span)) - np.repeat(np.cumsum(counts) - counts - lo, counts)
    h = c.span_hash(prefix, chars[at], chars[at + k])
    both = np.sort((span.astype(U64) << U64(_BITS)) | (h >> U64(64 - _BITS)))
    return both[runs(both)]


def _least_hashes(c: Chunk, prefix: np.ndarray, chars: np.ndarray, lo: np.ndarray, counts: np.ndarray, k: int,
                  bins: int) -> np.ndarray:
    """(n, bins) smallest shingle hash in each bin of n spans (``band_keys``)."""
    n, total = len(lo), int(counts.sum())
    base = int(lo.min()) if n else 0
    size = int((lo + counts).max()) - base if n else 0
    gaps = lo[1:] - lo[:-1] - counts[:-1]
    if size <= 2 * total and (gaps >= 0).all():
        # the spans' characters lie close together: hashes of all shingles between, those of no
        # span in a row of their own
        h = c.run_hash(prefix, chars[base:base + size + k], k)
        row = np.full(2 * n - 1, n)
        row[::2] = np.arange(n)
        each = np.empty(2 * n - 1, np.int64)
        each[::2], each[1::2] = counts, gaps
        slot = np.repeat(row * bins, each)
    else:
        slot = np.repeat(np.arange(n) * bins, counts)
        at = np.arange(total) + np.repeat(lo - (np.cumsum(counts) - counts), counts)
        h = c.span_hash(prefix, chars[at], chars[at + k])
    h >>= U64(64 - _BITS)
    bin_ = h * U64(bins)
    bin_ >>= U64(_BITS)
    slot += bin_.view(np.int64)
    least = np.full((n + 1) * bins, _NONE)
    np.minimum.at(least, slot, h)
    return least.reshape(n + 1, bins)[:n]


def band_keys(c: Chunk, prefix: np.ndarray, chars: np.ndarray, lo: np.ndarray, counts: np.ndarray, k: int, bands: int,
              rows: int) -> np.ndarray:
    """(n, bands) keys of n spans that begin at the characters ``lo`` and have ``counts`` k-shingles:
    the smallest shingle hash in each of bands * rows bins, an empty bin taking the next filled
    one's value, folded by band."""
    n, bins = len(lo), bands * rows
    least = np.empty((n, bins), U64)
    upto = np.cumsum(counts)
    a = 0
    while a < n:  # some spans at a time, one at least
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _BLOCK, "right")))
        least[a:b] = _least_hashes(c, prefix, chars, lo[a:b], counts[a:b], k, bins)
        a = b
    open_ = np.flatnonzero((least == _NONE).any(axis=1))
    of, full = least[open_], least[open_]
    for step in range(1, bins):
        need = full == _NONE
        if not need.any():
            break
        near = np.roll(of, -step, axis=1)
        need &= near != _NONE
        full[need] = mix(near[need] + U64(step * 0x9E3779B97F4A7C15 % 2**64))
    least[open_] = full
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=U64)), (n, 1))
    for i in range(rows):
        keys = mix(keys * U64(0x9FB21C651E98DF25) + least[:, i::rows])
    return keys


def _eligible(c: Chunk, k: int):
    """Where the characters begin, the spans of the lines to compare fuzzily (row, number, first,
    end, first character, shingles), and those of the shorter ones."""
    row, number, first, end = line_spans(c)
    chars = np.append(np.flatnonzero((c.data & 0xC0) != 0x80), len(c.data))
    lo = np.searchsorted(chars, first)
    counts = np.searchsorted(chars, end) - lo - k + 1
    spans, ok = (row, number, first, end, lo, counts), counts > 0
    return chars, tuple(x[ok] for x in spans), tuple(x[~ok] for x in spans)


def _signed_lines(k: int, bands: int, rows: int):
    """(id, line, hash, b0, b1, ...) of every line; the bands only where the line is compared
    fuzzily and stands for the first time in the chunk."""
    names = ["id", "line", "hash", *(f"b{i}" for i in range(bands))]
    none = pa.nulls(0, pa.int64())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for c in chunks(batch.column(1), SIGN_BYTES, lower=True):
                chars, long, short = _eligible(c, k)
                prefix = c.prefix_hash()
                row, number, first, end, lo, counts = (np.concatenate(x) for x in zip(long, short))
                line = c.span_hash(prefix, first, end).view(np.int64)
                new = np.sort(np.unique(line[:len(long[0])], return_index=True)[1])  # in the text's order
                again = np.setdiff1d(np.arange(len(line)), new)
                keys = band_keys(c, prefix, chars, lo[new], counts[new], k, bands, rows).view(np.int64)
                for some, signs in ((new, [pa.array(np.ascontiguousarray(keys[:, i])) for i in range(bands)]),
                                    (again, [pa.nulls(len(again), none.type)] * bands)):
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[c.start + row[some]]), pa.array(number[some], pa.int32()), pa.array(line[some]),
                             *signs], names=names)
    return task


def _wanted_lines(k: int):
    """(id, value, size): the trimmed, lower-cased wanted lines of packed texts. Only these are
    looked at; a line of fewer than k characters is none of them."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("lines"))
            squeezed = batch.column(batch.schema.get_field_index("packed"))
            for at in range(0, batch.num_rows, 200):
                values = []
                for text, numbers in zip(squeezed.slice(at, 200), wanted.slice(at, 200).to_pylist()):
                    text = unzip.decompress(text.as_buffer()).split(b"\n")
                    # rows that share an id may have fewer lines
                    lines = [text[n].strip(_SPACE).lower().decode() for n in set(numbers) if n < len(text)]
                    values += [x for x in lines if len(x) >= k]
                for c in chunks(pa.array(values, pa.large_string())):
                    line = c.span_hash(c.prefix_hash(), c.bounds[:-1], c.bounds[1:]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(line), pa.array(values[c.start:c.stop], pa.string()),
                         pa.array(np.diff(c.bounds).astype(np.int32))], names=["id", "value", "size"])
    return task


def shingle_sets(k: int):
    """Lines to their sorted distinct shingle hashes."""
    def expand(column: pa.Array) -> list[np.ndarray]:
        out = []
        for c in chunks(column, rows=_LINES):
            chars = np.append(np.flatnonzero((c.data & 0xC0) != 0x80), len(c.data))
            both = shingles(c, c.prefix_hash(), chars, c.bounds[:-1], c.bounds[1:], k)
            stop = np.searchsorted(both >> U64(_BITS), np.arange(len(c)), "right")
            low = both & U64((1 << _BITS) - 1)
            out += [low[a:b] for a, b in zip(np.concatenate([[0], stop[:-1]]), stop)]
        return out
    return expand


def place() -> Column:
    """``id`` and ``line`` as one number in their order. Unlike a pair it has a fixed width, so
    that aggregates of it go by hash, without sorting their rows."""
    return F.col("id").cast("decimal(20,0)") * F.lit(Decimal(1 << 31)) + F.col("line").cast("decimal(10,0)")


def distinct_lines(signed: DataFrame, keys: list[str]) -> DataFrame:
    """(hash, keys, n, first, id, line) of each line: how often it stands, its first place and
    the id and number of one that has it."""
    return signed.groupBy("hash").agg(
        *[F.max(b).alias(b) for b in keys], F.count("*").alias("n"), F.min(place()).alias("first"),
        F.min("id").alias("id"), F.min_by("line", "id").alias("line"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8,
                  bands: int = 9, rows: int = 4, similarity: float = 0.8) -> DataFrame:
    """(id, removed): the sorted numbers (from 0) of the lines to remove, for each document
    that loses any."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where("id is not null and text is not null")
    keys = [f"b{i}" for i in range(bands)]
    signed = linking.landed(texts.mapInArrow(
        _signed_lines(k, bands, rows),
        ", ".join(["id long, line int, hash long", *(f"{b} long" for b in keys)])), "lines")
    # a line that stands a million times is one row from here on
    distinct = linking.landed(distinct_lines(signed, keys), "distinct")
    banded = distinct.where("b0 is not null").select("hash", F.explode(F.array(*keys)).alias("band"))
    grouped = linking.landed(linking.shared_groups(banded, "band", "hash"), "groups")
    wanted = distinct.join(grouped.select(F.col("id").alias("hash")).distinct(), "hash") \
        .groupBy("id").agg(F.collect_list("line").alias("lines"))
    # merged whatever the size of ``wanted``: no task packs and unpacks, with a worker for each
    sets = linking.landed(
        packed(texts).join(wanted.hint("merge"), "id").mapInArrow(_wanted_lines(k), "id long, value string, size int")
        .dropDuplicates(["id"]), "sets")
    comp = linking.linked_components(spark, grouped, sets, shingle_sets(k), round(similarity * 1000), 1000)
    linking.release(grouped, sets)
    # a line that stands once and is linked with none stays
    placed = distinct.select("hash", "n", "first").join(comp.withColumnRenamed("id", "hash"), "hash", "left") \
        .where("n > 1 or comp is not null").select("hash", F.coalesce("comp", "hash").alias("comp"), "first")
    kept = placed.groupBy("comp").agg(F.min("first").alias("kept"))
    kept = linking.landed(placed.join(kept, "comp").select("hash", "kept"), "kept")
    linking.release(distinct)
    return signed.select("id", "line", "hash").join(kept, "hash").where(place() != F.col("kept")) \
        .groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers; a null text stays null."""
    def rest(t, gone):
        if t is None or gone is None:
            return t
        out = set(gone.tolist())
        return "\n".join([x for i, x in enumerate(t.split("\n")) if i not in out])
    return pd.Series([rest(t, gone) for t, gone in zip(text, removed)], dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with ``text`` rewritten and two columns more: n_lines (lines before) and
    removed_lines (numbers of the lines that went; empty if none). Input columns of these two
    names are replaced by them."""
    own, gone_ = (f"{x}-{uuid.uuid4().hex}" for x in ("id", "removed"))  # no input column has these names
    gone = removed_lines(docs, id_col, text_col, **options).select(F.col("id").alias(own), F.col("removed").alias(gone_))
    text, removed = F.col(text_col), F.col(f"`{gone_}`")
    whole = text.cast("string")
    joined = docs.drop(*[c for c in ("n_lines", "removed_lines") if c not in (id_col, text_col)]) \
        .join(gone, docs[id_col].cast("long") == gone[f"`{own}`"], "left")
    # marked, as else a condition on the text would have the lines cut once more, by workers of its own
    left = without_lines.asNondeterministic()(F.when(removed.isNotNull(), text.cast("string")), removed)
    return joined.select(
        *[F.when(removed.isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`")
          for c in joined.columns if c not in (own, gone_)],
        F.when(text.isNull(), 0).otherwise(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1)
        .cast("long").alias("n_lines"),
        F.coalesce(removed, F.array().cast("array<int>")).alias("removed_lines"))
