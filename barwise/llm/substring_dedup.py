"""Repeated byte strings: sampled suffixes, names, remaining suffixes, adjacent prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the table
(smaller id, or the same document and an earlier start). The steps are those of suffix
sorting with a difference cover, cut at ``length`` bytes, where only equality matters:

* Sample. A cover picks positions such that any two equal ``length``-byte strings hold a
  sampled position at the same offset. ``cover="difference"`` takes positions in a perfect
  difference set modulo 73 (9 of 73 positions). ``cover="synchronising"``, the default,
  takes in each ``length``-byte window the position of the least hash among its 73 grams of
  28 bytes (a string synchronising set: about 2 of 74 positions), so that equal windows pick
  equal offsets. README states why, with figures.
* Name. A sampled suffix is named by its first 28 bytes; suffixes are sorted by name and
  names that occur once are dropped.
* Recurse. The others get a longer name: all bytes of the windows that they stand for. Of
  the suffixes with one long name, all but the first are repeats, with all their windows.
* Merge. Windows of suffixes whose short names are shared by several long ones (match
  edges) are the remaining suffixes. Any such window holds, besides the short name's bytes,
  half of the other bytes on one side of it, so these first get a name over that stretch and
  those whose stretch is shared stay. Each window left is named by its ``length`` bytes, sorted,
  and compared with its neighbours; all but the first of a name are repeats.

Equal names within a text are one row before anything is shuffled. Partitions are sorted by
name and place and then read once, row after row, so the first of a name is the one before
its repeats: a group of equal names is never held in memory. Names are 64-bit hashes. Rules: a null or empty text has no bytes; a text
shorter than ``length`` loses none. Rows with a null id are neither compared nor changed.
Places in rows that share an id are compared as in one document; a repeated row is not
earlier than itself. Other columns are ignored. Strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .packing import packed, unpacked
from .textarrays import U64, Chunk, chunks, mix, runs

GRAM = 28
#: A perfect difference set modulo 73: each residue but 0 is a difference of just one pair.
DIFFERENCES = (1, 2, 4, 8, 16, 32, 37, 55, 64)
MODULUS = 73
SPANS = "array<struct<lo:int,end:int>>"
SAMPLE = f"key long, name long, id long, place int, lo int, hi int, more {SPANS}"
WINDOW = f"key long, id long, place int, more {SPANS}"
SPAN_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("end", pa.int32())]))


def _least_in_windows(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least value, the first of ties."""
    n = len(g) - width + 1
    blocks = -(-len(g) // width)
    padded = np.full(blocks * width, U64(0xFFFFFFFFFFFFFFFF))
    padded[:len(g)] = (g & ~U64(0xFF))
    padded = padded.reshape(blocks, width) | np.arange(width, dtype=U64)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    left, right = behind[:n], ahead[width - 1:width - 1 + n]
    at = np.arange(n)
    use = (right >> U64(8)) < (left >> U64(8))
    best = np.where(use, right, left)
    base = np.where(use, (at + width - 1) // width, at // width) * width
    return base + (best & U64(0xFF)).astype(np.int64)


def sampled(c: Chunk, length: int, cover: str) -> tuple[np.ndarray, ...]:
    """(row, place, lo, hi, short name, long name): sampled positions of a chunk, and the
    first and last start of the windows each stands for (all as positions in the chunk)."""
    data, bounds = c.data, c.bounds
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    prefix = c.prefix_hash()
    size = np.diff(bounds)
    if cover == "difference":
        row = np.repeat(np.arange(len(c)), size)
        inner = np.arange(len(data)) - bounds[row]
        wanted = np.isin(np.arange(MODULUS), [d % MODULUS for d in DIFFERENCES])
        place = np.flatnonzero(wanted[inner % MODULUS] & (inner + GRAM <= size[row]) & (size[row] >= length))
        row = row[place]
        lo = np.maximum(place - (MODULUS - 1), bounds[row])
        hi = np.minimum(place, bounds[row + 1] - length)
        ok = lo <= hi
        row, place, lo, hi = row[ok], place[ok], lo[ok], hi[ok]
    else:
        n = len(data)
        grams = c.span_hash(prefix, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        least = _least_in_windows(grams, length - GRAM + 1)
        windows = np.maximum(size - length + 1, 0)
        row = np.repeat(np.arange(len(c)), windows)
        start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[row]
        place = least[start]
        begin = runs(row, place)
        stop = np.append(begin[1:], len(row)) - 1
        row, place, lo, hi = row[begin], place[begin], start[begin], start[stop] if len(begin) else start[begin]
    short = c.span_hash(prefix, place, place + GRAM)
    long = mix(c.span_hash(prefix, lo, hi + length) + (place - lo).astype(U64))
    return row, place, lo, hi, short, long


def first_of_each(lo: np.ndarray, end: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, list]:
    """Of rows in order of place, the first of each combination of ``names``, and for each
    of these the runs (lo, end) that its repeats cover together, None without repeats. So a
    string that a text repeats many times is one row."""
    order = np.lexsort(names[::-1])  # stable: places stay in order
    begin = runs(*(x[order] for x in names))
    stop = np.append(begin[1:], len(order))
    more: list = [None] * len(begin)
    for i in np.flatnonzero(stop - begin > 1).tolist():
        again = order[begin[i] + 1:stop[i]]
        more[i] = [{"lo": a, "end": b} for a, b in zip(*(x.tolist() for x in covered(lo[again], end[again])))]
    return order[begin], more


def _samples(length: int, cover: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for c in chunks(batch.column(1)):
                row, place, lo, hi, short, long = sampled(c, length, cover)
                base = c.bounds[row]
                place, lo, hi = place - base, lo - base, hi - base
                keep, more = first_of_each(lo, hi + length, row, short, long)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(short[keep].view(np.int64)), pa.array(long[keep].view(np.int64)),
                     pa.array(ids[c.start + row[keep]]),
                     *(pa.array(x[keep].astype(np.int32)) for x in (place, lo, hi)), pa.array(more, SPAN_TYPE)],
                    names=["key", "name", "id", "place", "lo", "hi", "more"])
    return task


def _windows(length: int):
    """(key, id, place, more) of the windows that start in the spans of packed texts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at in range(0, batch.num_rows, 200):
                texts = unpacked(batch.column(1).slice(at, 200))
                spans = batch.column(2).slice(at, 200)
                for c in chunks(texts):
                    prefix = c.prefix_hash()
                    for r in range(len(c)):
                        pairs = spans[c.start + r].values
                        base, n = int(c.bounds[r]), int(c.bounds[r + 1] - c.bounds[r])
                        lo, hi = (np.asarray(x) for x in pairs.flatten())
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, lo, 1)
                        np.add.at(step, hi + 1, -1)
                        start = np.flatnonzero(np.cumsum(step)[:n] > 0)
                        h = c.span_hash(prefix, base + start, base + start + length)
                        keep, more = first_of_each(start, start + length, h)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[keep].view(np.int64)), pa.array(np.full(len(keep), ids[at + c.start + r])),
                             pa.array(start[keep].astype(np.int32)), pa.array(more, SPAN_TYPE)],
                            names=["key", "id", "place", "more"])
    return task


def _longer_names(length: int):
    """(key, id, lo, hi) of the match edges (place, lo, hi) of packed texts: a window that
    starts at most ``half`` bytes before the sampled place holds the bytes from there to its own
    end at least, any other the ``half + 1`` bytes before the place. Each edge gives a row for
    either kind of its windows, named by these bytes and the short name's."""
    rest = length - GRAM
    half = (rest - 1) // 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at in range(0, batch.num_rows, 200):
                edges = batch.column(2).slice(at, 200)
                for c in chunks(unpacked(batch.column(1).slice(at, 200))):
                    some = edges.slice(c.start, len(c))
                    counts = np.diff(np.asarray(some.offsets))
                    row = np.repeat(np.arange(len(c)), counts)
                    place, lo, hi = (np.asarray(x).astype(np.int64) for x in some.flatten().flatten())
                    prefix, start = c.prefix_hash(), c.bounds[row] + place
                    near, far = np.maximum(lo, place - half) <= hi, lo <= place - half - 1
                    right = c.span_hash(prefix, start[near], start[near] + GRAM + rest - half)
                    left = c.span_hash(prefix, start[far] - half - 1, start[far] + GRAM)
                    key = np.concatenate([right, mix(left ^ U64(0x9E3779B97F4A7C15))])
                    owner = ids[at + c.start + np.concatenate([row[near], row[far]])]
                    first = np.concatenate([np.maximum(lo, place - half)[near], lo[far]])
                    last = np.concatenate([hi[near], np.minimum(hi, place - half - 1)[far]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(owner), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                        names=["key", "id", "lo", "hi"])
    return task


def covered(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (first, end) that the spans cover together; touching spans join."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    begin = np.flatnonzero(new)
    return lo[begin], end[np.append(begin[1:], len(lo)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, kept, first, end) of packed texts with their spans to remove."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            texts = unpacked(batch.column(1).slice(at, 200)).cast(pa.large_binary())
            kept, firsts, ends = [], [], []
            for text, spans in zip(texts, batch.column(2).slice(at, 200)):
                raw = text.as_py()
                first, end = covered(*(np.asarray(x) for x in spans.values.flatten()))
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(raw)])))
                firsts.append(first.tolist())
                ends.append(end.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 200), pa.array(kept, pa.binary()), pa.array(firsts, pa.list_(pa.int32())),
                 pa.array(ends, pa.list_(pa.int32()))], names=["id", "kept", "first", "end"])


def _first_places(start: np.ndarray, ident: np.ndarray, place: np.ndarray, held: tuple | None) -> np.ndarray:
    """For rows in runs that begin where ``start`` holds (the first may continue one whose first
    place is ``held``): whether a row stands at another place than its run's first."""
    of = np.maximum.accumulate(np.where(start, np.arange(len(start)), -1))
    at = np.maximum(of, 0)
    first_id, first_place = ident[at], place[at]
    if held is not None:
        first_id[of < 0], first_place[of < 0] = held
    return (ident != first_id) | (place != first_place)


def _flat(column: pa.Array, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, lo, end) of all spans in a list column."""
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    lo, end = (np.asarray(x) for x in column.flatten().flatten())
    return np.repeat(ident, np.diff(np.asarray(column.offsets))), lo, end


def _judged(length: int):
    """Of samples in order of (key, name, id, place): the spans of all but the first of a name, and
    the first of each name of keys with several names (match edges). What is held from one
    batch to the next is a row."""
    names = ["edge", "id", "place", "lo", "end"]

    def made(edge: bool, ident, place, lo, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ident), edge)), pa.array(ident, pa.int64()),
                                           *(pa.array(x, pa.int32()) for x in (place, lo, end))], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None   # (key, name) and first place of the run that the batch before ended in
        alone = None          # the first row of that key's only name so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key, name, ident, place, lo, hi = (np.asarray(batch.column(i)) for i in range(6))
            new_key, new_name = np.ones(len(key), bool), np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_key[0] = last is None or key[0] != last[0]
            new_name[1:] = new_key[1:] | (name[1:] != name[:-1])
            new_name[0] = new_key[0] or name[0] != last[1]
            again = _first_places(new_name, ident, place, first)
            if again.any():
                yield made(False, ident[again], place[again], lo[again], hi[again] + length)
            owner, span_lo, span_end = _flat(batch.column(6), ident)
            if len(owner):
                yield made(False, owner, span_lo, span_lo, span_end)
            # names of each key run in this batch, with those of the batch before for the first one
            run = np.cumsum(new_key) - 1 + (not new_key[0])
            count = np.bincount(run, weights=new_name).astype(np.int64)
            several = count > 1
            if not new_key[0]:
                if alone is None:
                    several[0] = True  # its names so far are edges already
                elif count[0]:
                    several[0] = True
                    yield made(True, *([x] for x in alone))
            edge = new_name & several[run]
            if edge.any():
                yield made(True, ident[edge], place[edge], lo[edge], hi[edge])
            if several[-1]:
                alone = None
            elif count[-1]:
                i = int(np.flatnonzero(new_name)[-1])
                alone = (int(ident[i]), int(place[i]), int(lo[i]), int(hi[i]))
            last = (key[-1], name[-1])
            if new_name.any():
                i = int(np.flatnonzero(new_name)[-1])
                first = (ident[i], place[i])
    return task


def _later(length: int):
    """Of windows in order of (key, id, place): the spans (id, lo, end) of all but the first of a key."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ident, place = (np.asarray(batch.column(i)) for i in range(3))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is None or key[0] != last
            again = _first_places(new, ident, place, first)
            owner, lo, end = _flat(batch.column(3), ident)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ident[again], owner]), pa.int64()),
                 pa.array(np.concatenate([place[again], lo]), pa.int32()),
                 pa.array(np.concatenate([place[again] + length, end]), pa.int32())], names=["id", "lo", "end"])
            last = key[-1]
            if new.any():
                i = int(np.flatnonzero(new)[-1])
                first = (ident[i], place[i])
    return task


def repeated_spans(texts: DataFrame, length: int, cover: str) -> tuple[DataFrame, DataFrame]:
    """(spans, stored): spans (id, lo, end) that cover all bytes to remove, and (id, packed),
    the texts that have any."""
    samples = texts.mapInArrow(_samples(length, cover), SAMPLE).repartition("key") \
        .sortWithinPartitions("key", "name", "id", "place")
    judged = linking.landed(samples.mapInArrow(_judged(length), "edge boolean, id long, place int, lo int, end int"),
                            "judged")
    del samples
    repeats = judged.where(~F.col("edge")).select("id", "lo", "end")
    edges = linking.landed(judged.where("edge").groupBy("id").agg(
        F.collect_list(F.struct("place", "lo", F.col("end").alias("hi"))).alias("edges")), "edges")
    touched = judged.select("id").distinct()
    stored = linking.landed(packed(texts).join(touched, "id", "left_semi"), "touched")
    # most edges share little more than the short name: only windows inside a longer common
    # stretch are expanded
    named = stored.join(edges, "id").mapInArrow(_longer_names(length), "key long, id long, lo int, hi int")
    stretches = linking.landed(linking.repeated_keys(named, "key").groupBy("id").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans")), "stretches")
    del named
    linking.release(edges)
    windows = stored.join(stretches, "id").mapInArrow(_windows(length), WINDOW).repartition("key") \
        .sortWithinPartitions("key", "id", "place")
    later = linking.landed(windows.mapInArrow(_later(length), "id long, lo int, end int"), "later")
    linking.release(stretches)
    return repeats.union(later), stored


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                cover: str = "synchronising") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 for each row, and kept (binary, null
    where nothing was removed), removed_first and removed_end (byte bounds of the runs)."""
    if length < GRAM + 1 or (cover == "difference" and length - GRAM + 1 != MODULUS):
        raise ValueError("length must exceed 28 bytes, and be 100 for the difference cover")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spans, stored = repeated_spans(rows.where("id is not null and text is not null"), length, cover)
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))
    cut = stored.dropDuplicates(["id"]).join(spans, "id") \
        .mapInArrow(_cut, "id long, kept binary, first array<int>, end array<int>")
    plain = rows.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return plain.join(cut, "id", "left").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(F.col("first").isNull(), 0).otherwise(F.col("n_bytes") - F.octet_length("kept")).cast("long")
        .alias("n_removed"),
        F.when(F.col("first").isNull(), 0).otherwise(F.size("first")).cast("long").alias("n_spans"),
        F.when(F.col("first").isNull(), F.col("sha")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
        "kept", F.col("first").alias("removed_first"), F.col("end").alias("removed_end"))
