"""Vectorised views of a batch of texts: one byte array, word bounds, 64-bit word hashes.

Used inside ``mapInArrow`` tasks. Every function works on a *chunk*: some consecutive rows
of an Arrow string column, cut so that the numpy temporaries (eight bytes for each byte of
text) stay small. A text is never split: a text longer than the limit is a chunk by itself.

Hashes are polynomial in the bytes modulo 2**64 over a table of random odd values and then
mixed, so that equal words have equal hashes and different words collide about as often as
random 64-bit numbers do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = (np.ones(1, U64), np.ones(1, U64))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for each byte that lies in none of the ranges: the bytes of words."""
    table = np.ones(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = False
    return table


#: Bytes of words parted by white space: [^\x20\x09-\x0D]+
SPACED = byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words parted by all ASCII but digits and letters.
ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Lower-cases A-Z and leaves the other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = (np.full(size, b, U64) for b in (_BASE, pow(_BASE, -1, 2**64)))
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return _powers


@dataclass
class Chunk:
    """Rows start..stop of a column: their bytes and where each row's text begins and ends."""
    start: int
    stop: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return self.stop - self.start

    def prefix_hash(self) -> np.ndarray:
        """c with c[j] - c[i], times the base's power -i, a hash of the bytes i..j."""
        n = len(self.data)
        c = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[self.data] * _power_tables(n + 1)[0][:n], dtype=U64, out=c[1:])
        return c

    def run_hash(self, c: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """``span_hash`` of the spans at[i]..at[i + k] (``at`` ascends)."""
        down = _power_tables(len(self.data) + 1)[1]
        if len(at) > k and at[-1] - at[0] == len(at) - 1:  # one byte for each place
            ends = c[at[0]:at[-1] + 1]
            raw = ends[k:] - ends[:-k]
            raw *= down[at[0]:at[-k]]
            raw += U64(k * 0xD6E8FEB86659FD93 % 2**64)
            return mix(raw)
        ends = c[at]
        raw = ends[k:] - ends[:-k]
        raw *= down[at[:-k]]
        raw += (at[k:] - at[:-k]).view(U64) * U64(0xD6E8FEB86659FD93)
        return mix(raw)

    def span_hash(self, c: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte span, with its length in it."""
        raw = (c[end] - c[first]) * _power_tables(len(self.data) + 1)[1][first]
        return mix(raw + (end - first).astype(U64) * U64(0xD6E8FEB86659FD93))


def chunks(column: pa.Array, limit: int = 1 << 20, rows: int = 4000,
           lower: bool = False) -> Iterator[Chunk]:
    """The column's texts in chunks of at most ``limit`` bytes (or one longer text) and
    ``rows`` rows. A null counts as the empty text. ``lower`` lower-cases A-Z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        part = data[offsets[at]:offsets[end]]
        yield Chunk(at, end, LOWER[part] if lower else part, offsets[at:end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """The words of a chunk in order: byte bounds and the row (within the chunk) of each."""
    first: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows).astype(np.int64)


def words(chunk: Chunk, table: np.ndarray) -> Words:
    """Maximal runs of the table's bytes; a run never spans two rows."""
    n = len(chunk.data)
    inside = table[chunk.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = chunk.bounds[1:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = chunk.bounds[1:-1] - 1
    last = last[(last >= 0) & (last < n)]
    ends[last] = inside[last]
    first = np.flatnonzero(begins)
    upto = np.searchsorted(first, chunk.bounds)
    return Words(first, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(chunk)), upto[1:] - upto[:-1]))


def word_hashes(chunk: Chunk, w: Words) -> np.ndarray:
    return chunk.span_hash(chunk.prefix_hash(), w.first, w.end)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal neighbours begins (first row included)."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the flat values and each row's number of them."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
