"""Near-duplicate embeddings by randomised-rotation binary codes.

Every vector is scaled to length one and turned by seeded random rotations; the signs of the
turned components are its binary code. With each code its correction factor is stored: the
inner product f of the code (as a unit vector) with the vector itself. For a code s of x and
another vector y, <s, y> / f is an unbiased estimate of <x, y>, and its error has the standard
deviation sqrt((1 - f*f) / (f*f)) * sqrt(1 - c*c) / sqrt(d - 1) at a cosine of c; the estimates
of several rotations are averaged. A pair whose estimate lies ``CONFIDENCE`` deviations below
the threshold (taken at the threshold, where it is largest for any pair that links) is
rejected; every other pair is recomputed exactly, in double precision. No pair is accepted
on an estimate, so nothing below the threshold links.

Which pairs are looked at: the code is cut into tables of ``k`` bits; vectors of one label that
agree on all bits of a table meet there. ``k`` follows the number of rows of the largest label
(buckets of about ``bucket`` rows) and the number of tables follows from ``k``, so that a pair
just at the threshold is met with probability ``recall``; nearer pairs are met more surely. A
bucket of any size is cut into blocks that are multiplied with each other, in bounded memory,
one pair of blocks at a time. A pair that meets in several tables counts in the first of
them, which every row can tell from its own code, so no pair is written: a block product
returns link counts of its rows and, for each connected part of it, links to one row.

Exact copies (same label, same components) are one vector with a weight from the start, so a
group of copies costs one row. A group of near copies costs the products of its blocks, as
each of its links has to be counted, but its rows written grow with members times blocks.

Rules: rows with a null label, a null, empty or all-zero vector, or a null or non-finite
component link with nothing: 0 links, their own component, kept. A row with a null id takes no
part either (its component is null, it is kept). Vectors of different lengths never link.
Of several usable rows under one id the least (label, vector) counts, once; each of the rows
gets its result. Other columns are ignored, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .cells import cell_rows, matrix, sorted_cells

#: Standard deviations between an estimate and the threshold beyond which a pair is rejected.
CONFIDENCE = 5.0
SEED = 20250611
#: Rows of a block pair's product that are in memory at once.
STRIP = 256


def tables_for(rows: int, cosine: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits of a table, tables): buckets of about ``bucket`` rows, and as many tables as a pair
    at the threshold needs to agree on one of them with probability ``recall``."""
    bits = min(max(4, ceil(log2(max(rows, 1) / bucket))), 60)
    agree = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - agree)) if agree < 1 else 1


@lru_cache(maxsize=8)
def rotations(d: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices (count, d, d), the same in every task."""
    rng = np.random.default_rng((SEED, d))
    turned = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        turned.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.array(turned)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, factors) of unit vectors: (n, count * d) signs and (n, count) inner products of
    each rotation's code with the vector."""
    count, d, _ = turn.shape
    z = x @ turn.reshape(-1, d).T
    return z >= 0, np.abs(z).reshape(len(x), count, d).sum(axis=2) / sqrt(d)


def estimates(x: np.ndarray, bits: np.ndarray, factors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of the rows ``x`` with the coded rows."""
    count, d, _ = turn.shape
    total = np.zeros((len(x), len(bits)), np.float32)
    for c in range(count):
        signs = bits[:, c * d:(c + 1) * d].astype(np.float32) * 2 - 1
        z = (x @ turn[c].T).astype(np.float32)
        total += (z @ signs.T) / (sqrt(d) * factors[:, c]).astype(np.float32)
    return total / count


def margins(factors: np.ndarray, d: int, cosine: float) -> np.ndarray:
    """How far below the threshold an estimate may lie for a pair that links."""
    spread = np.sqrt(((1 - factors ** 2).clip(0) / factors ** 2).sum(axis=1)) / factors.shape[1]
    return CONFIDENCE * spread * sqrt(1 - cosine * cosine) / sqrt(max(d - 1, 1)) + 1e-5


def table_values(bits: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(n, tables): each table's ``k`` bits as a number."""
    out = np.zeros((len(bits), tables), np.int64)
    for t in range(tables):
        for b in range(t * k, (t + 1) * k):
            out[:, t] = (out[:, t] << 1) | bits[:, b]
    return out


def _encoder(k: int, tables: int):
    """Each vector with its code, factors and table values."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("dim"))
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    bits, factors = encode(unit(matrix(some.column("vec"))), rotations(d, ceil(k * tables / d)))
                    packed = np.packbits(bits, axis=1)
                    values = table_values(bits, k, tables)
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array([x.tobytes() for x in packed], pa.binary()),
                         pa.array(list(factors.astype(np.float32)), pa.list_(pa.float32())),
                         pa.array(list(values), pa.list_(pa.int64()))],
                        names=[*some.schema.names, "code", "factor", "tables"])
    return task


def _parts(linked: np.ndarray) -> np.ndarray:
    """For a symmetric link matrix, the first row of each row's connected part."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.concatenate([np.where(linked[at:at + STRIP], label[None, :], n).min(axis=1)
                                for at in range(0, n, STRIP)])
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _product(rows: pa.Table, t: int, p: int, q: int, k: int, cosine: float) -> pa.RecordBatch | None:
    """Link counts and part links of one pair of blocks of one bucket."""
    vectors = unit(matrix(rows.column("vec")))
    n, d = vectors.shape
    tables = matrix(rows.column("tables"), np.int64)
    turn = rotations(d, ceil(k * tables.shape[1] / d))
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(n, -1)
    bits = np.unpackbits(codes, axis=1, count=turn.shape[0] * d).astype(bool)
    factors = matrix(rows.column("factor"))
    block, weight = (np.asarray(rows.column(x)) for x in ("block", "w"))
    margin = margins(factors, d, cosine)
    right = np.flatnonzero(block == q)
    linked = np.zeros((n, n), bool)
    for at in range(0, n, STRIP):
        left = np.arange(at, min(at + STRIP, n))
        left = left[block[left] == p]
        if not len(left):
            continue
        near = estimates(vectors[left], bits[right], factors[right], turn) >= cosine - margin[right]
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        if p == q:
            i, j = i[i < j], j[i < j]
        first = np.ones(len(i), bool)
        for e in range(t):
            first &= tables[i, e] != tables[j, e]
        i, j = i[first], j[first]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
            hit = np.einsum("nd,nd->n", vectors[a], vectors[b]) >= cosine
            linked[a[hit], b[hit]] = True
    linked |= linked.T
    counts = np.concatenate([linked[at:at + STRIP] @ weight for at in range(0, n, STRIP)])
    some = np.flatnonzero(counts)
    if not len(some):
        return None
    part = _parts(linked)[some]
    rep = np.asarray(rows.column("rep"))
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[part]), pa.array(counts[some], pa.int64())],
                                      names=["a", "b", "n"])


def _products(k: int, cosine: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, t, _, p, q), rows in cell_rows(batches, ["space", "t", "value", "p", "q"]):
            found = _product(rows, t, p, q, k, cosine)
            if found is not None:
                yield found
    return task


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", cosine: float = 0.93, recall: float = 0.9999, bucket: int = 64,
                 rows: int = 2048) -> DataFrame:
    """id_col, n_links, component_id, kept for each row (see the module's rules). ``recall`` is
    that of a pair just at the threshold; ``rows`` bounds a block of a bucket."""
    kind = dict(embeddings.select(vector_col).dtypes)[vector_col]
    vec = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    given = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                              vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) \
        & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    own = given.where(F.coalesce(usable, F.lit(False))).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("v")) \
        .select("id", "v.label", "v.vec")
    own = linking.landed(own.withColumns({"k1": F.xxhash64("label", "vec"), "k2": F.xxhash64(F.lit(7), "vec", "label")}),
                         "vectors")
    classes = linking.landed(own.groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count("*").alias("w"), F.any_value("label").alias("label"),
        F.any_value("vec").alias("vec")).withColumn("dim", F.size("vec")), "classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    k, tables = tables_for(most, cosine, recall, bucket)
    coded = linking.landed(classes.mapInArrow(
        _encoder(k, tables), f"{_ddl(classes)}, code binary, factor array<float>, tables array<long>"), "codes")
    linking.release(classes)

    space = F.concat_ws(":", F.col("dim").cast("string"), "label").alias("space")
    met = coded.select("rep", space, F.posexplode("tables").alias("t", "value"))
    cells = sorted_cells(met, ["space", "t", "value"], ["rep"], rows, coded.drop("label", "dim", "k1", "k2"))
    found = linking.landed(cells.mapInArrow(_products(k, cosine), "a long, b long, n long"), "links")

    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = linking.components(embeddings.sparkSession, found.select("a", "b")).withColumnRenamed("id", "rep")
    of_class = coded.select("k1", "k2", "rep", "w").join(counts, "rep", "left").join(comp, "rep", "left") \
        .select("k1", "k2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                F.coalesce("comp", "rep").alias("comp"))
    of_id = own.select("id", "k1", "k2").join(of_class, ["k1", "k2"]).select("id", "n_links", "comp")
    component = F.coalesce("comp", "id")
    return given.select("id").join(of_id, "id", "left") \
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                component.alias("component_id"),
                F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)
