"""Hard negatives by Kronecker-packed integer products.

Components become integers (``floor(scale * x)``), so scores are exact integer inner products.
Several candidates are packed into one wide integer for each component: each candidate's
component is biased to be non-negative and shifted into a field of its own. One multiplication
of an anchor's component with the packed integer multiplies all of them, and the sum over the
components holds the candidates' sums in separate fields, as long as no field's sum can reach
its neighbour. The field width follows from the block at hand: the largest sum of an anchor's
absolute components times the largest biased component. As many fields as fit in 63 bits are
packed; where not even one fits, the same packing runs on Python's unbounded integers.

The anchors are a stated query set against all rows. Both are dealt into blocks by a hash of
the id; a task gets one block of each, so its memory is bounded whatever the label counts. A
first pass keeps each anchor's best positives, a second one, with the positives' scores, the
best negatives of each window. Every block returns ``keep`` rows at most for an anchor or a
positive, and the best of those are the result: a top-k that is the operator itself.

Rules: rows with a null id, label or vector, or with a null or non-finite component, take no
part. Of several usable rows under one id the least (label, vector) takes part, once. Vectors
meet only vectors of their length; empty vectors score 0. Ties go to the smaller id. An anchor
without positives, or a positive without negatives in its window, has no row. Components and
scores beyond a long count as the nearest long. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linking
from .cells import matrix

#: Bits of a packed integer: a signed long.
WIDTH = 63
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Packed:
    """Integer rows packed for exact products with integer rows up to those of ``anchors``."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        self.rows, self.dim = candidates.shape
        if not (self.rows and len(anchors) and self.dim):
            self.words = None
            return
        self.bias = -int(candidates.min())
        top = max(int(candidates.max()) + self.bias, abs(self.bias), 1)
        reach = max(sum(abs(x) for x in row) for row in anchors.tolist()) * top
        self.field = reach.bit_length() + 1
        self.kind = np.int64 if self.field <= WIDTH else object
        self.fields = max(WIDTH // self.field, 1)
        biased = np.zeros((-(-self.rows // self.fields) * self.fields, self.dim), self.kind)
        biased[:self.rows] = candidates.astype(self.kind) + self.bias
        biased = biased.reshape(-1, self.fields, self.dim)
        words = biased[:, 0]
        for i in range(1, self.fields):
            words = words + (biased[:, i] << (self.field * i))
        self.words = np.ascontiguousarray(words.T)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, rows) inner products, as the nearest longs."""
        if self.words is None:
            return np.zeros((len(anchors), self.rows), np.int64)
        a = anchors.astype(self.kind)
        products = np.zeros((len(a), self.words.shape[1]), self.kind)
        for j in range(self.dim):  # one multiplication of a component with each packed integer
            products += a[:, j, None] * self.words[j]
        shift = (a.sum(axis=1) * self.bias)[:, None]
        out = np.empty((len(a), self.words.shape[1], self.fields), self.kind)
        half, mask = 1 << (self.field - 1), (1 << self.field) - 1
        for i in range(self.fields):
            low = products if i == self.fields - 1 else ((products + half) & mask) - half
            out[:, :, i] = low - shift
            products = (products - low) >> self.field
        out = out.reshape(len(a), -1)[:, :self.rows]
        return out if self.kind is np.int64 else np.clip(out, _LOW, _HIGH).astype(np.int64)


def _block(rows: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(ids, labels, integer vectors, rows) of one side, by label and id."""
    dim = rows.column("dim")[0].as_py()
    rows = rows.filter(pa.array(np.asarray(rows.column("side")) == side)) \
        .sort_by([("label", "ascending"), ("id", "ascending")])
    vectors = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    return np.asarray(rows.column("id")), rows.column("label").to_numpy(zero_copy_only=False), vectors, rows


def _strips(anchors: np.ndarray, candidates: np.ndarray, limit: int = 1 << 20):
    """(number of the first, scores) of a few anchors at a time."""
    packed = Packed(candidates, anchors)
    step = max(1, limit // max(len(candidates), 1))
    for at in range(0, len(anchors), step):
        yield at, packed.scores(anchors[at:at + step])


def _first(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the ``keep`` highest scores, ties by smaller id."""
    some = np.arange(len(scores))
    if len(scores) > 4 * keep:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep])
    return some[np.lexsort((ids[some], ~scores[some]))][:keep]


def _positives(keep: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("score", pa.int64())])

    def task(rows: pa.Table) -> pa.Table:
        a_id, a_label, a, _ = _block(rows, 0)
        c_id, c_label, c, _ = _block(rows, 1)
        out = []
        for at, scores in _strips(a, c):
            for i, row in enumerate(scores, at):
                lo, hi = np.searchsorted(c_label, a_label[i]), np.searchsorted(c_label, a_label[i], "right")
                own = np.arange(lo, hi)
                own = own[c_id[lo:hi] != a_id[i]]
                out += [(a_id[i], c_id[j], row[j]) for j in own[_first(row[own], c_id[own], keep)]]
        return pa.table(list(np.array(out, np.int64).reshape(-1, 3).T), schema=schema)
    return task


def _negatives(keep: int, low: int, high: int, base: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("positive_score", pa.int64()),
                        ("negative", pa.int64()), ("score", pa.int64())])

    def task(rows: pa.Table) -> pa.Table:
        a_id, a_label, a, given = _block(rows, 0)
        c_id, c_label, c, _ = _block(rows, 1)
        positives, wanted = (given.column(x).to_pylist() for x in ("positives", "scores"))
        out = []
        for at, scores in _strips(a, c):
            for i, row in enumerate(scores, at):
                # base * s >= low * p and base * s <= high * p, in whole numbers within a long
                bounds = [(max(-((-low * p) // base), _LOW), min((high * p) // base, _HIGH)) for p in wanted[i]]
                some = np.flatnonzero((row >= min(x for x, _ in bounds)) & (row <= max(y for _, y in bounds)))
                some = some[c_label[some] != a_label[i]]
                some = some[np.lexsort((c_id[some], ~row[some]))]
                ranked = row[some]
                for (lo, hi), positive, p in zip(bounds, positives[i], wanted[i]):
                    best = some[(ranked >= lo) & (ranked <= hi)][:keep]
                    out += [(a_id[i], positive, p, c_id[j], row[j]) for j in best]
        return pa.table(list(np.array(out, np.int64).reshape(-1, 5).T), schema=schema)
    return task


def usable(embeddings: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, vec, dim): one row for each id, its components floored to longs."""
    vec = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))) \
        .groupBy("id").agg(F.min(F.struct("label", "vec")).alias("v")) \
        .select("id", "v.label", F.transform("v.vec", lambda x: F.floor(x * scale)).alias("vec"),
                F.size("v.vec").alias("dim"))


def _best(found: DataFrame, by: list[str], name: str, keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(name))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(embeddings: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label: Column | str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 5,
         window: tuple[int, int, int] = (80, 100, 100), anchor_rows: int = 1024, rows: int = 16384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says of an ``id`` whether it is an anchor. For ``window`` (low, high, base) a
    negative's score s and the positive's p satisfy low * p <= base * s <= high * p."""
    label = F.col(label) if isinstance(label, str) else label
    stored = linking.landed(usable(embeddings, id_col, vector_col, label, scale), "integers")
    asked = stored.where(anchors)
    count = lambda df, n: max(1, -(-df.count() // n))
    n_asked, n_rows = count(asked, anchor_rows), count(stored, rows)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = {"positives": F.lit(None).cast("array<long>"), "scores": F.lit(None).cast("array<long>")}
    all_rows = stored.withColumns(none | {"side": F.lit(1), "p": each(n_asked)}).withColumn("q", deal(n_rows))

    def cells(of: DataFrame):
        of = of.withColumns({"side": F.lit(0), "q": each(n_rows)}).withColumn("p", deal(n_asked))
        return of.unionByName(all_rows).groupBy("dim", "p", "q")

    found = cells(asked.withColumns(none)).applyInArrow(_positives(positives), "anchor long, positive long, score long")
    ranked = _best(found, ["anchor"], "positive", positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive", "score"))).alias("best"))
    with_positives = linking.landed(asked.join(ranked, asked["id"] == ranked["anchor"]).select(
        *stored.columns, F.col("best.positive").alias("positives"), F.col("best.score").alias("scores")), "positives")
    found = cells(with_positives).applyInArrow(
        _negatives(negatives, *window),
        "anchor long, positive long, positive_score long, negative long, score long")
    return _best(found, ["anchor", "positive", "positive_score"], "negative", negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
