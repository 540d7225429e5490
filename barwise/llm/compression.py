"""Quality by compression: zstandard dictionaries of good and of bad text.

A dictionary is trained from labelled good texts and one from labelled bad texts. A text is
compressed with each; the difference of the two sizes, divided by their sum, says which
texts it is like, and a logistic curve fitted on other labelled texts calibrates it into the
probability of label 1.

Labels are read only of rows whose crc32 of the id as text modulo 3 is not 1, and of at most
``max_labels`` rows of each class in the order of the id's hash, whole texts of ``max_bytes``
together at most (the bounds of what the driver fits on; texts of over 1/128 of that aren't
chosen); half of them train the dictionaries and half the curve. Labels, language, source
and id are never inputs of a score. Rules: null and empty texts get the score of a zero
difference; rows with a null id are scored (held_out is null); with labels of one class or
none the score is the share of label 1 (0.5 without labels). Texts are compressed whole.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import linking
from .fitting import held_out, logistic


class Compressors:
    """Sizes under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.pair = []
        for raw in (good, bad):
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False))

    def difference(self, text) -> float:
        """Between -1 and 1; higher: more like the good texts."""
        if not len(text):
            return 0.0
        good, bad = (len(c.compress(text)) for c in self.pair)
        return (bad - good) / (bad + good)


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary, or the texts' ends as raw content where they are too few."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b" " * 8


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labels: int,
        max_bytes: int, dictionary_bytes: int, level: int) -> tuple[bytes, bytes, float, float] | float:
    """(good dictionary, bad dictionary, slope, offset), or the share of label 1 where there
    are not both classes."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")) \
        .where("id is not null and y in (0, 1)").where(~held_out("id"))
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_labels)
        some = part if some is None else some.union(part)
    found = linking.landed(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .where(F.octet_length("text") <= max_bytes // 128).join(F.broadcast(some), "id")
        .groupBy(F.sha2("text", 256).alias("copy")).agg(F.min("id").alias("id"), F.first("text").alias("text"),
                                                        F.max("y").alias("y")), "labelled")
    # whole texts in the order of the id's hash, as many as the bound allows
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "copy")
    chosen = found.select("copy", F.sum(F.octet_length("text").cast("long")).over(order).alias("upto")) \
        .where(F.col("upto") <= max_bytes // 2).select("copy")
    rows = found.join(chosen, "copy").select("text", "y", F.xxhash64("id").alias("h")).collect()
    linking.release(found)
    rows = sorted(((r.h, r.text.encode(), r.y) for r in rows), key=lambda r: r[0])
    parts = {y: [t for _, t, z in rows if z == y and t] for y in (0, 1)}
    if min(len(x) for x in parts.values()) < 4:
        return (len(parts[1]) / len(rows)) if rows else 0.5
    good, bad = (train_dictionary(parts[y][::2], dictionary_bytes) for y in (1, 0))
    sizes = Compressors(good, bad, level)
    x, y = zip(*((sizes.difference(t), v) for v in (0, 1) for t in parts[v][1::2]))
    x, y = np.array(x) * 10, np.array(y, float)
    slope, offset = logistic(x, y)
    return good, bad, slope * 10, offset


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", threshold: float = 0.5, max_labels: int = 3000,
                    max_bytes: int = 32 << 20, dictionary_bytes: int = 112_640, level: int = 3) -> DataFrame:
    """id_col, held_out, score, predicted, difference for each row."""
    model = fit(docs, labels, id_col, text_col, label_col, max_labels, max_bytes, dictionary_bytes, level)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = None if isinstance(model, float) else Compressors(model[0], model[1], level)
        for batch in batches:
            diff = [sizes.difference(x.as_buffer()) if sizes and x.is_valid else 0.0 for x in batch.column(1)]
            score = [model if sizes is None else
                     1 / (1 + math.exp(-max(-30.0, min(30.0, model[2] * d + model[3])))) for d in diff]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()),
                                              pa.array(diff, pa.float64())], names=["id", "score", "difference"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(task, "id long, score double, difference double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
