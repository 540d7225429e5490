"""License scan by an exact set-similarity join of text blocks with license templates.

A template is a short standard notice, a block for it any stretch of a text of 1.25 times its
words, wherever the lines break; both are sets of words (A-Z lower-cased; runs of digits,
letters and non-ASCII). A block matches a template if it contains a share of ``threshold`` or
more of the template's words. A stretch that begins with another word holds no more of the
template than the one from its first template word, so blocks begin at template words. Of a
template's matching blocks in a text the best is reported (the first of equal ones). The join:

* Order: template words are ranked by their number of occurrences in the whole table, the
  rarest first (ties by the word's hash).
* Prefix: of a template of t words that must share a = ceil(threshold * t), a matching block
  holds one of the t - a + 1 rarest. Only template words within a block's length of such a
  word are looked at.
* Length: a block of fewer than a words, at the end of a text, can't match.
* Position: a block in which fewer than a template words stand from its begin on can't match.
* The overlap of what is left is counted exactly.

Templates are few and short, so their words and ranks go to every task. Beside the join,
fixed phrases are looked up as consecutive words of the whole text. Rules: a null text
counts as empty and has no words; empty and very long texts are used whole. Each input row
has one output row, whatever its id; other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import ALNUM, Chunk, Words, chunks, word_hashes, words

#: Fixed phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices (public standard wording) and labels; a label can have several.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the Apache License Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License you may obtain a copy of the "
                 "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation "
              "either version 3 of the License or at your option any later version"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License version 3"),
    ("mpl-2", "this source code form is subject to the terms of the Mozilla Public License v 2.0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted "
              "provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
BLOCKS = "array<struct<word:bigint,label:string,containment:double>>"


def hashes(text: str) -> np.ndarray:
    c = next(chunks(pa.array([text]), lower=True))
    return word_hashes(c, words(c, ALNUM))


class Templates:
    """Template words with their ranks, and each template's words, prefix and block length."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.labels = [label for label, _ in templates]
        own = [hashes(text) for _, text in templates]
        self.sets = [np.unique(h) for h in own]
        self.width = [-(-5 * len(h) // 4) for h in own]
        self.need = [int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.vocabulary = np.unique(np.concatenate(self.sets))
        self.order([0] * len(self.vocabulary))

    def order(self, counts) -> None:
        """Rank the words by their counts, the rarest first."""
        by_rank = np.lexsort((self.vocabulary, np.asarray(counts)))
        self.rank = np.empty(len(by_rank), np.int64)
        self.rank[by_rank] = np.arange(len(by_rank))
        self.within = np.zeros((len(self.sets), len(by_rank)), bool)
        self.prefix = self.within.copy()
        for t, (words_, need) in enumerate(zip(self.sets, self.need)):
            ranks = np.sort(self.rank[np.searchsorted(self.vocabulary, words_)])
            self.within[t, ranks] = True
            self.prefix[t, ranks[:len(ranks) - need + 1]] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the hashes that are template words."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        place = np.flatnonzero(self.vocabulary[at] == h)
        return place, self.rank[at[place]]

    def matches(self, place: np.ndarray, rank: np.ndarray, row: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
        """(template, row, first word, containment) of the best block of each template in each
        row. ``place`` and ``rank`` are the template words of a chunk in order, ``row`` their rows
        and ``end`` where their rows end."""
        for t, (need, width) in enumerate(zip(self.need, self.width)):
            rare = place[self.prefix[t, rank]]
            if not len(rare):
                continue
            own = np.flatnonzero(self.within[t, rank])
            at, words_ = place[own], rank[own]
            stop = np.minimum(at + width, end[own])
            last = np.searchsorted(at, stop)
            reach = np.searchsorted(rare, stop) > np.searchsorted(rare, at)  # a prefix word in the block
            enough = reach & (last - np.arange(len(at)) >= need) & (stop - at >= need)
            best: dict[int, tuple] = {}
            for i in np.flatnonzero(enough).tolist():
                common = len(np.unique(words_[i:last[i]]))
                of = int(row[own[i]])
                if common >= need and (of not in best or common > best[of][0]):
                    best[of] = (common, int(at[i]))
            for of, (common, first) in best.items():
                yield t, of, first, common / len(self.sets[t])


def _count(templates: Templates):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.vocabulary), np.int64)
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                _, rank = templates.find(word_hashes(c, words(c, ALNUM)))
                total += np.bincount(rank, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["rank", "n"])
    return task


def phrase_places(c: Chunk, w: Words, h: np.ndarray, phrase: str) -> np.ndarray:
    """First words (in the chunk) of the places where the phrase's words stand in a row."""
    own = hashes(phrase)
    n = len(h) - len(own) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    ok = w.row[:n] == w.row[len(own) - 1:]
    for i, x in enumerate(own):
        ok &= h[i:n + i] == x
    at = np.flatnonzero(ok)
    raw, want = c.data.tobytes(), [x.encode() for x in phrase.split(" ")]
    same = [all(raw[w.first[a + i]:w.end[a + i]] == x for i, x in enumerate(want)) for a in at]
    return at[np.array(same, bool)] if len(at) else at


def _scan(templates: Templates, phrases: dict[str, str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                rows = len(c)
                w = words(c, ALNUM)
                h = word_hashes(c, w)
                counts = w.counts(rows)
                begin = np.cumsum(counts) - counts
                places: list[list[int]] = [[] for _ in range(rows)]
                base: list[set] = [set() for _ in range(rows)]
                for phrase, label in phrases.items():
                    for a in phrase_places(c, w, h, phrase).tolist():
                        row = int(w.row[a])
                        places[row].append(a - int(begin[row]))
                        base[row].add(label)
                blocks: list[list] = [[] for _ in range(rows)]
                at, rank = templates.find(h)
                for t, row, first, share in templates.matches(at, rank, w.row[at], (begin + counts)[w.row[at]]):
                    blocks[row].append({"word": first - int(begin[row]), "label": templates.labels[t], "containment": share})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.start, rows), pa.array(counts),
                     pa.array([len(p) for p in places], pa.int64()),
                     pa.array([min(p) if p else None for p in places], pa.int64()),
                     pa.array([max(p) if p else None for p in places], pa.int64()),
                     pa.array([sorted(x) for x in base], pa.list_(pa.string())),
                     pa.array(blocks, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()),
                                                          ("containment", pa.float64())])))],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])
    return task


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[tuple[str, str]] | None = None, threshold: float = 0.9,
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base (labels of the phrases) and blocks
    (first word, label and containment of each matching template's best block) for each row."""
    joined = Templates(TEMPLATES if templates is None else templates, threshold)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = np.zeros(len(joined.vocabulary), np.int64)
    for r in rows.select("text").mapInArrow(_count(joined), "rank long, n long") \
            .groupBy("rank").agg(F.sum("n").alias("n")).collect():
        counts[np.flatnonzero(joined.rank == r["rank"])] = r.n
    joined.order(counts)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan(joined, PHRASES if phrases is None else phrases),
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks {BLOCKS}") \
        .withColumnRenamed("id", id_col)


def labelled(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each of ``scan_licenses``' with labels as text and a score: the largest
    containment, 1 where a phrase was found, else 0."""
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("blocks", lambda b: b["label"]))))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return scanned.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"))
