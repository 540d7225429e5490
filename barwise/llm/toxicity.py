"""Toxicity by noisy-channel deobfuscation: Viterbi decoding, then a score of the restored text.

1. A character trigram model is counted over the whole table (28 symbols: a-z, any other
   letter, and everything else as a gap).
2. Spans that look disguised are decoded: words with look-alike digits or signs before, among
   or after their letters, words of two or more of these without a letter, letters parted by
   separators, letters repeated three times or more, and three or more single characters in a
   row. The
   span is a lattice (a sign can stand for a letter, be noise or a gap; a repeated letter or
   a separator can be dropped), and the Viterbi path under the character model and the
   channel's costs is the restored text.
3. The words of the plain and of the restored text are scored with a logistic model over
   words and word beginnings (inflected forms share one), learned from labelled rows.

Labels are read only of rows whose crc32 of the id as text modulo 3 is not 1, and of at most
``max_labels`` such rows (chosen by the id's hash): this bounds what the driver fits on.
Labels, language, source and id are never inputs of a score.

Rules: null and empty texts get the score of a text without flagged words. Rows with a null
id are scored too (held_out is null). Without usable labels the score is 0 for every row.
Other columns of the input pass through ``with_toxicity``. Texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking
from .fitting import held_out, logistic
from .textarrays import SPACED, Chunk, Words, byte_table, chunks, runs, words

#: Bytes of words made of letters; texts are lower-cased before.
LETTERS = byte_table((0x00, 0x60), (0x7B, 0x7F))
SYMBOLS = 28
#: What a sign or digit can stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a",
              "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
GAP_SIGNS = " .-_*~,'"
#: Costs (negative log-likelihoods) of the channel.
STANDS_FOR, NOISE, GAP, DROP_SEPARATOR, DROP_REPEAT = 0.7, 4.0, 2.0, 1.0, 0.3

_SIGN = np.zeros(256, bool)
_SIGN[[ord(x) for x in LOOKS_LIKE]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(x) for x in GAP_SIGNS if x != " "]] = True
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = 27


#: Bytes of text whose words are held and whose rows are returned at a time.
TEXT_BYTES = 1 << 17
#: Lengths in characters of the word beginnings that are tried besides whole words.
BEGINNINGS = range(4, 9)


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in batches:
        for c in chunks(batch.column(0), lower=True):
            x = _CLASS[c.data]
            total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS ** 3) \
                if len(x) > 2 else 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log p(c | a, b), counted over every text; the table has a fixed size (28**3)."""
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_trigrams, "gram long, n long") \
        .groupBy("gram").agg(F.sum("n").alias("n")).collect()
    count = np.full(SYMBOLS ** 3, 0.05)
    for r in rows:
        count[r.gram] += r.n
    count = count.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(count / count.sum(axis=2, keepdims=True))


def _symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch >= "\x80" and ch.isalpha() else 0


def restore(span: str, model: list) -> str:
    """The likeliest text behind a lower-cased span, gaps as single spaces. Where no letter
    shows what the signs are, look-alikes are read as letters or noise, not as gaps."""
    some = any(ch.isalpha() for ch in span)
    # state: the last two characters; kept with its cost and the text so far
    paths: dict = {(" ", " "): (0.0, None)}  # the text as (text before, character)
    before = ""
    for ch in span + " ":
        if ch.isalpha():
            options = [(ch, 0.0)] + ([("", DROP_REPEAT)] if ch == before else [])
        else:
            options = [(x, STANDS_FOR) for x in LOOKS_LIKE.get(ch, "")]
            options += [(" ", 0.0 if ch not in LOOKS_LIKE else GAP)] if some or ch not in LOOKS_LIKE else []
            options += [("", DROP_SEPARATOR if ch in GAP_SIGNS else NOISE)]
        before = ch
        steps = [(out, price, _symbol(out) if out else 0) for out, price in options]
        best: dict = {}
        for (a, b), (cost, text) in paths.items():
            row = model[_symbol(a)][_symbol(b)]
            for out, price, symbol in steps:
                if out == "" or (out == " " and b == " "):
                    state, now, new = (a, b), cost + price, text
                else:
                    state, new, now = (b, out), (text, out), cost + price - row[symbol]
                old = best.get(state)
                if old is None or now < old[0]:
                    best[state] = (now, new)
        paths = best
    text, out = min(paths.values(), key=lambda x: x[0])[1], []
    while text:
        text, ch = text
        out.append(ch)
    return "".join(reversed(out)).strip()


def suspicious(c: Chunk) -> list[tuple[int, str]]:
    """(row, span) of each span of a chunk that looks disguised."""
    w = words(c, SPACED)
    if not len(w.first):
        return []
    letter, d = LETTERS[c.data], c.data
    sign = _SIGN[d]
    of = np.searchsorted(w.first, np.arange(len(d)), "right") - 1  # the word at or before a byte
    inside = SPACED[d]
    first_letter, last_letter = np.full(len(w.first), len(d)), np.full(len(w.first), -1)
    at = np.flatnonzero(letter)
    last_letter[of[at]] = at
    first_letter[of[at[::-1]]] = at[::-1]
    has_letter = last_letter >= 0
    signs = np.bincount(of[sign & inside], minlength=len(w.first))
    hit = np.where(has_letter, signs > 0, signs > 1)
    mark = np.flatnonzero(_SEPARATOR[d] & inside)
    hit[of[mark[(mark > first_letter[of[mark]]) & (mark < last_letter[of[mark]])]]] = True
    if len(d) > 2:
        same = letter[2:] & (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & (d[2:] < 0x80)
        at = np.flatnonzero(same) + 2
        at = at[at - 2 >= w.first[of[at]]]
        hit[of[at]] = True
    spans = [(int(w.row[i]), int(w.first[i]), int(w.end[i])) for i in np.flatnonzero(hit)]
    single = (w.end - w.first == 1) & (letter | sign)[w.first]
    begin = runs(single, w.row)
    stop = np.append(begin[1:], len(single))
    for a, b in zip(begin, stop):
        if single[a] and b - a >= 3:
            spans.append((int(w.row[a]), int(w.first[a]), int(w.end[b - 1])))
    raw = d.tobytes()
    return [(row, raw[a:b].decode(errors="replace")) for row, a, b in spans]


class _Restorer:
    """Decodes spans, remembering the latest ones of a task."""

    def __init__(self, model: np.ndarray, keep: int = 50_000):
        self.model, self.keep, self.seen = model.tolist(), keep, {}

    def words(self, span: str) -> list[str]:
        if span not in self.seen:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            self.seen[span] = restore(span, self.model).split()
        return self.seen[span]


def _word_rows(model: np.ndarray):
    """(id, word, form): the features of the distinct plain and restored words (forms) of each text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _Restorer(model)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in chunks(batch.column(1), TEXT_BYTES, lower=True):
                w = words(c, LETTERS)
                raw = c.data.tobytes()
                pairs = {(r, raw[a:b].decode(errors="replace"))
                         for r, a, b in zip(w.row.tolist(), w.first.tolist(), w.end.tolist())}
                pairs |= {(r, x) for r, span in suspicious(c) for x in restorer.words(span)}
                rows = [(ids[c.start + r], f, x) for r, x in pairs for f in features(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                     pa.array([r[2] for r in rows], pa.string())], names=["id", "word", "form"])
    return task


def evidence(best: float, words: float) -> float:
    """A text's evidence: the sum of its flagged whole words' weights, and at least its
    strongest feature's."""
    return max(best, words)


class Model:
    """Flagged features with their weights, and the logistic curve over a text's evidence."""

    def __init__(self, weights: dict[str, float], slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def probability(self, total: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * total + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_labels: int = 5000, min_support: int = 4) -> Model | None:
    """The scoring model, from at most ``max_labels`` labelled rows that are not held out.

    A word is flagged if four fifths of the texts that hold it are toxic (a word beginning: 97
    of 100) and its support is significant among all that were tried: support * log(share / base rate) is at least
    log(tried) + 2. Support counts unlike texts only: texts are told apart by the least hash
    of their words under three hash functions, and the smallest of the three numbers of
    different values counts, so the words of a much copied toxic text aren't flagged."""
    sample = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")) \
        .where("id is not null and y is not null").where(~held_out("id")) \
        .orderBy(F.xxhash64("id"), "id", "y").limit(max_labels)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # copies of a text count once
    found = linking.landed(texts.where("text is not null").join(F.broadcast(sample), "id").groupBy("text")
                           .agg(F.min("id").alias("id"), F.max("y").alias("y")), "labelled")
    kept = [found]
    try:
        forms = linking.landed(found.select("id", "text").mapInArrow(
            _word_rows(model), "id long, word string, form string"), "forms")
        kept.append(forms)
        # a beginning must stand for several forms: else the whole word says all
        several = forms.where("word like '%*'").groupBy("word").agg(F.countDistinct("form").alias("forms")) \
            .where("forms >= 4").select("word")
        pairs = forms.select("id", "word").distinct()
        pairs = linking.landed(pairs.where("word not like '%*'").union(pairs.join(several, "word").select("id", "word"))
                               .join(found.select("id", "y"), "id"), "pairs")
        kept.append(pairs)
        y = {r.id: r.y for r in found.select("id", "y").collect()}
        n_toxic = sum(y.values())
        if not n_toxic or n_toxic == len(y):
            return None
        signs = {r.id: (r.a, r.b, r.c) for r in pairs.where("word not like '%*'").groupBy("id").agg(
            *(F.min(F.xxhash64("word", F.lit(k))).alias(x) for k, x in enumerate("abc"))).collect()}
        tried = dict.fromkeys((False, True), 1) | {
            r.star: r.n for r in pairs.groupBy(F.col("word").endswith("*").alias("star"))
            .agg(F.countDistinct("word").alias("n")).collect()}
        useful = pairs.groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("n")) \
            .where((F.col("t") >= min_support)
                   & (F.col("t") >= F.when(F.col("word").endswith("*"), 0.97).otherwise(0.8) * F.col("n")))
        holders: dict[str, list] = {}
        for r in pairs.join(useful, "word").select("word", "id").collect():
            holders.setdefault(r.word, []).append(r.id)
    finally:
        linking.release(*kept)
    base, weights = n_toxic / len(y), {}
    for word, ids in sorted(holders.items()):
        t = sum(y[i] for i in ids)
        support = min(len({signs[i][k] for i in ids if y[i]}) for k in range(3))
        if support >= min_support and support * math.log(t / len(ids) / base) >= math.log(tried[word.endswith("*")]) + 2:
            weights[word] = math.log((t + 0.5) / (n_toxic + 1)) \
                - math.log((len(ids) - t + 0.5) / (len(y) - n_toxic + 1))
    best, whole = dict.fromkeys(y, 0.0), dict.fromkeys(y, 0.0)
    for word, weight in weights.items():
        for i in holders[word]:
            best[i] = max(best[i], weight)
            whole[i] += 0.0 if word.endswith("*") else weight
    total = {i: evidence(best[i], whole[i]) for i in y}
    if not weights:
        return None
    ids = list(y)
    slope, offset = logistic(np.array([total[i] for i in ids]), np.array([y[i] for i in ids], float))
    return Model(weights, slope, offset)


def _scored(model: np.ndarray, scorer: Model | None):
    """(key, score, flagged, restored) for (key, text): flagged are the weighted words found,
    restored those of them that only decoding brought out."""
    weights = scorer.weights if scorer else {}
    by_length: dict[int, dict[str, float]] = {}  # 0: whole words
    for name, weight in weights.items():
        start = name.endswith("*")
        by_length.setdefault(len(name) - 1 if start else 0, {})[name.rstrip("*")] = weight

    def tables() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for k, entries in by_length.items():
            own = next(chunks(pa.array(list(entries))))
            h = own.span_hash(own.prefix_hash(), own.bounds[:-1], own.bounds[1:])
            order = np.argsort(h)
            out[k] = h[order], np.array(list(entries.values()))[order]
        return out

    def hits(c: Chunk, w: Words, lookup: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, weight, whole word?) of the flagged features of a chunk's words."""
        prefix = c.prefix_hash()
        chars = np.append(np.flatnonzero((c.data & 0xC0) != 0x80), len(c.data))
        first = np.searchsorted(chars, w.first)
        places, found, whole = [], [], []
        for k, (table, weight) in lookup.items():
            at = np.arange(len(w.first))
            end = w.end
            if k:
                at = at[first + k < len(chars)]
                at = at[chars[first[at] + k] <= w.end[at]]
                end = chars[first[at] + k]
            h = c.span_hash(prefix, w.first[at], end)
            slot = np.minimum(np.searchsorted(table, h), len(table) - 1)
            ok = table[slot] == h
            places.append(at[ok])
            found.append(weight[slot[ok]])
            whole.append(np.full(int(ok.sum()), k == 0))
        return tuple(np.concatenate(x) for x in (places, found, whole))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, lookup = _Restorer(model), tables()
        for batch in batches:
            for c in chunks(batch.column(batch.schema.get_field_index("text")), TEXT_BYTES, lower=True):
                flags: list[dict] = [{} for _ in range(len(c))]  # word -> (best weight, as a whole word)
                decoded: list[dict] = [{} for _ in range(len(c))]
                if lookup:
                    w = words(c, LETTERS)
                    raw = c.data.tobytes()
                    for i, weight, whole in zip(*(x.tolist() for x in hits(c, w, lookup))):
                        word = raw[w.first[i]:w.end[i]].decode(errors="replace")
                        old = flags[w.row[i]].get(word, (0.0, 0.0))
                        flags[w.row[i]][word] = max(old[0], weight), weight if whole else old[1]
                    for r, span in suspicious(c):
                        for word in restorer.words(span):
                            known = [weights[f] for f in features(word) if f in weights]
                            if known and word not in flags[r]:
                                decoded[r][word] = max(known), weights.get(word, 0.0)
                both = [f | g for f, g in zip(flags, decoded)]
                total = np.array([evidence(max((x for x, _ in f.values()), default=0.0), sum(x for _, x in f.values()))
                                  for f in both])
                score = scorer.probability(total) if scorer else np.zeros(len(c))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.start, len(c)), pa.array(score),
                     pa.array([sorted(f) for f in both], pa.list_(pa.string())),
                     pa.array([sorted(g) for g in decoded], pa.list_(pa.string()))],
                    names=["id", "score", "flagged", "restored"])
    return task


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", threshold: float = 0.7, **fit_options) -> DataFrame:
    """id_col, held_out, score, predicted, flagged, restored for each row."""
    model = character_model(docs, text_col)
    scorer = fit(docs, labels, model, id_col, text_col, label_col, **fit_options)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(_scored(model, scorer),
                              "id long, score double, flagged array<string>, restored array<string>")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "flagged", "restored")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", threshold: float = 0.7, **fit_options) -> DataFrame:
    """The rows whose score is below the threshold, unchanged."""
    model = character_model(docs, text_col)
    scorer = fit(docs, labels, model, id_col, text_col, label_col, **fit_options)
    if scorer is None:
        return docs
    score = _scored(model, scorer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0  # the batch that is scored, and how many of its rows are

        def texts() -> Iterator[pa.RecordBatch]:
            nonlocal now, at
            for now in batches:
                at = 0
                column = now.column(now.schema.get_field_index(text_col))
                yield pa.RecordBatch.from_arrays([column, column.cast(pa.string())], names=["id", "text"])

        for scored in score(texts()):  # as many rows as it holds at a time
            part = now.slice(at, scored.num_rows)
            at += scored.num_rows
            yield part.filter(pa.array(np.asarray(scored.column(1)) < threshold))
    return docs.mapInArrow(task, docs.schema)
