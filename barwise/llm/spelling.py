"""Spelling variants: words one edit apart, found over a reduced alphabet.

Every letter is hashed to one of a few symbols. Two words that differ by one inserted, deleted
or replaced code point have reduced forms that differ by one such edit too, or not at all (a
replacement within a symbol). So for each distinct reduced form its full one-edit
neighbourhood is generated, which is small as there are few symbols, and joined to the
distinct reduced forms; the words behind the two forms are then held against each other in
full. Each pair of forms is looked up once, from the smaller one.

The number of symbols follows the vocabulary: it is doubled until no reduced form stands for
more than ``crowd`` words, so the words behind a form stay few for any vocabulary. With as
many symbols as there are letters a form is the word itself.

Counting is one aggregation with map-side combine, so a word that holds a third of all
occurrences costs a row for each task. What follows works on distinct words.

Rules: a text's runs of letters ([A-Za-z] and U+00C0 to U+00FF) are its words, A-Z lower-cased.
A word counts if it has ``least_length`` code points and ``least_count`` occurrences over all
texts. A null or empty text has no words; a null id counts as the empty string where it is
hashed. Repeated rows count again. Other columns are ignored, whatever their names. An empty
table gives an empty result. Ties: the form is the near word of largest count, of those the
smallest in code-point order.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking

#: The letters of a run, lower-cased or not lower-cased as they may stand in a word.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the reduced alphabet, as many of them as are asked for.
SYMBOLS = "".join(map(chr, range(0x61, 0x61 + len(LETTERS))))


def with_slips(doc_id: Column, word: Column, every: int) -> Column:
    """The word less one code point where ``every`` divides the hash of document and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word).cast("long")).cast("int")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % every == 0, less).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
               least_count: int = 5, slip_every: int | None = None) -> DataFrame:
    """(word, n): the words that count. ``slip_every`` plants a slip of the pen in one of so many
    words of a document (for tables whose texts hold none)."""
    lower = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    # a slip takes one code point, so shorter runs can't count
    runs = runs.where(F.length("run") >= least_length)
    word = with_slips(F.col("id"), F.col("run"), slip_every) if slip_every else F.col("run")
    return runs.select(word.alias("word")).where(F.length("word") >= least_length) \
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def reduced(word: Column, symbols: int) -> Column:
    """The word with each letter as its symbol."""
    if symbols >= len(LETTERS):
        return word
    return F.translate(word, LETTERS, "".join(SYMBOLS[crc32(x.encode()) % symbols] for x in LETTERS))


def neighbours(form: Column, symbols: int) -> Column:
    """The form itself and every form that one edit makes of it, once each."""
    letters = F.array(*[F.lit(x) for x in (LETTERS if symbols >= len(LETTERS) else SYMBOLS[:symbols])])
    size = F.length(form)
    head = lambda i: F.substring(form, F.lit(1), i)  # noqa: E731  the first i code points
    tail = lambda i: F.substring(form, i + 1, size)  # noqa: E731  all but the first i
    cuts = F.sequence(F.lit(0), size - 1)
    deleted = F.transform(cuts, lambda i: F.concat(head(i), tail(i + 1)))
    replaced = F.flatten(F.transform(cuts, lambda i: F.transform(letters, lambda x: F.concat(head(i), x, tail(i + 1)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(0), size),
                                     lambda i: F.transform(letters, lambda x: F.concat(head(i), x, tail(i)))))
    return F.array_distinct(F.concat(F.array(form), deleted, replaced, inserted))


def near_words(words: DataFrame, crowd: int = 64, first_symbols: int = 4) -> DataFrame:
    """(a, an, b, bn): both directions of every pair of ``words`` (word, n) that are one edit
    apart, with their counts. ``words`` is stored."""
    symbols = first_symbols
    while symbols < len(LETTERS):
        most = words.groupBy(reduced(F.col("word"), symbols).alias("form")).count().agg(F.max("count")).first()[0]
        if most is None or most <= crowd:
            break
        symbols *= 2
    coded = linking.landed(words.select("word", "n", reduced(F.col("word"), symbols).alias("form")), "forms")
    forms = coded.select("form").distinct()
    reach = forms.select("form", F.explode(F.filter(neighbours(F.col("form"), symbols), lambda x: x >= F.col("form")))
                         .alias("other")).join(forms.select(F.col("form").alias("other")), "other")
    left = coded.select("form", F.col("word").alias("a"), F.col("n").alias("an"))
    right = coded.select(F.col("form").alias("other"), F.col("word").alias("b"), F.col("n").alias("bn"))
    pairs = reach.join(left, "form").join(right, "other") \
        .where((F.col("form") != F.col("other")) | (F.col("a") < F.col("b"))) \
        .where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn")
    pairs = linking.landed(pairs, "near-words")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"),
                                          F.col("an").alias("bn")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): where following forms ends. Counts
    grow along a chain, so it has an end; each round doubles the steps taken."""
    ends = linking.landed(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = linking.landed(ends.join(further, "root", "left")
                                 .select("word", F.coalesce("next", "root").alias("root"),
                                         F.col("next").isNotNull().alias("moved")), "roots")
        linking.release(ends)
        ends = stepped
        if ends.where("moved").isEmpty():
            return ends.select("word", "root")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n): the form is the
    near word of largest count if that is ``ratio`` times the word's own or more."""
    words = linking.landed(words, "words")
    near = near_words(words).groupBy(F.col("a").alias("word"), F.col("an").alias("n")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form"))).alias("best"))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form"))
    found = linking.landed(near.select("word", "n_near", form.alias("form"),
                                       F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(found.where("form is not null").select("word", "form"))
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
