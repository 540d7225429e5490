"""Decontamination, and the pipeline's stages on a small corpus."""

import hashlib
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from barwise.llm import decontamination
from barwise.llm.textarrays import chunks

from . import brute
from .corpus import corpus, edited, text


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(4)
    items = [(i, text(rng, rng.choice([14, 30, 45, 60]))) for i in range(25)]
    docs, want = [], set()
    for i in range(200):
        t = text(rng, rng.choice([40, 150, 400]))
        if i % 5 == 0:
            item, original = items[(i // 5) % 25]
            inside = original if i % 10 else edited(rng, original, max(1, len(original.split()) // 12))
            w = t.split(" ")
            at = rng.randrange(len(w))
            t = " ".join(w[:at] + [inside.upper() if i % 15 == 0 else inside] + w[at:])
            want.add((i, item))
        docs.append((i, t, "x"))
    return docs + [(500, None, "x"), (501, "", "x"), (None, items[0][1], "x"), docs[0]], items, want


def test_leaks_are_found_and_clean_texts_left(spark, leaked):
    docs, items, want = leaked
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*items, (None, "a b c d e f g h i"), (99, None), (98, "too short")],
                              "item_id long, text string")
    found = decontamination.leaks(d, b)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert found.count() == len(want)
    for block in (2000, 7):
        kept = decontamination.without_leaks(d, b, block=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) \
            == sorted((i is None, i or 0) for i, *_ in docs if i not in {x for x, _ in want})
    assert decontamination.leaks(d.limit(0), b).count() == 0
    assert decontamination.leaks(d, b.limit(0)).count() == 0


def test_clean_long_texts_and_short_items(spark):
    rng = random.Random(12)
    items = [(i, " ".join(rng.sample(words_of(i), 15)) + ".") for i in range(6)]
    long = [" ".join(x for _ in range(20_000 // 12) for x in [*rng.choices(words_of(99), k=7),
                                                              *rng.choices(words_of(i), k=5)]) for i in range(6)]
    hidden = long[1].split(" ")
    hidden[9000:9000] = items[1][1].split(" ")
    docs = [*enumerate(long), (10, " ".join(hidden)), (11, "so it is Too, SHORT here"), (12, "too long, short"),
            (13, "ends with too"), (14, "short begins"), (15, "too short"), (16, "x " * 5000 + "too short")]
    b = spark.createDataFrame([*items, (50, "Too short!"), (51, "too short"), (52, "?!"), (53, "")],
                              "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    want = {(10, 1)} | {(i, k) for i in (11, 15, 16) for k in (50, 51)}
    found = decontamination.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert {(r.doc_id, r.start_word) for r in found} == {(10, 9000), (11, 3), (15, 0), (16, 5000)}
    assert {r.doc_id for r in decontamination.without_leaks(d, b).collect()} == {i for i, _ in docs} - {10, 11, 15, 16}
    only_short = decontamination.leaks(d, b.where("item_id = 50")).collect()
    assert {(r.doc_id, r.item_id) for r in only_short} == {(11, 50), (15, 50), (16, 50)}


def words_of(i):
    return [f"{x}{i}" for x in "abcdefghijklmnopqrst"]


def test_windows_miss_nothing():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(4, 9)
        item, region = rng.choices(range(7), k=n), rng.choices(range(12), k=rng.randint(1, 60))
        where, width = decontamination.places_of(item), -(-3 * n // 2)
        best = max(decontamination.lcs_length(where, n, region[a:a + width]) for a in range(len(region)))
        least = rng.randint(1, n)
        got = [decontamination.lcs_length(where, n, region[a:z])
               for a, z in decontamination._windows(region, where, n, least)]
        assert best < least or max(got) == best


def test_lcs():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 60))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.lcs_length(decontamination.places_of(a.tolist()), len(a), b.tolist()) == t[-1, -1]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, t, lang, source, n) for i, t, lang, source, n, *_ in corpus(seed=6, n=80)]
    items = [(i, text(rng, 40)) for i in range(5)]
    rows += [(700 + i, f"{text(rng, 30)} {items[i][1]} {text(rng, 30)}", "en", "s", None) for i in range(5)]
    words = " ".join(text(rng, 150).split())  # copies that no line shows
    rows += [(900 + w, textwrap.fill(words, w), "en", "s", None) for w in (31, 44, 58, 73, 89)]
    toxic = [(800 + i, f"{text(rng, 30)} blorf {text(rng, 30)}", "en", "s", None) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + toxic, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, int(800 <= r[0] < 860)) for r in rows + toxic if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)).cache())
        if name != "bpe":
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[0] - ids[1] == {800 + i for i in range(60)}
    before = {r.doc_id: r.text for r in seen[1].collect()}
    after = {r.doc_id: r.text for r in seen[2].collect()}
    for i in ids[1] - ids[2]:
        assert before[i].strip()  # only a text that lost all its words goes
    for i, t in after.items():
        if i is not None and t is not None:
            assert all(x in before[i].split("\n") for x in t.split("\n"))
    wrapped = {931, 944, 958, 973, 989}
    assert 931 in ids[3] and len(wrapped & ids[3]) < len(wrapped & ids[2])
    assert ids[3] - ids[4] == {700 + i for i in range(5)}
    assert ids[5] == ids[4] and None in ids[5]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in final) == brute_pipeline(rows, items)


def brute_pipeline(rows, items):
    """run() by plain means, of rows less the toxic ones."""
    gone, left = brute.removed_lines(rows), []
    for i, t, *_ in rows:
        if i in gone:
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
            if not re.search(r"[^\x20\x09-\x0D]", t):
                continue
        left.append((i, t))
    forest = brute.linked({i: brute.ngrams(t, 5) for i, t in left if i is not None}, 80)
    left = [(i, t) for i, t in left if i is None or forest.root(i) == i]
    leaking = {i for i, _ in brute.leaks(left, items)}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    ids = lambda t: ",".join(map(str, library.encode(t or "", add_special_tokens=False).ids))
    return sorted((i is None, i or 0, hashlib.sha256(ids(t).encode()).hexdigest()) for i, t in left if i not in leaking)


def paraphrases(seed=8):
    """Items, and texts that hold them with words dropped, added and replaced."""
    rng = random.Random(seed)
    items = [(i, text(rng, rng.choice([16, 30, 45, 70]))) for i in range(30)]
    docs = []
    for i in range(150):
        w = items[i % 30][1].split(" ")
        kept = [x for x in w if rng.random() > rng.choice([0, 0.1, 0.2, 0.3, 0.4])]
        inside = [y for x in kept for y in ([x, *text(rng, 1).split()] if rng.random() < 0.15 else [x])]
        docs.append((i, " ".join([text(rng, rng.choice([10, 80])), *inside, text(rng, rng.choice([5, 120]))])))
    return docs, items


def test_search_against_exhaustive_verification(spark):
    """The candidate search loses no leak that holding every window against every item finds."""
    docs, items = paraphrases()
    want = brute.leaks(docs, items)
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert 60 < len(want) < 145 and got <= want
    assert len(got) >= 0.97 * len(want), sorted(want - got)


def test_every_leak_has_a_passage_of_enough_hits():
    """``least_hits`` is a lower bound: of any window that shares enough of an item, a passage
    of the text holds as many feature hits."""
    docs, items = paraphrases(seed=3)
    bench = decontamination.Benchmark(items, 0.1, 8)
    least = dict(zip(bench.items, bench.least_hits(0.55).tolist()))
    leaks = brute.leaks(docs, items)
    texts = dict(docs)
    for i, item in leaks:
        p = decontamination.Passages(next(chunks(pa.array([texts[i]]), lower=True)), bench)
        own = np.isin(bench.features[p.feature], bench.hashes[bench.items.index(item)])
        hits = np.bincount(p.block[own], minlength=p.total + 1)
        assert (hits[:-1] + hits[1:]).max() >= least[item]
    assert len(leaks) > 60 and max(least.values()) > 4


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_latent_space_is_fitted_on_every_text(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = [f"w{chr(97 + i)}" for i in range(18)]
    items = [(i, " ".join(vocabulary[i * 6:i * 6 + 6] + vocabulary[-3:])) for i in range(3)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[1 + (i * k) % 5 for k in range(1, 19)], k=rng.randrange(40))))
            for i in range(4500)] + [(4500, None), (4501, "")]
    fitted = []
    whole = decontamination.latent_space
    monkeypatch.setattr(decontamination, "latent_space",
                        lambda hits, bench, idf, rank: fitted.append((bench.value, idf, whole(hits, bench, idf, rank)))
                        or fitted[-1][2])
    decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                          spark.createDataFrame(items, "item_id long, text string"), rank=4)
    (bench, idf, space), = fitted
    at = {int(h): i for i, h in enumerate(bench.features)}
    rows, passages, df = [], 0, np.zeros(len(at))
    for _, text in docs:
        w = (text or "").split()
        for a in range(0, len(w), decontamination.STRIDE):
            passages += 1
            own = [at[int(h)] for h in decontamination._hashes(" ".join(w[a:a + decontamination.STRIDE])) if int(h) in at]
            df[sorted(set(own))] += 1
            rows += [own] if own else []
    assert np.allclose(idf, np.log((passages + 1) / (df + 1)) + 0.1)

    def gram(rows_, norm):
        m = np.zeros((len(at), len(at)))
        for own in rows_:
            x = np.zeros(len(at))
            np.add.at(x, own, idf[own])
            x /= norm(x, own)
            m += np.outer(x, x)
        return m / np.linalg.norm(m)

    mine = [[at[int(h)] for h in piece if int(h) in at] for piece in bench.pieces]
    m = gram(rows, lambda x, own: np.sqrt((idf[own] ** 2).sum())) + gram(mine, lambda x, own: np.linalg.norm(x))
    lead = np.linalg.eigh(m)[1][:, -4:]
    assert np.allclose(space @ space.T, lead @ lead.T, atol=1e-6)
