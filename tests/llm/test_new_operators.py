"""Rotation codes, packed hard negatives and spelling variants against brute force."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import hard_negatives, near_vectors, spelling

from .corpus import corpus

VECTORS = "vec_id long, embedding array<float>, label int, id long, n long, vec string, `w` int, side int, rep long"


def vector_rows(seed=5, d=24, n=160):
    """Plain vectors, exact and near copies (a group of a third of all), ties, odd rows."""
    rng = np.random.default_rng(seed)
    out = [(rng.standard_normal(d) * rng.choice([0.2, 1, 7]), int(rng.integers(0, 3))) for _ in range(n)]
    base = rng.standard_normal(d)
    out += [(base + rng.standard_normal(d) * 0.18, 1) for _ in range(90)]          # about the threshold
    out += [(base * f, 1) for f in (1, 1, 1, 2, 0.5)] + [(out[3][0], out[3][1])] * 6
    out += [(base, 2), (np.zeros(d), 1), (base[:5], 1), (base[:5] * 3, 1), (base, None)]
    rows = [(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(out)]
    n = len(rows)
    bad = [float("nan"), float("inf"), float("-inf"), None]
    rows += [(n + i, [x] + [1.0] * (d - 1), 1) for i, x in enumerate(bad)]
    rows += [(n + 10, None, 1), (n + 11, [], 1), (n + 12, [], 2), (None, rows[0][1], 0), (None, None, None)]
    rows += [rows[0], rows[4], (5, rows[6][1], rows[6][2])]                          # repeats, one id with two vectors
    random.Random(seed).shuffle(rows)
    return [(*r, 7, 7, "clash", 7, 7, 7) for r in rows]


def usable(rows, zero):
    """id -> (label, float32 components as doubles): the least of an id's usable rows."""
    out = {}
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if zero or any(v):
            out.setdefault(i, []).append((str(lab), v))
    return {i: min(x) for i, x in out.items()}


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors(spark, block):
    rows = vector_rows()
    own = usable(rows, zero=False)
    up = {i: i for i in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a in own:
        for b in own:
            (la, x), (lb, y) = own[a], own[b]
            if a < b and la == lb and len(x) == len(y):
                if np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.update((a, b))
                    up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = near_vectors.near_vectors(df, recall=1 - 1e-9, bucket=4, rows=block).collect()
    assert len(got) == len(rows) and sum(links.values()) > 2000
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            want = root(r.vec_id) if r.vec_id in up else r.vec_id
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], want, want == r.vec_id), r


def test_near_vectors_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert near_vectors.near_vectors(df).collect() == []


def test_recall_of_tables_at_threshold():
    """Pairs exactly at the threshold meet in a table and pass the bound: 0.9 or more of them."""
    rng = np.random.default_rng(1)
    d, n, cosine = 64, 4000, 0.93
    x = near_vectors.unit(rng.standard_normal((n, d)))
    z = rng.standard_normal((n, d))
    z = near_vectors.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    k, tables = near_vectors.tables_for(5000, cosine, 0.9999, 64)
    turn = near_vectors.rotations(d, -(-k * tables // d))
    (bx, _), (by, fy) = near_vectors.encode(x, turn), near_vectors.encode(y, turn)
    met = (near_vectors.table_values(bx, k, tables) == near_vectors.table_values(by, k, tables)).any(axis=1)
    margin = near_vectors.margins(fy, d, cosine)
    held = np.array([near_vectors.estimates(x[i:i + 1], by[i:i + 1], fy[i:i + 1], turn)[0, 0] for i in range(n)])
    assert abs((held - cosine).mean()) < 0.005            # unbiased
    assert (met & (held >= cosine - margin)).mean() > 0.999
    far = near_vectors.estimates(x[:500], by[500:1000], fy[500:1000], turn)
    assert (far >= cosine - margin[500:1000]).mean() < 0.001   # other pairs aren't recomputed


@pytest.mark.parametrize("spread", [3, 300, 2**20, 2**40, 2**62])
def test_packed_products(spread):
    rng = np.random.default_rng(2)
    for low in (-spread, spread // 2):
        a = rng.integers(-spread, spread, (7, 11))
        c = rng.integers(low, spread, (23, 11))
        packed = hard_negatives.Packed(c, a)
        exact = [[min(max(sum(int(x) * int(y) for x, y in zip(r, s)), -2**63), 2**63 - 1) for s in c] for r in a]
        assert packed.scores(a).tolist() == exact
    assert hard_negatives.Packed(rng.integers(-40, 40, (9, 8)), rng.integers(-40, 40, (3, 8))).fields > 1


def brute_negatives(rows, anchors):
    own = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in usable(rows, zero=True).items()}
    out = set()
    for a, (lab, x) in own.items():
        if not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in own.items()
                        if i != a and len(y) == len(x))
        for ps, p, _ in [s for s in scored if s[2] == lab][:5]:
            window = [s for s in scored if s[2] != lab and -80 * ps <= -100 * s[0] <= -100 * ps]
            out |= {(a, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(window[:5], 1)}
    return out


@pytest.mark.parametrize("blocks", [(1024, 16384), (3, 20)])
def test_hard_negatives(spark, blocks):
    rows = [(i, v, lab if i is None or lab is None else (lab if i % 2 else lab % 2), *x)
            for i, v, lab, *x in vector_rows(seed=9)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.mine(df, F.col("id") % 6 == 0, anchor_rows=blocks[0], rows=blocks[1]).collect()
    want = brute_negatives(rows, lambda i: i % 6 == 0)
    assert len(want) > 100 and len(got) == len(want) and {tuple(r) for r in got} == want
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("id") % 6 == 0).collect() == []


def brute_vocabulary(rows, every):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("crowd", [64, 1])
def test_spelling_variants(spark, crowd, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinrstÀéß÷") for _ in range(rng.randint(5, 9)))
    text = []
    for _ in range(60):
        w = word()
        for _ in range(rng.choice([2, 5, 40])):
            text.append(w)
        for _ in range(4):                                    # chains: variants of variants, each rarer
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("aeé") + w[i:], w[:i] + rng.choice("osß") + w[i + 1:]])
            text += [w] * rng.choice([1, 5, 8, 30])
    text += ["popular"] * 3000 + ["populer"] * 600 + ["populer"] * 120 + ["Populr"] * 24 + ["POPULÉR"] * 6
    text += ["xpopular"] * 500 + ["xxpopular"] * 80 + ["xxpopulars"] * 9          # a chain of forms
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::40]), None, None, None, 7, "clash", None) for i in range(40)]
    rows += [r for r in corpus(n=30)] + [(None, "popular populer", None, None, None, None, None, None)] * 6
    rows += [(99, "abcdefgh" * 30000 + " popular", None, None, None, None, None, None)]
    schema = "doc_id long, text string, word string, n string, form long, id long, root string, line int"
    docs = spark.createDataFrame([(*r[:2], None, None, None, *r[5:]) for r in rows], schema).repartition(4)
    for every in (None, 199):
        words = brute_vocabulary(rows, every)
        got = spelling.vocabulary(docs, slip_every=every)
        assert {r.word: r.n for r in got.collect()} == words
        monkeypatch.setattr(spelling.near_words, "__defaults__", (crowd, 4))
        found = [tuple(r) for r in spelling.variants(got).collect()]
        want = brute_variants(words)
        assert len(found) == len(want) and set(found) == want
        assert any(f and r != f for _, f, r, *_ in want)
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).collect() == []


def test_neighbourhood_is_full(spark):
    form, symbols = "abca", spelling.SYMBOLS[:3]
    want = {form} | {form[:i] + form[i + 1:] for i in range(4)}
    want |= {form[:i] + x + form[i + 1:] for i in range(4) for x in symbols}
    want |= {form[:i] + x + form[i:] for i in range(5) for x in symbols}
    got = spark.range(1).select(spelling.neighbours(F.lit(form), 3).alias("x")).first().x
    assert len(got) == len(want) and set(got) == want
