"""n-gram join, line dedup and substring dedup against brute force."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from barwise.llm import line_dedup, linking, ngram_join, substring_dedup

from .brute import Forest, linked, ngrams, removed_lines, trimmed
from .corpus import SCHEMA, corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 60)])
def test_ngram_components(docs, rows, n, num):
    sets = {r[0]: ngrams(r[1], n) for r in rows if r[0] is not None}
    forest, ids = linked(sets, num), sorted(sets)
    got = ngram_join.ngram_components(docs, n=n, num=num).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), forest.root(r.doc_id)), r.doc_id
    assert sum(forest.root(a) != a for a in ids) > 8


def test_block_signatures_meet():
    """Any two sets at the threshold agree on a block, also where blocks are empty."""
    rng = np.random.default_rng(5)
    for size in [9, 10, 11, 14, 20, 33, 60, 150, 400]:
        for _ in range(60):
            a = rng.choice(2**52, size, replace=False).astype(np.uint64)
            apart = 2 * size * 10 // 190
            keep = size - rng.integers(0, apart + 1)
            b = np.concatenate([a[:keep], rng.choice(2**52, max(0, apart - (size - keep)), replace=False)
                                .astype(np.uint64)])
            common = len(np.intersect1d(a, b))
            if 100 * common < 90 * len(np.union1d(a, b)):
                continue
            found = []
            for s in (a, b):
                s = np.unique(s)
                found.append(ngram_join._signatures(np.zeros(len(s), np.int64), s, np.array([len(s)]),
                                                    ngram_join.Sizes(90, 100)))
            meets = [(len(set(x[1].tolist()) & set(y[1].tolist())), x[2][0], y[2][0])
                     for x in found[0] for y in found[1]]
            assert any(n >= max(p, q) > 0 and min(p, q) > 0 for n, p, q in meets) or len(a) == len(b) == common


def test_block_product_keeps_all_joining_links():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**52, 130)
    sets = []
    for _ in range(120):
        s = base.copy()
        k = rng.integers(0, 14)
        s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 2**52, k)
        sets.append(np.unique(s))
    n = len(sets)
    everyone = np.ones(n, bool)
    links = linking.block_links(np.arange(n), everyone, everyone, everyone, sets, 90, 100)
    got, want = Forest(), Forest()
    for a, b in links:
        got.link(a, b)
    for i in range(n):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
                want.link(i, j)
    assert [got.root(i) for i in range(n)] == [want.root(i) for i in range(n)]
    assert len(links) < n


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(80)] + [(5, 5), (7, 6), (6, 7)]
    got = {r.id: r.comp for r in linking.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(81)}


def test_line_dedup(docs, rows):
    gone = removed_lines(rows)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    text_of = {r[0]: r[1] for r in rows}
    differ = 0
    for r in got:
        assert set(r.asDict()) >= {"id", "key", "line", "n_chars"}
        if r.doc_id is None:
            assert r.removed_lines == []
            continue
        want = sorted(gone.get(r.doc_id, ()))
        differ += want != r.removed_lines
        if text_of[r.doc_id] is None:
            assert r.text is None and r.n_lines == 0
        else:
            left = [x for i, x in enumerate(text_of[r.doc_id].split("\n")) if i not in set(r.removed_lines)]
            assert r.text == "\n".join(left)
    assert len(gone) > 30
    assert differ <= 2  # banding finds a pair at the threshold with a probability of 0.99


def test_short_lines_by_exact_copies(spark):
    rng = random.Random(3)
    short = ["wh the.", "and ornd.", "é", "x", "-- 7", "Nineteen characters", "seven c"]
    data = [(i, "\n".join(rng.choice([x, f" {x.upper() if x.isascii() else x}\t", "", "  ", f"row {i} {rng.random()}"])
                          for x in rng.choices(short, k=12))) for i in range(40)]
    data += [(50, "seven d\nseven c"), (51, None), (52, ""), (None, "wh the.\nwh the."), data[3]]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for i, t in sorted({x for x in data if x[0] is not None}, key=lambda x: x[0]):
        lines = [trimmed(x) for x in (t or "").split("\n")]
        want[i] = [n for n, x in enumerate(lines) if x and (x in seen or x in lines[:n])]
        seen |= set(lines)
    for r in line_dedup.dedup_lines(docs).collect():
        assert r.removed_lines == want.get(r.doc_id, []), r.doc_id
    assert sum(map(len, want.values())) > 150 and want[50] == [1]


def test_line_dedup_of_a_long_text_and_clashing_columns(spark):
    texts = ["the same line over and over\n" * 60_000, "x\r\nthe same line over and over"]
    docs = spark.createDataFrame([(i, t, 9, "a", [1], 5, "b", 7) for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_lines int, removed_lines string, removed array<int>, "
                                 "hash int, first string, line int")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert got[0].text == "the same line over and over\n" and got[0].n_lines == 60_001
    assert got[1].text == "x\r" and got[1].removed_lines == [1] and got[1].n_lines == 2
    assert (got[1].removed, got[1].hash, got[1].first, got[1].line) == ([1], 5, "b", 7)


def near_copies(n, seed=8):
    """n sets of 60: a few clusters of near copies, members of which link by chains only."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(4):
        base = rng.integers(0, 2**52, 60)
        for _ in range(n // 4):
            s = base.copy()
            k = rng.integers(0, 7)
            s[rng.choice(60, k, replace=False)] = rng.integers(0, 2**52, k)
            out.append(np.unique(s))
    return out


@pytest.mark.parametrize("rows", [1024, 16])
def test_groups_are_linked_whole(spark, rows):
    """One key holds several clusters, so that stars and products are both needed."""
    sets = near_copies(160)
    forest = Forest()
    for i in range(len(sets)):
        forest.root(i)
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
                forest.link(i, j)
    df = spark.createDataFrame([(i, [int(x) for x in s], len(s)) for i, s in enumerate(sets)],
                               "id long, value array<long>, size int")
    keys = spark.createDataFrame([(k, i) for i in range(len(sets)) for k in (1, 2 + i % 3)], "key long, id long")
    grouped = linking.groups(keys).select("head", "id").distinct()
    assert sorted(grouped.collect()) == sorted(linking.shared_groups(keys.union(keys).repartition(3), "key", "id").collect())
    for stars in (1, 2, 4):
        got = linking.linked_components(spark, grouped, df, ngram_join.set_values, 90, 100, rows=rows,
                                        stars=stars)
        comp = {r.id: r.comp for r in got.collect()}
        assert {i: comp.get(i, i) for i in range(len(sets))} == {i: forest.root(i) for i in range(len(sets))}
    assert len({forest.root(i) for i in range(len(sets))}) > 6


def brute_spans(rows, length):
    seen, out = {}, {}
    for i, t in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        b = t.encode()
        mark = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s:s + length], (i, s)) != (i, s):
                mark[s:s + length] = True
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = int((mark[1:] & ~mark[:-1]).sum() + mark[0])
        out[i] = (len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("cover,length", [("synchronising", 100), ("difference", 100), ("synchronising", 60)])
def test_substring_dedup(docs, rows, cover, length):
    want = brute_spans(rows, length)
    got = substring_dedup.deduplicate(docs, length=length, cover=cover).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == r.n_spans == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert sum(w[1] > 0 for w in want.values()) > 30


def batches_of(rows, cuts, kinds):
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        columns = list(zip(*rows[a:b])) if a < b else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)],
                                         names=[str(i) for i in range(len(kinds))])


def test_firsts_and_repeats_across_batches():
    """However sorted rows are cut into batches, the first of each name is told from its repeats."""
    rng = random.Random(1)
    long, int_ = pa.int64(), pa.int32()
    for _ in range(300):
        n = rng.randint(1, 40)
        cuts = sorted(rng.sample(range(n + 1), min(n, rng.randint(0, 6))))
        rows = sorted((rng.randint(0, 5), rng.randint(0, 2), rng.randint(0, 4), rng.randint(0, 3)) for _ in range(n))
        more = [None if rng.random() < 0.8 else [{"lo": 1, "end": 9}] for _ in rows]
        first, names = {}, {}
        for key, name, *at in rows:
            if (key, name) not in first:
                first[key, name] = at
                names[key] = names.get(key, 0) + 1
        want = [(False, i, p, p, p + 101) for key, name, i, p in rows if [i, p] != first[key, name]]
        want += [(False, r[2], 1, 1, 9) for r, m in zip(rows, more) if m]
        want += [(True, i, p, p, p + 1) for (key, _), (i, p) in first.items() if names[key] > 1]
        data = [(*r, r[3], r[3] + 1, m) for r, m in zip(rows, more)]
        kinds = [long, long, long, int_, int_, int_, substring_dedup.SPAN_TYPE]
        got = [tuple(r.values()) for b in substring_dedup._judged(100)(batches_of(data, cuts, kinds)) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)
        rows = sorted((r[0], r[2], r[3], None) for r in rows)
        first = {}
        for key, *at, _ in rows:
            first.setdefault(key, at)
        want = [(i, p, p + 100) for key, i, p, _ in rows if [i, p] != first[key]]
        kinds = [long, long, int_, substring_dedup.SPAN_TYPE]
        got = [tuple(r.values()) for b in substring_dedup._later(100)(batches_of(rows, cuts, kinds)) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)


def test_differences_are_perfect():
    d = substring_dedup.DIFFERENCES
    found = sorted((a - b) % substring_dedup.MODULUS for a in d for b in d if a != b)
    assert found == list(range(1, substring_dedup.MODULUS))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.ngram_components(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert substring_dedup.deduplicate(empty).count() == 0
