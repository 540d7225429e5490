"""What the text operators hold, walk and shuffle at a time."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import zstandard

from barwise.llm import decontamination, line_dedup, linking, ngram_join, toxicity
from barwise.llm.textarrays import chunks

from .corpus import text


def test_texts_are_scored_in_small_parts():
    rng = random.Random(1)
    texts = [text(rng, 150) for _ in range(600)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(602)), pa.array(texts)], names=["id", "text"])
    model = np.zeros((toxicity.SYMBOLS,) * 3)
    parts = list(toxicity._scored(model, None)(iter([batch])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(602))
    assert max(sum(len(texts[i] or "") for i in p.column(0).to_pylist()) for p in parts) <= 1 << 17


def test_filter_keeps_rows_in_parts(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, 150) + (" zorkblat" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    toxic = {r.doc_id for r in toxicity.score_documents(docs, labels).where("score >= 0.7").collect()}
    assert toxic == {i for i, _ in rows if i % 5 == 0}
    assert sorted(map(tuple, toxicity.without_toxic(docs, labels).collect())) == [r for r in rows if r[0] % 5]


def test_band_keys_of_near_and_far_lines():
    rng = random.Random(3)
    texts = [text(rng, 90) + "\nÉté naïve 😀 漢字 et cetera\n" for _ in range(20)]
    c = next(chunks(pa.array(texts), lower=True))
    chars, (_, _, first, end, lo, counts), _ = line_dedup._eligible(c, 8)
    prefix = c.prefix_hash()
    assert (c.run_hash(prefix, chars, 8) == c.span_hash(prefix, chars[:-8], chars[8:])).all()
    whole = line_dedup.band_keys(c, prefix, chars, lo, counts, 8, 9, 4)
    for some in (np.array([0, len(lo) - 1]), np.arange(0, len(lo), 3), np.array([4])):
        assert (line_dedup.band_keys(c, prefix, chars, lo[some], counts[some], 8, 9, 4) == whole[some]).all()


class Uncounted(int):
    def bit_count(self):
        raise AssertionError("the region has too few of the item's words to be walked")


def test_scattered_words_are_not_walked():
    where = {x: Uncounted(1 << x) for x in range(10)}
    scattered = [x for i in range(10) for x in [i, *range(100, 120)]]
    assert list(decontamination._windows(scattered, where, 10, 6)) == []


def test_members_with_enough_keys(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(-40, 40), rng.randrange(60)) for _ in range(700)})
    needs = [(i, rng.randrange(1, 9), rng.randrange(1, 9)) for i in range(55)]  # five ids are unknown
    ids = {(k, i) for k, i in pairs if Counter(k for k, _ in pairs)[k] > 1}
    count = Counter((i, k & 1) for k, i in ids)
    least = {i: n for i, *n in needs}
    want = sorted((k, i) for k, i in ids if i in least and count[i, k & 1] >= least[i][k & 1])
    got = ngram_join._enough(spark.createDataFrame(sorted(ids), "key long, id long"),
                             spark.createDataFrame(needs, "id long, need0 long, need1 long"))
    assert sorted(map(tuple, got.collect())) == want
    # one shuffle of the rows and one of the needs
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_lines_are_cut_once(spark):
    body = "the same long line stands in all of these texts"
    rows = [(i, f"{body}\nline number {i} of its own kind {i * 7919}" if i else body, "en", "web", 0) for i in range(9)]
    rows += [(9, body, "en", "web", 0), (10, None, "en", "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("ArrowEvalPython") == 1
    want = {i: f"line number {i} of its own kind {i * 7919}" for i in range(1, 9)} | {0: body, 10: None}
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_distinct_lines_are_not_sorted(spark):
    rng = random.Random(6)
    ids = [-2 ** 63, -5, -1, 0, 3, 2 ** 63 - 1]
    rows = [(rng.choice(ids), rng.choice([0, 1, 2 ** 31 - 1]), h, h * 10 if h % 2 else None)
            for h in (rng.randrange(40) for _ in range(300))]
    signed = spark.createDataFrame(rows, "id long, line int, hash long, b0 long")
    distinct = line_dedup.distinct_lines(signed, ["b0"])
    assert "SortAggregate" not in distinct._jdf.queryExecution().executedPlan().toString()
    got = distinct.collect()
    assert {r.hash for r in got} == {h for _, _, h, _ in rows}
    for r in got:
        own = [(i, line) for i, line, h, _ in rows if h == r.hash]
        assert r.n == len(own) and (r.id, r.line) in own
        assert divmod(int(r.first), 1 << 31) == min(own)
        assert r.b0 == (r.hash * 10 if r.hash % 2 else None)


def test_band_keys_hold_few_shingles(monkeypatch):
    rng = random.Random(7)
    texts = ["\n".join([text(rng, 60), "é" * 9 + text(rng, 40), "x" * 9, text(rng, 9000)]) for _ in range(15)]
    c = next(chunks(pa.array(texts), lower=True))
    chars, (_, _, _, _, lo, counts), _ = line_dedup._eligible(c, 8)
    sizes, whole = [], line_dedup._least_hashes
    monkeypatch.setattr(line_dedup, "_least_hashes", lambda *a: sizes.append((a[4].sum(), len(a[4]))) or whole(*a))
    line_dedup.band_keys(c, c.prefix_hash(), chars, lo, counts, 8, 9, 4)
    assert sum(x for x, _ in sizes) == counts.sum() > 4 * line_dedup._BLOCK
    assert all(x <= line_dedup._BLOCK or n == 1 for x, n in sizes)


def test_only_wanted_lines_are_looked_at(monkeypatch):
    texts = ["one Line\n \x0b Second wanted LINE \x85\x1c\t\r\nthird", "\n\nÉté naïve ÀÉ 漢字 x\n", "only one line of text", ""]
    asked = [[1, 0, 1], [2, 0], [7], [0]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(4)), pa.array([zstandard.compress(t.encode()) for t in texts]), pa.array(asked, pa.list_(pa.int32()))],
        names=["id", "packed", "lines"])
    cut = next(chunks(pa.array(texts), lower=True))
    row, number, first, end = line_dedup.line_spans(cut)
    line = cut.span_hash(cut.prefix_hash(), first, end).view(np.int64)
    raw = cut.data.tobytes()
    want = {int(h): raw[a:b].decode() for r, n, a, b, h in zip(row, number, first, end, line)
            if n in asked[r] and len(raw[a:b].decode()) >= 8}
    monkeypatch.setattr(line_dedup, "line_spans", None)  # the other lines are not cut again
    got = [x for b in line_dedup._wanted_lines(8)(iter([batch])) for x in b.to_pylist()]
    assert {x["id"]: x["value"] for x in got} == want and len(want) == 3
    assert all(x["size"] == len(x["value"].encode()) for x in got)


def test_small_blocks_are_expanded_together():
    calls = []

    def expand(column):
        calls.append(len(column))
        return [np.array(x.as_py(), np.int64) for x in column]

    rows = [(key, 0, 0, 10 * key + i, 10 * key + i, True, 3, [7, 8, 9, 10 + key, 1000 + i // 2]) for key in range(300) for i in range(4)]
    names = ["key", "p", "q", "id", "comp", "out", "side", "value"]
    table = pa.table([pa.array(x) for x in zip(*rows)], names=names)
    got = [(r["a"], r["b"]) for b in linking._products(expand, 9, 10)(iter(table.to_batches(max_chunksize=7)))
           for r in b.to_pylist()]
    assert sorted(got) == [(10 * key + i, 10 * key + i + 1) for key in range(300) for i in (0, 2)]
    assert sum(calls) == 1200 and max(calls) <= linking._ROWS_AT_ONCE and len(calls) < 5


def test_row_sums():
    rng = np.random.default_rng(8)
    for kind in (np.float32, np.float64):
        table = rng.normal(size=(50, 7)).astype(kind)
        for counts in ([1], [3, 1, 2], [1] * 40, [400, 1, 90, 2], rng.integers(1, 9, 300), [5] * 20):
            at = rng.integers(0, 50, sum(counts))
            begin = np.cumsum(counts) - counts
            got = decontamination._row_sums(table, at, begin)
            assert got.dtype == kind
            assert np.allclose(got, np.add.reduceat(table[at].astype(float), begin, axis=0), rtol=0, atol=1e-4 if kind is np.float32 else 1e-11)
    assert decontamination._row_sums(table, at[:0], at[:0]).shape == (0, 7)


class Shared:
    def __init__(self, value):
        self.value = value


def test_texts_are_searched_in_small_parts(monkeypatch):
    rng = random.Random(9)
    items = [(i, text(rng, 30)) for i in range(5)]
    texts = [f"{text(rng, 200)} {items[i % 5][1] if i % 50 == 0 else ''} {text(rng, 200)}" for i in range(400)]
    bench = decontamination.Benchmark(items, 0.1, 8)
    sizes, whole = [], decontamination.Passages
    monkeypatch.setattr(decontamination, "Passages", lambda c, b: sizes.append(len(c.data)) or whole(c, b))
    space = np.linalg.qr(np.random.default_rng(1).normal(size=(len(bench.features), 16)))[0]
    found = decontamination._finder(Shared(bench), space, 0.5, 0.75, 0.55)()(pa.array(texts))
    assert {(row, item) for row, item, *_ in found} == {(i, i % 5) for i in range(0, 400, 50)}
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) <= 1 << 16
