"""Links between rows that share a key: exact groups, verified links, distributed union-find.

Nothing here puts a group into one row, one task's memory or the driver, and no group is
expanded into all its pairs: a group's members are compared with the group's first member,
and only members that are still in different components are compared with each other.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path
from .textarrays import U64, mix, runs


#: A column of values to each row's sorted distinct 64-bit hashes.
Expand = Callable[[pa.Array], list[np.ndarray]]
#: Rows and bytes of values of small blocks that are expanded together.
_ROWS_AT_ONCE, _BYTES_AT_ONCE = 1024, 1 << 18
#: So few sets are compared without fingerprints.
_FEW_SETS = 8


def landed(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts the lineage for good."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    # Spark removes a finished query's shuffle files once the driver's JVM has collected the
    # plan; without a nudge they stay on the executors' disks until the job ends.
    del df
    gc.collect()
    spark._jvm.System.gc()
    stored = spark.read.schema(schema).parquet(path)
    stored.scratch = path
    return stored


def release(*frames: DataFrame) -> None:
    """Remove the folders of frames that ``landed`` returned and that nothing reads any more."""
    for df in frames:
        drop_path(df.sparkSession, df.scratch)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their first column, those whose neighbour has the same value, and
    those with a value in the column ``more``. What is held between batches is one row."""
    held = None  # the last row of the batch before, if it isn't out yet
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[0] = last is not None and key[0] == last
        keep = same.copy()
        keep[:-1] |= same[1:]
        if "more" in batch.schema.names:
            keep |= np.asarray(batch.column("more").is_valid())
        if same[0] and held is not None:
            yield held
        if keep.any():
            yield batch.filter(pa.array(keep))
        last = key[-1]
        held = None if keep[-1] else pa.RecordBatch.from_arrays(
            [x.slice(len(key) - 1).take(pa.array([0])) for x in batch.columns], schema=batch.schema)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a long, the first column) other rows have too: one shuffle on the
    key, then a streamed pass over each sorted partition. A key's rows are never held. Rows
    with a value in a column named ``more`` are kept in any case."""
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(_repeats, df.schema)


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) in order, one of each."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident = (np.asarray(x) for x in batch.columns)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
        new[0] = last != (key[0], ident[0])
        last = (key[-1], ident[-1])
        if new.any():
            yield batch.filter(pa.array(new))


def _shared_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _repeats(_distinct_pairs(batches))


def shared_keys(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Distinct (key, id) of the keys that two ids or more have: one shuffle on the key, then
    a streamed pass over each sorted partition. A key's rows are never held."""
    pairs = df.select(F.col(key).cast("long").alias("key"), F.col(ident).cast("long").alias("id")) \
        .where("key is not null and id is not null")
    return pairs.repartition("key").sortWithinPartitions("key", "id") \
        .mapInArrow(_shared_pairs, "key long, id long")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of distinct (key, id) in order, of keys with several ids: (head, id), head the first id."""
    last = head = None
    for batch in _shared_pairs(batches):
        key, ident = (np.asarray(x) for x in batch.columns)
        begin = runs(key)
        first = ident[begin]
        if key[0] == last:
            first[0] = head
        last, head = key[-1], first[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(first, np.diff(np.append(begin, len(key))))), batch.column(1)], names=["head", "id"])


def shared_groups(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Distinct (head, id): the ids that share a key with others, by the smallest id of the key;
    ids that share several keys meet once. One shuffle on the key and one of the pairs."""
    pairs = df.select(F.col(key).cast("long").alias("key"), F.col(ident).cast("long").alias("id")) \
        .where("key is not null and id is not null")
    return pairs.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_heads, "head long, id long").distinct()


def groups(members: DataFrame) -> DataFrame:
    """(key, id, head) of every key with two or more ids; head is the key's smallest id."""
    members = members.distinct()
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")) \
        .where("head <> tail").drop("tail")
    return members.join(heads, "key")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, comp): comp is the smallest id reachable over ``links`` (a, b).

    Alternating large-star and small-star steps until the edges no longer change; each
    step is an aggregate and a join, and its result lands in the shared folder. Ids
    without a link have no row."""
    edges = landed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "cc")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .union(low).distinct()
        edges, before = landed(small, "cc"), edges
        release(before)
        # done when every id points at one root and no root points on
        ends = edges.selectExpr("u as x", "1 as up", "0 as down").union(edges.selectExpr("v", "0", "1"))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
                .where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")) \
        .union(edges.select("v", "v")).distinct()


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0


def similarities(pairs: DataFrame, sets: DataFrame, expand: Expand, num: int, den: int, rows: int = 1024) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of num / den or more.

    The pairs of one ``a`` are dealt over tasks, ``rows`` of them each; every member's set is
    shipped once for a pair and the set of ``a`` once for each deal. ``pairs`` is stored."""
    dealt = landed(pairs.groupBy("a").agg(F.ceil(F.count("*") / rows).cast("int").alias("deals")), "deals")
    members = pairs.join(dealt, "a").select("a", F.pmod(F.xxhash64("b"), "deals").cast("int").alias("deal"), "b") \
        .join(sets.select(F.col("id").alias("b"), "value"), "b").select("a", "deal", "b", "value")
    heads = dealt.select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")) \
        .join(sets.select(F.col("id").alias("a"), "value"), "a") \
        .select("a", "deal", F.lit(None).cast("long").alias("b"), "value")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, deal = np.asarray(part.column("a")), np.asarray(part.column("deal"))
                is_head = np.asarray(part.column("b").is_null())
                grams = expand(part.column("value"))
                keep = np.zeros(len(a), bool)
                for i in range(len(a)):
                    if is_head[i]:
                        key, head = (a[i], deal[i]), np.array(grams[i])
                    elif (a[i], deal[i]) == key:  # a head without a set has no pairs
                        x, y = len(head), len(grams[i])
                        if max(x, y) * num <= min(x, y) * den:
                            keep[i] = overlap(head, grams[i]) * (den + num) >= (x + y) * num
                if keep.any():
                    yield part.select(["a", "b"]).filter(pa.array(keep))

    return members.unionByName(heads).repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first()) \
        .mapInArrow(task, "a long, b long")


def _fingerprints(grams: list[np.ndarray], bits: int) -> np.ndarray:
    """One byte for each of 2**bits blocks of a sorted set's hashes (52 bits or less)."""
    out = np.zeros((len(grams), 1 << bits), np.uint8)
    for i, g in enumerate(grams):
        if len(g):
            g = mix(g.view(U64))
            block = np.sort(((g >> U64(64 - bits)) << U64(8)) | (g & U64(0xFF)) | U64(1))
            at = (block >> U64(8)).astype(np.int64)
            begin = runs(at)
            out[i, at[begin]] = np.add.reduceat(block & U64(0xFF), begin).astype(np.uint8)
    return out


def block_links(comp: np.ndarray, out: np.ndarray, left: np.ndarray, right: np.ndarray, grams: list[np.ndarray],
                num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components among the rows of one block of the product.

    ``left`` and ``right`` mark the rows to be multiplied; at least one of a pair is ``out``.
    The sets are cut into many narrow blocks: sets that link differ in at most as many blocks
    as in elements. Pairs below that bound, of the wrong sizes or already in one component
    are discarded; the overlap of the others is counted in full."""
    size = np.array([len(g) for g in grams], np.int64)
    marks = None  # a few sets are compared at once
    if len(grams) > _FEW_SETS:
        # twice as many narrow blocks as linked sets can differ in
        most = 2 * int(size.max()) * (den - num) // (den + num)
        bits = int(np.clip(np.ceil(np.log2(2 * most + 2)), 5, 12))
        marks = _fingerprints(grams, bits)
    label = np.unique(comp, return_inverse=True)[1]
    cols = np.flatnonzero(right)
    links = []
    for i in np.flatnonzero(left):
        j = cols[(label[cols] != label[i]) & (out[i] | out[cols])]
        j = j[(np.maximum(size[i], size[j]) * num <= np.minimum(size[i], size[j]) * den)]
        if not len(j):
            continue
        if marks is not None:
            apart = ((size[i] + size[j]) * (den - num)) // (den + num)
            j = j[(marks[j] != marks[i]).sum(axis=1) <= apart]
        for k in j.tolist():
            if label[k] == label[i]:
                continue
            common = overlap(grams[i], grams[k])
            if common * (den + num) >= (size[i] + size[k]) * num:
                links.append((int(i), k))
                label[label == label[k]] = label[i]
    return links


def _products(expand: Expand, num: int, den: int):
    """(a, b) of rows sorted by block pair (key, p, q): key, p, q, id, comp, out, side, value."""
    def products(blocks: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(blocks)
        comp, out, side = (np.asarray(rows.column(x)) for x in ("comp", "out", "side"))
        ids = np.asarray(rows.column("id"))
        grams = expand(rows.column("value").combine_chunks())
        links, a = [], 0
        for block in blocks:
            z = a + len(block)
            links += [(a + i, a + j) for i, j in block_links(
                comp[a:z], out[a:z], (side[a:z] & 1) > 0, (side[a:z] & 2) > 0, grams[a:z], num, den)]
            a = z
        return pa.RecordBatch.from_arrays(
            [pa.array([int(ids[i]) for i, _ in links], pa.int64()), pa.array([int(ids[j]) for _, j in links], pa.int64())],
            names=["a", "b"])

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(x)) for x in ("key", "p", "q")]
            begin = runs(*keys)
            for a, b in zip(begin, np.append(begin[1:], batch.num_rows)):
                now = tuple(int(k[a]) for k in keys)
                if held and now != name:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                name = now
        if held:
            yield pa.Table.from_batches(held)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, rows, size = [], 0, 0  # small blocks, whose sets are expanded together
        for block in whole_blocks(batches):
            n = block.column("value").nbytes
            if few and (rows + len(block) > _ROWS_AT_ONCE or size + n > _BYTES_AT_ONCE):
                yield products(few)
                few, rows, size = [], 0, 0
            few.append(block)
            rows, size = rows + len(block), size + n
        if few:
            yield products(few)
    return task


def linked_components(spark: SparkSession, grouped: DataFrame, sets: DataFrame, expand: Expand, num: int,
                      den: int, rows: int = 1024, elements: int = 1 << 20, stars: int = 4) -> DataFrame:
    """(id, comp) under all links between ids that share a key: the Jaccard similarity of
    their sets is num / den or more. ``sets`` (id, value, size) has a compact value for each id,
    which tasks ``expand`` to the sorted distinct hashes (64-bit), and about how many they are.

    ``grouped`` has distinct (head, id), the head among the ids; it and ``sets`` are stored. Keys
    with one head are one group: ids that share a key share its head. In each round every group's head
    is compared with the members that aren't in its component; in groups whose members are
    then still in several components, the first member outside the components of all heads so
    far is the next head. A few rounds (``stars``), while groups are of more than a few blocks,
    join what is one cluster or some. After
    that, members outside the first head's component are multiplied with all members, in
    blocks of about ``rows`` rows or ``elements`` set elements, so that a task holds two blocks
    at most; heads so far have met everyone and stay out. A block's product returns only links
    that join components. So no link between components is lost, and what is written grows
    with the members, not the pairs."""
    own = grouped.select(F.col("head").alias("key"), "id", F.col("id").alias("comp"), (F.col("id") == F.col("head")).alias("met"))
    stored = None  # the form of ``own`` that a round has stored
    heads = own.where("met").select("key", F.col("key").alias("head"), F.col("key").alias("head_comp"))
    links, comp = None, None
    for turn in range(stars):
        pairs = own.join(heads, "key").where("comp <> head_comp").select(F.col("head").alias("a"), F.col("id").alias("b"))
        pairs = landed(pairs, "star")
        near = landed(similarities(pairs, sets, expand, num, den), "near")
        release(pairs)
        links = near if links is None else links.union(near)
        comp, before = landed(components(spark, links), "comp"), comp
        fresh = own.select("key", "id", "met").join(comp, "id", "left") \
            .select("key", "id", F.coalesce("comp", "id").alias("comp"), "met")
        # a member whose component holds a head of the group waits for the products
        split = fresh.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        fresh = landed(fresh.join(split, "key", "left_semi"), "groups-by-head")
        release(*[x for x in (stored, before) if x is not None])
        stored = fresh
        # groups of a few blocks are multiplied at once
        largest = fresh.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if turn == stars - 1 or largest <= 4 * rows:
            own = fresh
            break
        reached = fresh.where("met").select("key", "comp").distinct()
        heads = fresh.join(reached, ["key", "comp"], "left_anti").groupBy("key") \
            .agg(F.min(F.struct("id", "comp")).alias("h")).select("key", F.col("h.id").alias("head"), F.col("h.comp").alias("head_comp"))
        heads = landed(heads, "heads")
        if heads.isEmpty():
            own = fresh
            break
        own = landed(fresh.join(heads.select("key", F.col("head").alias("id"), F.lit(True).alias("now")), ["key", "id"], "left")
                     .select("key", "id", "comp", (F.col("met") | F.col("now").isNotNull()).alias("met")), "groups-by-head")
        release(fresh)
        stored = own
    first = own.where(F.col("id") == F.col("key")).select("key", F.col("comp").alias("head_comp"))
    rest = own.join(first, "key").where(~F.col("met")).withColumn("out", F.col("comp") != F.col("head_comp"))
    rest = landed(rest.join(sets.select("id", F.col("size").alias("n")), "id").select("key", "id", "comp", "out", "n"), "rest")
    blocks = lambda n, m: F.ceil(F.greatest(n / rows, m / elements, F.lit(1))).cast("int")
    plan = landed(rest.groupBy("key").agg(
        blocks(F.sum(F.col("out").cast("long")), F.sum(F.when(F.col("out"), F.col("n")))).alias("np"),
        blocks(F.count("*"), F.sum("n")).alias("nq"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo <> hi").drop("lo", "hi"), "plan")
    placed = rest.join(plan, "key").withColumn("h", F.xxhash64("id"))
    p, q = F.pmod("h", "np").cast("int"), F.pmod("h", "nq").cast("int")
    as_left = placed.where("out").select("key", "id", "comp", "out", p.alias("p"), F.lit(1).alias("side"),
                                         F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"))
    as_right = placed.select("key", "id", "comp", "out", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("p"),
                             F.lit(2).alias("side"), q.alias("q"))
    cells = as_left.unionByName(as_right).groupBy("key", "p", "q", "id", "comp", "out") \
        .agg(F.sum("side").cast("int").alias("side")).join(sets, "id")
    more = cells.select("key", "p", "q", "id", "comp", "out", "side", "value") \
        .repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id") \
        .mapInArrow(_products(expand, num, den), "a long, b long")
    more = landed(more.distinct(), "more")
    release(rest, plan)
    if more.isEmpty():
        return comp
    return components(spark, links.union(more))
