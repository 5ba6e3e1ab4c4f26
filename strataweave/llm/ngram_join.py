"""Jaccard self-join on word n-grams with Bayesian candidate pruning.

1. Each text becomes the set of its word 5-grams and a MinHash signature. Texts
   of equal sets form a class; only one of a class goes on.
2. Signatures are cut into bands. Classes that share a band meet in a bucket.
   There MinHash values are compared a few at a time; a pair is dropped as soon
   as, after n values of which m agree, the posterior probability that its
   similarity reaches the threshold is below the tolerance (uniform prior). A
   bucket gives a spanning forest of what is left, never all its pairs.
3. The forests' components gather the candidates. Every pair within a component
   is verified exactly on the whole sets, in blocks of bounded size, as products
   of incidence matrices; a block gives each class's number of links and a
   spanning forest of the true links.
4. The components of the true links are the classes of near duplicates.

With 32 bands of 4 values a pair of similarity 0.8 misses every bucket with
probability 4.7e-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, partitions, written
from .components import components
from .exact_dedup import join_groups, member_filter, with_alarm

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
STEP = 32  # MinHash values compared at a time
_WORD = re.compile(r"\w+")
_rng = np.random.default_rng(20_240_229)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's word n-grams.

    Words are runs of letters, digits and underscores, in lower case. A text of
    fewer than n words has one n-gram, all its words; one without words none.
    """
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, _WORD.findall((text or "").lower())), np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    grams = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        grams = (grams ^ (grams >> np.uint64(29))) * _PLACE[k] + words[k : len(words) - n + 1 + k]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(grams ^ (grams >> np.uint64(32)))


def signature(grams: np.ndarray) -> np.ndarray:
    """The smallest value of each of 128 hash functions over the set."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        values = (_MULTIPLY[:, None] * part[None, :] + _ADD[:, None]) >> np.uint64(32)
        out = np.minimum(out, values.min(axis=1).astype(np.uint32))
    return out


def least_agreements(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """After n compared values, how many must agree for a pair to stay.

    With a uniform prior the posterior of the similarity is Beta(m+1, n-m+1), so
    the probability that it reaches t is that of at most m successes in n+1
    trials of probability t.
    """
    out = {}
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def bucket_forest(signatures: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """For each row of a bucket, the row that its group started from (itself: the first, or alone).

    Groups grow from a row to all rows that the pruning leaves linked to it; a
    row that has joined a group is not compared with the rest of it again.
    """
    group = np.full(len(signatures), -1)
    free = np.arange(len(signatures))
    while len(free):
        root, queue = free[0], [free[0]]
        group[root], free = root, free[1:]
        while queue and len(free):
            row, candidates, agreed, at = signatures[queue.pop()], free, np.zeros(len(free), np.int64), 0
            for n, m in least.items():
                agreed = agreed + (signatures[candidates, at:n] == row[at:n]).sum(axis=1)
                stay, at = agreed >= m, n
                candidates, agreed = candidates[stay], agreed[stay]
                if not len(candidates):
                    break
            if len(candidates):
                group[candidates] = root
                queue.extend(candidates.tolist())
                free = free[group[free] < 0]
    return group


def exact_links(sets: list[np.ndarray], split: int | None, threshold: float, width: int = 8192) -> np.ndarray:
    """Which of ``sets`` reach the threshold, as a boolean matrix of exact results.

    Without ``split`` all with all, otherwise the first ``split`` sets with the rest.
    """
    limit = Fraction(str(threshold))
    left, right = (range(len(sets)), range(len(sets))) if split is None else (range(split), range(split, len(sets)))
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        incidence = np.zeros((len(sets), int(min(width, shared.sum() - at))), np.float32)
        incidence[owner[a:b], column[a:b] - at] = 1
        common += np.rint(incidence[left.start : left.stop] @ incidence[right.start : right.stop].T).astype(np.int64)
    union = sizes[left.start : left.stop, None] + sizes[None, right.start : right.stop] - common
    return (common * limit.denominator >= union * limit.numerator) & (common > 0)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal values in the first ``keys`` columns of sorted rows."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 5_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _row(text: str) -> Column:
    """128 bits of doc_id and text, by which a row is found again, also without doc_id."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(F.xxhash64(doc_id, F.col(text)).alias("a"), F.xxhash64(F.col(text), doc_id, F.lit(1)).alias("b"))


def _located(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(text).alias("row"), F.col(text).alias("text"))


def _signed(docs: DataFrame, n: int, text: str) -> DataFrame:
    """``doc_id, row, key, size, signature``; key: a digest of the set, null without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("key", pa.binary()), ("size", pa.int64()), ("signature", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, (doc_id, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                grams = shingle_set(batch.column(2)[k].as_py(), n)
                if len(grams):
                    yield doc_id, row, xxhash.xxh3_128_digest(grams.tobytes()), len(grams), signature(grams).tobytes()
                else:
                    yield doc_id, row, None, 0, None

    work = lambda batches: _batches(rows(batches), schema)
    return _located(docs, text).transform(bounded).mapInArrow(work, "doc_id long, row struct<a:long,b:long>, key binary, size long, signature binary")


def _candidates(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges ``a, b`` of the buckets' forests."""
    spark = classes.sparkSession
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = classes.select("key", F.explode(band).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    met = banded.join(shared, "bucket").join(classes.select("key", "signature"), "key").select("bucket", "key", "signature")
    least = least_agreements(threshold, tolerance)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, members in _groups(batches, 1):
            keys = [m[0] for m in members]
            found = np.frombuffer(b"".join(m[1] for m in members), np.uint32).reshape(len(members), HASHES)
            root = bucket_forest(found, least)
            for i in np.flatnonzero(root != np.arange(len(root))).tolist():
                yield keys[root[i]], keys[i]

    work = lambda batches: _batches(rows(batches), schema)
    return met.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "key").transform(bounded).mapInArrow(work, "a binary, b binary").distinct()


def _verified(docs: DataFrame, members: DataFrame, n: int, text: str, threshold: float, block_sets: int, block_grams: int) -> DataFrame:
    """``a, b, links`` for each class and block: a link of the forest (a = b: none) and its number of links there."""
    spark = docs.sparkSession
    totals = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    blocks = totals.select("cluster", F.greatest(F.ceil(F.col("n") / block_sets), F.ceil(F.col("grams") / block_grams)).cast("int").alias("blocks"))
    placed = written(
        members.join(blocks, "cluster").select("key", "row", "cluster", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")),
        "join-members",
    )
    # only rows that can be members meet the shuffle; the filter's size is fixed
    known = member_filter(placed.select(F.col("row").alias("key")))
    texts = with_alarm(_located(docs, text), F.col("row"), known).where("alarm").groupBy("row").agg(F.first("text").alias("text"))
    met = (
        texts.join(placed, "row")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "text")
    )
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (_, i, j), found in _groups(_with_sets(batches, n), 3):
            sets = {m[1]: m for m in found if m[2] is not None}  # a text whose set isn't the key's has another's hash by chance
            found = sorted(sets.values(), key=lambda m: (m[0], m[1]))
            split = sum(m[0] == i for m in found) if i != j else None
            if not found or split in (0, len(found)):
                continue
            linked = exact_links([m[2] for m in found], split, threshold)
            yield from _block_rows([m[1] for m in found], linked, split)

    work = lambda batches: _batches(rows(batches), schema)
    return met.repartition(partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block").transform(bounded).mapInArrow(work, "a binary, b binary, links long")


def _with_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows ``cluster, i, j, block, key, text`` with the text turned into its set, where it is the key's."""

    class Rows:
        def __init__(self, columns: list):
            self.columns = columns

    class Values(list):
        def to_pylist(self):
            return self

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            keys, sets = part.column(4).to_pylist(), []
            for key, text in zip(keys, part.column(5).to_pylist()):
                grams = shingle_set(text, n)
                sets.append(grams if xxhash.xxh3_128_digest(grams.tobytes()) == key else None)
            yield Rows([*part.columns[:5], Values(sets)])


def _block_rows(keys: list[bytes], linked: np.ndarray, split: int | None) -> Iterator[tuple]:
    """Links of a block: each key's number, and a spanning forest."""
    n = len(keys)
    if split is None:
        whole = linked.copy()
        np.fill_diagonal(whole, False)
    else:
        whole = np.zeros((n, n), bool)
        whole[:split, split:] = linked
        whole |= whole.T
    links = whole.sum(axis=1)
    seen = np.zeros(n, bool)
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        yield keys[start], keys[start], int(links[start])
        while queue:
            at = queue.pop()
            for k in np.flatnonzero(whole[at] & ~seen).tolist():
                seen[k] = True
                queue.append(k)
                yield keys[k], keys[at], int(links[k])


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, text: str = "text", block_sets: int = 1024, block_grams: int = 1_000_000
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, same_set, links``.

    Two texts are linked if the Jaccard similarity of their word n-gram sets is
    at least ``threshold``. ``links`` counts the different sets linked to the
    row's (texts of the same set are one, so copies are not expanded);
    ``same_set`` counts the rows with its set. ``class_id`` is the smallest
    doc_id among all that chains of links join, ``class_size`` their rows. Texts
    without words (null, empty) have no links and stay alone, also from each
    other. Rows without doc_id count and are linked like any other, but do not
    name a class unless nothing else does. Repeated rows belong to the same
    class. Long texts are turned into their sets whole. Other columns are not
    read; an empty table gives no rows.
    """
    return _classes(docs, threshold, n, tolerance, text, block_sets, block_grams).drop("row", "keeper")


def _classes(docs: DataFrame, threshold: float, n: int, tolerance: float, text: str, block_sets: int, block_grams: int) -> DataFrame:
    """The rows of :func:`near_duplicates` with their hash and that of the row that stands for the class."""
    signed = written(_signed(docs, n, text), "join-signatures")
    some = signed.where("key IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    classes = some.groupBy("key").agg(first, F.min("row").alias("row"), F.count(F.lit(1)).alias("same_set"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    classes = written(classes, "join-classes")
    clusters = components(_candidates(classes, threshold, tolerance))
    members = classes.join(clusters.withColumnRenamed("node", "key").withColumnRenamed("component", "cluster"), "key").select("key", "row", "size", "cluster")
    checked = written(_verified(docs, members, n, text, threshold, block_sets, block_grams), "join-links")
    linked = components(checked.select("a", "b")).withColumnRenamed("node", "key").withColumnRenamed("component", "root")
    links = checked.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    named = classes.select("key", "first", "same_set").join(linked, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    roots = named.groupBy("root").agg(F.min("first").alias("first"), F.sum("same_set").alias("class_size"))
    roots = roots.select("root", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("keeper"))
    table = written(named.join(roots, "root").select("key", "class_id", "class_size", "same_set", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "keeper"), "join-table")
    found = join_groups(some.select("doc_id", "row", "key"), table, "key", "same_set", signed.count()).select("doc_id", "class_id", "class_size", "same_set", "links", "row", "keeper")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = signed.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), one.alias("class_size"), one.alias("same_set"), none.alias("links"), "row", F.col("row").alias("keeper"))
    return found.unionByName(alone)


def keep_one(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, text: str = "text", block_sets: int = 1024, block_grams: int = 1_000_000
) -> DataFrame:
    """One row of each class of ``docs`` with all columns: that of the smallest doc_id, a missing one last.

    Rows in classes of one are never dropped. Other rows of a dropped doc_id are
    not touched. Of rows repeated in doc_id and text one stays, if any does;
    texts without words are no class and all stay.
    """
    found = _classes(docs, threshold, n, tolerance, text, block_sets, block_grams)
    fate = found.groupBy("row").agg(F.max(F.col("row") != F.col("keeper")).alias("goes"), F.count(F.lit(1)).alias("times"), F.max("class_size").alias("class_size"))
    fate = written(fate.where("goes OR (times > 1 AND class_size > 1)").select("row", "goes"), "join-fates")
    name = free_name(docs, "row")
    told = free_name(docs, "goes")
    located = docs.withColumn(name, _row(text)).join(fate.toDF(name, told), name, "left").where(f"`{told}` IS NULL OR NOT `{told}`")
    once = located.where(f"`{told}` IS NOT NULL").dropDuplicates([name])
    return located.where(f"`{told}` IS NULL").unionByName(once).select(*docs.columns)
