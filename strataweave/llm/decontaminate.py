"""Benchmark decontamination by q-gram filtering and banded alignment.

A benchmark item of m characters that occurs in a text with at most e edits
shares at least m + 1 - q (e + 1) of its q-grams with it, all on e + 1
neighbouring diagonals (place in the text less place in the item). Every task
holds an index of the items' q-grams. It finds the q-grams of its texts in it,
counts them in bands of diagonals that overlap by e, and keeps the bands that
reach the bound. What is left is aligned with the item in a band. For an item too
short for the usual q the grams are shorter, so that the bound is at least 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, slices, written

_BASE = 0x9E3779B97F4A7C15
_BITS = 22
_SLICE = 500_000
#: Hits of grams that are held at a time.
_HITS = 2_000_000
LEAK = "struct<item_id: bigint, start: bigint, end: bigint, distance: bigint>"


def plain(text: str | None) -> str:
    """Lower case, each run of white space as one space."""
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
    return up, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)


def qgram_hashes(points: np.ndarray, q: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
    hashes = (sums[q:] - sums[:n]) * down[:n]
    hashes ^= hashes >> np.uint64(31)
    return hashes * np.uint64(0xD6E8FEB86659FD93)


def edit_budget(m: int, error: float) -> int:
    """Edits allowed in an item of m characters: ``error`` of them."""
    return int(m * error)


def gram_size(m: int, q: int, error: float) -> int:
    """q, or as much less as makes the bound of an item of m characters 1."""
    return min(q, m // (edit_budget(m, error) + 1))


def aligned(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """Where ``item`` occurs in ``text`` with at most ``most`` edits: ``start, end, distance``.

    Only alignments that start on the diagonals ``first`` to ``last`` and leave
    them by ``most`` at most are looked at. Of the best, the first end.
    """
    low, width = first - most, last - first + 2 * most + 1
    far = len(item) + width + 1
    diagonals = np.arange(low, low + width)
    row = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    begin = diagonals.copy()
    steps = np.arange(width)
    for i, c in enumerate(item):
        at = i + diagonals  # the character read in the text
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == c
        new, start = row + ~same, begin.copy()
        new[~inside] = far
        skip = np.append(row[1:], far) + 1  # a character of the item is missing in the text
        better = skip < new
        new[better], start[better] = skip[better], np.append(begin[1:], 0)[better]
        end = at + 1
        new[(end < 0) | (end > len(text))] = far
        # a character of the text is missing in the item: the least of what is to the left, one more each step
        least = np.minimum.accumulate(new - steps) + steps
        if (least < new).any():
            source = np.maximum.accumulate(np.where(new - steps == np.minimum.accumulate(new - steps), steps, 0))
            start, new = start[source], least
        row, begin = np.minimum(new, far), start
        if row.min() > most:
            return None
    best = int(np.argmin(row))
    return (int(begin[best]), len(item) + int(diagonals[best]), int(row[best])) if row[best] <= most else None


class Items:
    """An index for each gram size that the items (``item_id, text`` as :func:`plain` gives it) need."""

    def __init__(self, items: list[tuple[int, str]], q: int, error: float):
        sized: dict[int, list[tuple[int, str]]] = {}
        for item in items:
            sized.setdefault(gram_size(len(item[1]), q, error), []).append(item)
        self.indexes = [ItemIndex(own, size, error, q) for size, own in sorted(sized.items())]

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (as :func:`plain` gives it) its ``item_id, start, end, distance``, by item."""
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for index in self.indexes:
            for all_, some in zip(found, index.leaks(texts)):
                all_ += some
        return [sorted(f, key=_by_item) for f in found]


def _by_item(leak: tuple[int | None, ...]) -> tuple[bool, tuple[int, ...]]:
    """The order of leaks: by item_id, a missing one last, then as they are."""
    return leak[0] is None, tuple(x or 0 for x in leak)


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different columns and the sums of their counts."""
    order = np.lexsort(rows[::-1])
    rows, counts = rows[:, order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])) if rows.shape[1] else np.zeros(0, np.int64)
    return rows[:, start], np.add.reduceat(counts, start) if len(start) else counts


@dataclass
class ItemIndex:
    """The q-grams of some benchmark items, sorted by hash; those of fewer than ``whole`` characters match between word boundaries only."""

    items: list[tuple[int, str]]
    q: int
    error: float
    whole: int = 0

    def __post_init__(self) -> None:
        self.points = [_points(t) for _, t in self.items]
        self.sizes = np.array([len(p) for p in self.points], np.int64)
        self.budgets = np.array([edit_budget(m, self.error) for m in self.sizes.tolist()], np.int64)
        self.bounds = self.sizes + 1 - self.q * (self.budgets + 1)
        self.steps = np.maximum(self.budgets, 8)
        self.powers = _powers(_SLICE + 1024)
        hashes, owner, place = [], [], []
        for k, p in enumerate(self.points):
            h = qgram_hashes(p, self.q, self._powers(len(p)))
            hashes.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[self.grams >> np.uint64(64 - _BITS)] = True

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.powers[0]):
            self.powers = _powers(n + 1)
        return self.powers

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (as :func:`plain` gives it) its ``item_id, start, end, distance``, by item."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if not len(self.grams):
            return [[] for _ in texts]
        points = _points("\0".join(texts))
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        hashes = qgram_hashes(points, self.q, self._powers(len(points)))
        at = np.flatnonzero(self.known[hashes >> np.uint64(64 - _BITS)])
        where = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        hit = self.grams[where] == hashes[at]
        at, where = at[hit], where[hit]
        # a gram that many items hold, in a text that repeats it, has very many hits: they are counted in parts
        total = np.cumsum(self.times[where])
        parts = [self._bands(at[p], where[p], begin) for p in np.split(np.arange(len(at)), np.flatnonzero(np.diff(total // _HITS)) + 1) if len(p)]
        if not parts:
            return [[] for _ in texts]
        rows, counts = _summed(np.concatenate([r for r, _ in parts], axis=1), np.concatenate([c for _, c in parts]))
        enough = counts >= self.bounds[rows[1]]
        for t, k, b in rows[:, enough].T.tolist():
            m, e, s = int(self.sizes[k]), int(self.budgets[k]), int(self.steps[k])
            low = b * s - m
            match = self._verify(texts[t], k, low, low + s + e - 1, e)
            if match and (k not in found[t] or (match[2], match[0]) < (found[t][k][2], found[t][k][0])):
                found[t][k] = match
        return [[(self.items[k][0], *f[k]) for k in sorted(f, key=lambda k: _by_item((self.items[k][0], k)))] for f in found]

    def _bands(self, at: np.ndarray, where: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``text, item, band`` of the hits, and how many each has."""
        times = self.times[where]
        entry = np.repeat(self.first[where] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        at = np.repeat(at, times)
        owner, text = self.owner[entry], np.searchsorted(begin, at, side="right") - 1
        diagonal = at - begin[text] - self.place[entry] + self.sizes[owner]  # from the text's start, never negative
        step = self.steps[owner]
        band = diagonal // step
        # a band holds the diagonals from its start to step + budget - 1, so it shares the last ones with the next
        also = (diagonal - band * step < self.budgets[owner]) & (band > 0)
        rows = np.stack([np.concatenate([text, text[also]]), np.concatenate([owner, owner[also]]), np.concatenate([band, band[also] - 1])])
        return _summed(rows, np.ones(rows.shape[1], np.int64))

    def _verify(self, text: str, k: int, low: int, high: int, most: int) -> tuple[int, int, int] | None:
        item = self.items[k][1]
        origin = max(0, low - most)
        region = text[origin : max(0, high + len(item) + most)]
        if len(item) < self.whole:
            found = re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text[max(0, origin - 1) : max(0, high + len(item) + most) + 1])
            start = found and found.start() + max(0, origin - 1)
            return found and (start, start + len(item), 0)
        exact = region.find(item)
        if exact >= 0:
            return origin + exact, origin + exact + len(item), 0
        if not most:
            return None
        match = aligned(self.points[k], _points(region), low - origin, high - origin, most)
        return match and (origin + match[0], origin + match[1], match[2])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, q: int = 12, error: float = 0.05, text: str = "text", item_text: str = "text", block_chars: int = 2_000_000, name: str = "leaks"
) -> DataFrame:
    """The rows of ``docs`` with one more column, ``leaks`` (or ``name``).

    ``leaks`` is an array of ``item_id, start, end, distance``, one for each item
    that occurs in the text with at most ``error`` of its characters edited
    (places count characters of the text as :func:`plain` gives it; of several
    the nearest, then the first), by item_id, items without one last. Items of fewer than q characters
    occur where they stand between word boundaries as they are; empty and null
    ones are contained in nothing. Equal items are each found. Null texts are
    empty; long ones are searched whole. An empty benchmark gives empty arrays.
    The benchmark is read in blocks of at most ``block_chars`` characters (about
    40 bytes each in a task); the driver and the tasks hold one at a time, and
    the texts found so far are written between blocks.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    others = [c for c in docs.columns if c != name]
    found = docs.select(*others, F.array().cast(f"array<{LEAK}>").alias(name))
    passes = 0
    for block in _blocks(benchmark, item_text, block_chars):
        found = _pass(written(found, "leaks") if passes else found, sc.broadcast(block), q, error, text, others, found.schema)
        passes += 1
    return found


def _blocks(benchmark: DataFrame, item_text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in benchmark.select("item_id", F.col(item_text).alias("text")).orderBy("item_id", "text").toLocalIterator():
        item = plain(row.text)
        if item:
            if held and size + len(item) > block_chars:
                yield held
                held, size = [], 0
            held.append((row.item_id, item))
            size += len(item)
    if held:
        yield held


def _pass(df: DataFrame, block, q: int, error: float, text: str, others: list[str], result) -> DataFrame:
    column = others.index(text)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "distance")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(block.value, q, error)
        for batch in batches:
            found = []
            for _, texts in slices(batch, column, _SLICE):
                found += index.leaks([plain(t) for t in texts])
            before = batch.column(len(others)).to_pylist()
            rows = [[*(tuple(x.values()) for x in old), *new] for old, new in zip(before, found)]
            leaks = pa.array([[dict(zip(("item_id", "start", "end", "distance"), x)) for x in sorted(r, key=_by_item)] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], leaks], names=result.names)

    return df.transform(bounded).mapInArrow(work, result)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, contaminated, n_items, item_ids, least_distance`` (null: no item).

    Nulls, empty and long texts, short items and an empty benchmark are as in
    :func:`find_leaks`; repeated rows each have a row; an empty table gives none.
    """
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    ids = F.transform("leaks", lambda x: x["item_id"])
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs, with the same columns."""
    name = free_name(docs, "leaks")
    return find_leaks(docs, benchmark, name=name, **options).where(F.size(name) == 0).select(*docs.columns)
