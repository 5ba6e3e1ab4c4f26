"""Suffix and common-prefix arrays of a shard by recursive induced sorting on disk.

A shard is a file of segments with a separator after each (symbol 1; the last
symbol, 0, is the end) that ends every common prefix. Suffixes are S (smaller
than the one a symbol later) or L; an S after an L is S*. At every level of the
recursion

1. the strings from one S* to the next are sorted by inducing from the S* as they
   come, and named;
2. the names, at most half as many symbols, are sorted as a text of their own,
   by recursion, until they are all different or few;
3. the S* suffixes in that order, with their common prefixes, induce the L
   suffixes in ascending and these the S suffixes in descending order.

Inducing takes suffix tuples (first symbol, position, common prefix with the one
before) from a priority queue and puts the tuple of the position before into it.
Keys arrive in their final order within a symbol, so the queue is monotone and
stable; what exceeds its memory lies in sorted runs on disk. The common prefix of
two induced neighbours is one more than the least common prefix since the last
tuple for that symbol; a stack of suffix minima, no longer than ``depth``, answers
for any time. The last few suffixes of a symbol that induce each other along a run
of it are followed to the run's beginning in one block.

Texts, types, names and sorted tuples that exceed a fixed size are files, mapped
or read by block: what a process holds does not grow with the shard. Lengths are cut at ``depth``: what
agrees so far counts as equal, and k symbols of a level are at least 2 k of the
one above, so the recursion ends after log2(depth) levels.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples worked on at a time.
BLOCK = 1 << 16
#: Tuples that a queue or a list holds in memory; arrays of at most eight times as many bytes stay there, too.
HELD = 1 << 18
#: Texts of at most so many names are sorted in memory.
FEW = 1 << 18
#: At most so many tuples of one symbol are followed along a run of that symbol at once.
CHAINS = 16
_KINDS = ("<u4", "<i8", "<u2")
_SEPARATOR = 1

#: Suffix tuples as three arrays: keys (first symbols), positions, common prefixes.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]
_NONE: Block = tuple(np.zeros(0, k) for k in _KINDS)


def _file(folder: str, name: str, kind: str, n: int) -> np.ndarray:
    """Zeros in memory, or as a mapped file."""
    if n * np.dtype(kind).itemsize <= 8 * HELD:
        return np.zeros(n, kind)
    return np.asarray(np.memmap(os.path.join(folder, name), kind, "w+", shape=(max(n, 1),)))[:n]


def _cut(block: Block, at: slice | np.ndarray) -> Block:
    return tuple(a[at] for a in block)


def _joined(blocks: list[Block], by_key: bool = True) -> Block:
    """Blocks one after the other, or by key, the earlier block first."""
    if len(blocks) < 2:
        return blocks[0] if blocks else _NONE
    key, at, common = (np.concatenate(parts) for parts in zip(*blocks))
    if not by_key:
        return key, at, common
    order = np.argsort(key, kind="stable")
    return key[order], at[order], common[order]


def _below(block: Block, key: int) -> int:
    """How many of a block sorted by key have a smaller one."""
    return int(np.searchsorted(block[0], np.uint32(min(key, 0xFFFFFFFF))))


class Tuples:
    """A list of tuples, on disk if it is long: written at its end and then read."""

    def __init__(self, path: str):
        self.paths, self.n = [f"{path}-{k}" for k in range(3)], 0
        self.held: list[Block] = []
        self.files: list = []

    def add(self, block: Block) -> None:
        self.held.append(tuple(np.ascontiguousarray(part, kind) for part, kind in zip(block, _KINDS)))
        self.n += len(block[0])
        if self.n > HELD or self.files:
            self.files = self.files or [open(p, "wb") for p in self.paths]
            for held in self.held:
                for file, part in zip(self.files, held):
                    file.write(part.data)
            self.held = []

    def read(self) -> Block:
        if not self.files:
            return _joined(self.held, by_key=False)
        for file in self.files:
            file.close()
        return tuple(np.asarray(np.memmap(p, k, "r", shape=(self.n,))) for p, k in zip(self.paths, _KINDS))

    def delete(self) -> None:
        """Its space is free once what was read is no longer used."""
        for file, path in zip(self.files, self.paths):
            file.close()
            os.unlink(path)


class TupleQueue:
    """A monotone priority queue: tuples by key, those of one key first in, first out.

    Sorted runs, the oldest first. Neighbouring runs in memory are merged as they
    reach like sizes; above ``held`` tuples they go to files, as one run.
    """

    def __init__(self, folder: str, name: str, held: int | None = None):
        self.folder, self.name, self.held = folder, name, held or HELD
        self.runs: list[Block] = []
        self.on_disk = self.written = 0

    def push(self, block: Block) -> None:
        """Adds tuples that are sorted by key."""
        if not len(block[0]):
            return
        self.runs.append(block)
        while len(self.runs) - self.on_disk > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            self.runs[-2:] = [_joined(self.runs[-2:])]
        if sum(len(r[0]) for r in self.runs[self.on_disk :]) > self.held:
            out = Tuples(os.path.join(self.folder, f"{self.name}-{self.written}"))
            out.add(_joined(self.runs[self.on_disk :]))
            self.runs[self.on_disk :] = [out.read()]
            self.on_disk, self.written = self.on_disk + 1, self.written + 1

    def least(self) -> int:
        return min((int(r[0][0]) for r in self.runs), default=-1)

    def bound(self, most: int) -> int:
        """A key below which at most ``most`` tuples lie."""
        share = max(1, most // max(1, len(self.runs)))
        return min((int(r[0][share]) for r in self.runs if len(r[0]) > share), default=1 << 40)

    def peek(self, below: int) -> Block:
        """All tuples with keys less than ``below``, in order."""
        parts = [_cut(r, slice(n)) for r in self.runs if (n := _below(r, below))]
        return _joined(parts)

    def drop(self, below: int) -> None:
        self._keep([_cut(r, slice(_below(r, below), None)) for r in self.runs])

    def take(self, key: int, most: int) -> Block:
        """The oldest tuples of the least key, at most so many."""
        parts, rest = [], []
        for r in self.runs:
            n = min(most, _below(r, key + 1))
            if n:
                parts.append(_cut(r, slice(n)))
            rest.append(_cut(r, slice(n, None)))
            most -= n
        self._keep(rest)
        return _joined(parts, by_key=False)

    def _keep(self, runs: list[Block]) -> None:
        self.on_disk = sum(len(r[0]) > 0 for r in runs[: self.on_disk])
        self.runs = [r for r in runs if len(r[0])]


class Minima:
    """The least of the values since any time, for values up to a small bound."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.times, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def since(self, time: np.ndarray) -> np.ndarray:
        """The least value after each time."""
        place = np.searchsorted(self.times, time, side="right")
        return np.append(self.values, self.most)[place]

    def add(self, values: np.ndarray) -> None:
        least = np.minimum.accumulate(values[::-1])[::-1]
        last = np.flatnonzero(np.append(least[1:] != least[:-1], True))
        kept = np.searchsorted(self.values, least[0])  # values ascend with time
        self.times = np.append(self.times[:kept], self.now + last)
        self.values = np.append(self.values[:kept], least[last])
        self.now += len(values)


class Level:
    """One text of the recursion: symbols 0 to ``symbols - 1``, the last one 0 and the only 0."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, folder: str, separated: bool):
        self.text, self.symbols, self.depth, self.folder, self.separated = text, symbols, depth, folder, separated
        self.n = len(text)
        self.small = _file(folder, "small", "u1", self.n)
        self._types()

    def _types(self) -> None:
        """Marks S suffixes, and puts the S* positions into a file."""
        after = 1
        for end in range(self.n, 0, -BLOCK):
            begin = max(0, end - BLOCK)
            part = np.append(self.text[begin:end], self.text[end : end + 1]).astype(np.int64)
            step = np.sign(part[1:] - part[:-1]) if end < self.n else np.append(np.sign(part[1:] - part[:-1]), 1)
            place = np.where(step != 0, np.arange(len(step)), len(step))
            place = np.minimum.accumulate(place[::-1])[::-1]
            self.small[begin:end] = np.append(step > 0, after > 0)[place]
            after = int(self.small[begin])
        counts = []
        for part in self._star_blocks():
            counts.append(len(part))
        self.n_stars = sum(counts)
        self.stars = _file(self.folder, "stars", "<i8", self.n_stars)
        at = 0
        for part in self._star_blocks():
            self.stars[at : at + len(part)] = part
            at += len(part)

    def _star_blocks(self) -> Iterator[np.ndarray]:
        for begin in range(1, self.n, BLOCK):
            part = self.small[begin - 1 : begin + BLOCK]
            yield np.flatnonzero(part[1:] > part[:-1]) + begin

    def _run(self, at: np.ndarray) -> np.ndarray:
        """How often the first symbol repeats from each position on, up to ``depth``."""
        length, active = np.ones(len(at), np.int64), np.arange(len(at))
        for k in range(1, self.depth):
            active = active[at[active] + k < self.n]
            active = active[self.text[at[active] + k] == self.text[at[active]]]
            if not len(active):
                break
            length[active] += 1
        return length

    def _induce(self, seeds: Block, down: bool, out: Callable[[Block, np.ndarray], None], prefixes: bool) -> None:
        """One pass: from ``seeds`` in order, the suffixes of the other type, and all of them to ``out`` (tuples, and which are induced).

        Keys are symbols, or for the descending pass what they lack to the last symbol.
        """
        top = self.symbols - 1
        queue = TupleQueue(self.folder, f"queue-{down}-{prefixes}")
        minima, last_time = Minima(self.depth), _file(self.folder, f"times-{down}", "<i8", self.symbols if prefixes else 0)
        last_time[:] = -1
        self.previous = (-1, -1, False)  # key, position, induced?

        def induces(block: Block) -> tuple[np.ndarray, np.ndarray]:
            """Which tuples induce one, and the keys of those."""
            good = np.flatnonzero(block[1] > 0)
            before = block[1][good] - 1
            fits = self.small[before] == down
            symbol = self.text[before[fits]].astype(np.int64)
            return good[fits], top - symbol if down else symbol

        def step(block: Block, induced: np.ndarray, good: np.ndarray, key: np.ndarray) -> None:
            """Gives on a block in its final order and queues what it induces."""
            if prefixes:
                block = (block[0], block[1], self._fit(block, induced))
            out(block, induced)
            order = np.argsort(key, kind="stable")
            good, key = good[order], key[order]
            found = np.zeros(len(good), np.uint16)
            if prefixes:
                common = block[2].astype(np.int64)
                if len(good):
                    first = np.append(True, key[1:] != key[:-1])
                    start = np.where(first, 0, np.append(0, good[:-1] + 1))
                    least = np.minimum.reduceat(np.append(common, self.depth), np.stack([start, good + 1], axis=1).ravel())[::2]
                    least[first] = np.minimum(least[first], minima.since(last_time[key[first]]))
                    found = np.minimum(least + 1, self.depth).astype(np.uint16)
                    last = np.append(first[1:], True)
                    last_time[key[last]] = minima.now + good[last]
                minima.add(common)
            queue.push((key.astype(np.uint32), block[1][good] - 1, found))

        seed, size = 0, 1024
        while True:
            lows = [k for k in (queue.least(), int(seeds[0][seed]) if seed < len(seeds[0]) else -1) if k >= 0]
            if not lows:
                return
            low = min(lows)
            high = min(queue.bound(size), int(seeds[0][seed + size]) if seed + size < len(seeds[0]) else 1 << 40)
            if high > low:
                waiting, own = queue.peek(high), _cut(seeds, slice(seed, seed + size))
                own = _cut(own, slice(_below(own, high)))
                block = tuple(np.concatenate(parts) for parts in zip(waiting, own))
                order = np.argsort(block[0], kind="stable")
                block, induced = _cut(block, order), order < len(waiting[0])
                good, key = induces(block)
                inner = key[key < high]
                if len(inner):  # what they induce comes before the rest of the block
                    high = int(inner.min())
                    n = _below(block, high)
                    block, induced = _cut(block, slice(n)), induced[:n]
                    m = int(np.searchsorted(good, n))
                    good, key = good[:m], key[:m]
                    size = max(256, min(size, 2 * n))
                else:
                    size = min(2 * size, BLOCK)
                if high > low:
                    queue.drop(high)
                    seed += int(np.count_nonzero(~induced))
                    step(block, induced, good, key)
                    continue
            while queue.least() == low:
                part = queue.take(low, BLOCK)
                since = int(minima.since(last_time[low : low + 1])[0]) if prefixes else 0
                chains = self._chained(part, since, prefixes) if len(part[0]) <= CHAINS and queue.least() != low else None
                good, key = induces(chains or part)
                if chains:  # what they induce in their own symbol is there already
                    good, key = good[key != low], key[key != low]
                step(chains or part, np.ones(len((chains or part)[0]), bool), good, key)
            while seed < len(seeds[0]) and seeds[0][seed] == low:
                part = _cut(seeds, slice(seed, seed + BLOCK))
                part = _cut(part, slice(_below(part, low + 1)))
                seed += len(part[0])
                step(part, np.zeros(len(part[0]), bool), *induces(part))

    def _chained(self, last: Block, least: int, prefixes: bool) -> Block | None:
        """The last induced tuples of a symbol and all that they induce in it, in order; None if these are none or too many.

        ``least`` is the least common prefix since the last tuple that induced one in this symbol.
        """
        waiting, common = last[1].tolist(), last[2].tolist()
        if self.previous[0] != last[0][0]:
            common[0] = 0
        out_at, out_common = [], []
        while waiting and len(out_at) <= BLOCK:
            out_at += waiting
            out_common += common
            induced, shared = [], []
            for at, value in zip(waiting, common):
                least = min(least, value)
                if at and self.text[at - 1] == self.text[at]:
                    induced.append(at - 1)
                    shared.append(min(least + 1, self.depth) if prefixes else 0)
                    least = self.depth
            waiting, common = induced, shared
        if waiting or len(out_at) == len(last[1]):
            return None
        return np.full(len(out_at), last[0][0], np.uint32), np.array(out_at, np.int64), np.array(out_common, np.uint16)

    def _fit(self, block: Block, induced: np.ndarray) -> np.ndarray:
        """Common prefixes, also where a symbol begins, and where its seeds follow the induced suffixes."""
        key, at, common = block[0].astype(np.int64), block[1], block[2].copy()
        last_key, last_at, last_induced = self.previous
        same = key == np.append(last_key, key[:-1])
        common[~same] = 0
        border = np.flatnonzero(same & ~induced & np.append(last_induced, induced[:-1]))
        if len(border):
            common[border] = np.minimum(self._run(np.append(last_at, at[:-1])[border]), self._run(at[border]))
        if self.separated:
            common[self.text[at] <= _SEPARATOR] = 0
        self.previous = (int(key[-1]), int(at[-1]), bool(induced[-1]))
        return common

    def _both_passes(self, seeds: Block, out: Callable[[Block, np.ndarray], None], prefixes: bool) -> None:
        """From S* suffixes in order the L suffixes, then from these all but the end in descending order."""
        large = Tuples(os.path.join(self.folder, f"large-{prefixes}"))
        self._induce(seeds, False, lambda block, induced: large.add(_cut(block, induced)), prefixes)
        found = large.read()
        turned = Tuples(os.path.join(self.folder, f"turned-{prefixes}"))
        for end in range(len(found[0]), 0, -BLOCK):
            begin = max(0, end - BLOCK)
            # going down, a suffix's common prefix with the one above it is the upper one's value
            above = found[2][begin + 1 : end + 1][::-1]
            turned.add((self.symbols - 1 - found[0][begin:end][::-1], found[1][begin:end][::-1], above if len(above) == end - begin else np.append(0, above)))
        large.delete()
        found = above = None
        self._induce(turned.read(), True, out, prefixes)
        turned.delete()

    def _seeds(self, name: str, at: np.ndarray, common: np.ndarray) -> Block:
        seeds = Tuples(os.path.join(self.folder, name))
        for b in range(0, len(at), BLOCK):
            seeds.add((self.text[at[b : b + BLOCK]], at[b : b + BLOCK], common[b : b + BLOCK]))
        return seeds.read()

    def _by_symbol(self) -> Block:
        """The S* positions by their first symbol alone."""
        queue = TupleQueue(self.folder, "stars-by-symbol")
        for begin in range(0, self.n_stars, BLOCK):
            at = self.stars[begin : begin + BLOCK]
            key = self.text[at].astype(np.uint32)
            order = np.argsort(key, kind="stable")
            queue.push((key[order], at[order], np.zeros(len(at), np.uint16)))
        out = Tuples(os.path.join(self.folder, "seeds-by-symbol"))
        while (low := queue.least()) >= 0:
            high = queue.bound(BLOCK)
            if high > low:
                out.add(queue.peek(high))
                queue.drop(high)
            else:
                out.add(queue.take(low, BLOCK))
        return out.read()

    def sorted_stars(self) -> tuple[np.ndarray, np.ndarray]:
        """S* positions in suffix order (up to ``depth``) and their common prefixes."""
        descending = Tuples(os.path.join(self.folder, "star-strings"))

        def star_only(block: Block, induced: np.ndarray) -> None:
            at = block[1]
            descending.add(_cut(block, np.flatnonzero(induced & (at > 0) & (self.small[at - 1] == 0))))

        self._both_passes(self._by_symbol(), star_only, False)
        found = descending.read()[1]
        order = _file(self.folder, "star-order", "<i8", self.n_stars)
        order[0] = self.n - 1  # the end
        for begin in range(0, len(found), BLOCK):
            part = found[begin : begin + BLOCK]
            order[self.n_stars - begin - len(part) : self.n_stars - begin] = part[::-1]
        found = None
        descending.delete()
        number, names = self._name(order)
        common = _file(self.folder, "star-common", "<u2", self.n_stars)
        if names < self.n_stars and self.depth > 2:
            below, shared = _sorted(number, names, self.depth // 2 + 1, os.path.join(self.folder, "names"))
            for begin in range(0, self.n_stars, BLOCK):
                order[begin : begin + BLOCK] = self.stars[below[begin : begin + BLOCK]]
        for begin in range(0, self.n_stars, BLOCK):
            at = order[max(begin - 1, 0) : begin + BLOCK]
            known = np.zeros(len(at) - 1, np.int64)
            if names < self.n_stars and self.depth > 2:
                k = shared[begin + 1 - min(begin, 1) : begin + BLOCK].astype(np.int64)
                index = below[begin + 1 - min(begin, 1) : begin + BLOCK]
                known = self.stars[np.minimum(index + k, self.n_stars - 1)] - self.stars[index]
            common[begin + 1 - min(begin, 1) : begin + BLOCK] = self._common(at[:-1], at[1:], known)
        return order, common

    def _name(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """The text of names, in the order of positions, and how many there are."""
        length = _file(self.folder, "lengths", "<u4", self.n // 2 + 1)  # S* positions are two apart at least
        for begin in range(0, self.n_stars, BLOCK):
            part = self.stars[begin : begin + BLOCK + 1]
            size = np.diff(part) + 1
            length[part[: len(size)] // 2] = size
        length[(self.n - 1) // 2] = 1
        name = _file(self.folder, "name-at", "<u4", self.n // 2 + 1)
        name[(self.n - 1) // 2], names = 0, 0
        for begin in range(1, self.n_stars, BLOCK):
            at = order[begin - 1 : begin + BLOCK]
            a, b = at[:-1], at[1:]
            size = length[a // 2].astype(np.int64)
            same = size == length[b // 2]
            active, k = np.flatnonzero(same), 0
            while len(active):
                differ = self.text[a[active] + k] != self.text[b[active] + k]
                same[active[differ]] = False
                k += 1
                active = active[~differ & (size[active] > k)]
            name[b // 2] = names + np.cumsum(~same)
            names += int(np.count_nonzero(~same))
        number = _file(self.folder, "numbers", "<u4", self.n_stars)
        for begin in range(0, self.n_stars, BLOCK):
            number[begin : begin + BLOCK] = name[self.stars[begin : begin + BLOCK] // 2]
        return number, names + 1

    def _common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes that agree in ``known`` symbols at least."""
        common = np.minimum(known, self.depth)
        if self.separated:
            ends = self.ends[np.searchsorted(self.ends, a)] - a
            common = np.minimum(common, ends)
        active = np.flatnonzero(common < self.depth)
        steps = np.arange(8)
        while len(active):
            x = self.text[np.minimum((a[active] + common[active])[:, None] + steps, self.n - 1)]
            y = self.text[np.minimum((b[active] + common[active])[:, None] + steps, self.n - 1)]
            same = (x == y) & (x > _SEPARATOR) if self.separated else x == y
            more = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
            common[active] = np.minimum(common[active] + more, self.depth)
            active = active[(more == 8) & (common[active] < self.depth)]
        return common

    def sort(self, out: Callable[[Block, np.ndarray], None]) -> None:
        """All suffixes but the end, in descending order with the common prefix with the one above, to ``out``."""
        if self.n_stars < 2:  # the end alone: every suffix is induced from it
            order, common = np.array([self.n - 1]), np.zeros(1, np.uint16)
        else:
            order, common = self.sorted_stars()
        self._both_passes(self._seeds("seeds", order, common), out, True)


def _sorted(text: np.ndarray, symbols: int, depth: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text in suffix order, and common prefixes that neighbours are known to have."""
    os.makedirs(folder)
    n = len(text)
    if n <= FEW:
        return _few(np.array(text), depth), np.zeros(n, np.uint16)
    order, common = _file(folder, "order", "<i8", n), _file(folder, "common", "<u2", n + 1)
    place = n

    def out(block: Block, induced: np.ndarray) -> None:
        nonlocal place
        begin = place - len(block[1])
        order[begin:place] = block[1][::-1]
        common[begin + 1 : place + 1] = block[2][::-1]
        place = begin

    Level(text, symbols, depth, folder, False).sort(out)
    order[0], common[0], common[1:2] = n - 1, 0, 0
    return order, common[:n]


def _few(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in suffix order (up to ``depth``) by doubling."""
    rank, step = text.astype(np.int64), 1
    while step < depth:
        follower = np.zeros(len(rank), np.int64)
        follower[:-step] = rank[step:] + 1
        pair = np.lexsort([follower, rank])
        new = np.append(False, (rank[pair][1:] != rank[pair][:-1]) | (follower[pair][1:] != follower[pair][:-1]))
        rank = np.empty(len(pair), np.int64)
        rank[pair] = np.cumsum(new)
        if rank[pair[-1]] == len(pair) - 1:
            break
        step *= 2
    return np.argsort(rank, kind="stable")


class Shard:
    """Segments written to a file one after the other, then sorted."""

    def __init__(self, folder: str):
        self.folder, self.n, self.segments = folder, 0, 0
        self.file, self.begins = open(os.path.join(folder, "bytes"), "wb"), open(os.path.join(folder, "begins"), "wb")

    def add(self, segment: bytes) -> None:
        """A separator follows every segment, also an empty one."""
        if segment:
            self.file.write((np.frombuffer(segment, np.uint8).astype("<u2") + 2).tobytes())
            self.file.write(np.array([_SEPARATOR], "<u2").tobytes())
        self.begins.write(np.array([self.n], "<i8").tobytes())
        self.n += len(segment) + (len(segment) > 0)
        self.segments += 1

    def repeated(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (segment, place in it) where strings of ``depth`` bytes start that also start elsewhere in the shard."""
        self.file.close()
        self.begins.close()
        if not self.n:
            return
        text = np.asarray(np.memmap(os.path.join(self.folder, "bytes"), "<u2", "r+", shape=(self.n,)))
        text[-1] = 0
        level = Level(text, 258, depth, self.folder, True)
        begins = np.asarray(np.memmap(os.path.join(self.folder, "begins"), "<i8", "r", shape=(self.segments,)))
        ends = _file(self.folder, "ends", "<i8", self.segments)
        ends[:-1] = begins[1:] - 1
        ends[-1] = self.n - 1
        level.ends = ends
        mark = _file(self.folder, "mark", "u1", self.n)
        above = -1

        def out(block: Block, induced: np.ndarray) -> None:
            nonlocal above
            equal, at = block[2] >= depth, block[1]
            mark[at[equal]] = 1
            mark[np.append(above, at[:-1])[equal]] = 1
            above = int(at[-1])

        level.sort(out)
        for begin in range(0, self.n, BLOCK):
            at = np.flatnonzero(mark[begin : begin + BLOCK]) + begin
            if len(at):
                owner = np.searchsorted(begins, at, side="right") - 1
                yield owner, at - begins[owner]


def repeated_starts(segments: list[bytes], depth: int) -> list[np.ndarray]:
    """For each segment, where strings of ``depth`` bytes start that also start elsewhere in any segment."""
    found: list[list[np.ndarray]] = [[] for _ in segments]
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        shard = Shard(folder)
        for segment in segments:
            shard.add(segment)
        for owner, at in shard.repeated(depth):
            for k in np.unique(owner).tolist():
                found[k].append(at[owner == k])
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]
