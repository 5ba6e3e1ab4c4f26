"""Packing documents into training sequences by the sum-of-squares rule.

Each task packs its documents as they come. A level array counts the open
windows at every fill level; a piece goes into the level that makes the sum of
the squared counts smallest (a new window is level 0, a full one counts no
more). What is still open at the end of a task is poured together, cutting
pieces where needed, so that a task leaves at most one window that isn't full.
No row is shuffled, so hot sources or repeated texts make no task larger.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_SLICE = 1_000_000

#: A piece of a document: its id, where the piece starts, its token ids, and the document's number of tokens.
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Online packing into windows of ``capacity`` tokens."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # open windows by fill level
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.closed: list[list[Piece]] = []

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) that the rule chooses for ``size`` tokens.

        Moving a window from level h to h + size changes the sum of squares by
        2 (N[h + size] - N[h]) + 2, or less the first part where nothing is left
        or taken. Of equal levels the fullest is chosen.
        """
        n, room = self.counts, self.capacity - size
        cost = 2 * (n[size : self.capacity + 1] - n[: room + 1]) + 2
        cost[room] = 1 - 2 * n[room]  # full windows do not count
        cost[0] = 2 * n[size] + 1 if room else 0
        possible = n[: room + 1] > 0
        possible[0] = True
        cost = np.where(possible, cost, np.iinfo(np.int64).max)
        return int(room - np.argmin(cost[::-1]))

    def place(self, piece: Piece) -> None:
        size = len(piece[2])
        level = self.level_for(size)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            self.closed.append(window)
        else:
            self.open[level + size].append(window)
            self.counts[level + size] += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Whole windows are cut from a long document's front, the rest is placed."""
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self.closed.append([(doc_id, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at < total:
            self.place((doc_id, at, ids[at:].copy(), total))

    def settle(self) -> None:
        """Pours the emptiest open windows into the fullest until one is left."""
        windows = [(h, w) for h in range(self.capacity - 1, 0, -1) for w in self.open[h]]
        fill, lists = [h for h, _ in windows], [w for _, w in windows]
        i, j = 0, len(lists) - 1
        while i < j:
            gap = self.capacity - fill[i]
            if not gap:
                i += 1
                continue
            doc_id, at, ids, total = lists[j].pop()
            taken = min(gap, len(ids))
            lists[i].append((doc_id, at, ids[:taken], total))
            if taken < len(ids):
                lists[j].append((doc_id, at + taken, ids[taken:], total))
            fill[i] += taken
            fill[j] -= taken
            if not fill[j]:
                j -= 1
        self.closed += [w for w in lists if w]
        self.open = [[] for _ in range(self.capacity)]
        self.counts[:] = 0


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row per piece (columns: :data:`SCHEMA`).

    A document's ids are those of its text and ``end_id``; each id lies in
    exactly one piece. ``start`` counts the document's ids before the piece,
    ``offset`` the sequence's; ``sequence_tokens`` is the sequence's fill before
    padding. Null and empty texts have the end id alone. Equal or missing
    doc_ids are packed row by row. Columns besides doc_id and text are not read;
    an empty table gives no rows. ``sequence_id`` is the task's number times
    2**32 and a count, so a task that runs again gives the same rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, done = SumOfSquares(capacity), 0
        first = TaskContext.get().partitionId() << 32
        encode = encoder(vocabulary).encode
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, texts in slices(batch, 1, _SLICE):
                ids, starts = encode(texts)
                for k in range(len(texts)):
                    bins.add(doc_ids[at + k], np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)))
                yield _rows(bins, first + done)
                done += len(bins.closed)
                bins.closed = []
        bins.settle()
        yield _rows(bins, first + done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).transform(bounded).mapInArrow(work, SCHEMA)


def _rows(bins: SumOfSquares, first: int) -> pa.RecordBatch:
    rows = []
    for k, window in enumerate(bins.closed):
        offset, fill = 0, sum(len(p[2]) for p in window)
        for doc_id, at, ids, total in window:
            rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + k, offset, fill))
            offset += len(ids)
    columns = zip(*rows) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], _NAMES)
