"""Token ids in bit-packed binary files with random access.

File format (all integers little-endian)::

    bytes 0-7     magic  b"SWTOKEN1"
    8-11          bits per id
    12-15         ids per block
    16-           blocks, one after the other
    then          block offsets, uint64 each, one more than blocks
    then          document starts in ids, uint64 each, one more than documents
    then          document ids, int64 each
    then          a byte for each document: 1 if it has an id (else the id is 0)
    last 24 bytes number of ids, number of documents, position of the block offsets, uint64 each

A block holds its ids in ``bits`` bits each, lowest bit first, and fills up with
zeros to whole bytes. A reader finds the block of an id from the offsets and
unpacks that block alone, with numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, partitions, scratch, slices, written
from .tokens import encoder

MAGIC = b"SWTOKEN1"
HEAD = struct.Struct("<8sII")
TAIL = struct.Struct("<QQQ")
_SLICE = 1_000_000


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class TokenFileWriter:
    """Writes one file; it appears under its name only when it is complete."""

    def __init__(self, path: str, bits: int, block: int, attempt: str):
        self.store, self.path = _store(path)
        self.part = f"{self.path}.{attempt}"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.part)
        self.bits, self.block = bits, block
        self.out.write(HEAD.pack(MAGIC, bits, block))
        self.at, self.offsets, self.held, self.n_held = HEAD.size, [HEAD.size], [], 0
        self.starts, self.doc_ids = [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            rest = np.concatenate(self.held)
            whole = len(rest) - len(rest) % self.block
            for at in range(0, whole, self.block):
                self._flush(rest[at : at + self.block])
            self.held, self.n_held = [rest[whole:]], len(rest) - whole

    def _flush(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> int:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        tail = self.at
        for values, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), ([d or 0 for d in self.doc_ids], "<i8"), ([d is not None for d in self.doc_ids], "u1")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(TAIL.pack(self.starts[-1], len(self.doc_ids), tail))
        self.out.close()
        self.store.move(self.part, self.path)
        return self.starts[-1]


class TokenFile:
    """Random access to the ids of a file."""

    def __init__(self, path: str):
        store, where = _store(path)
        self.file = store.open_input_file(where)
        magic, self.bits, self.block = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.n_ids, self.n_docs, tail = TAIL.unpack(self.file.read_at(TAIL.size, self.file.size() - TAIL.size))
        self.n_blocks = -(-self.n_ids // self.block)
        rest = self.file.read_at(self.file.size() - TAIL.size - tail, tail)
        self.offsets = np.frombuffer(rest, "<u8", self.n_blocks + 1)
        self.starts = np.frombuffer(rest, "<u8", self.n_docs + 1, 8 * (self.n_blocks + 1)).astype(np.int64)
        self.doc_ids = np.frombuffer(rest, "<i8", self.n_docs, 8 * (self.n_blocks + self.n_docs + 2))
        self.has_id = np.frombuffer(rest, "u1", self.n_docs, 8 * (self.n_blocks + 2 * self.n_docs + 2)).astype(bool)

    def read_block(self, k: int) -> np.ndarray:
        begin, end = int(self.offsets[k]), int(self.offsets[k + 1])
        return unpack_bits(self.file.read_at(end - begin, begin), self.bits, min(self.block, self.n_ids - k * self.block))

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` on."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        ids = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return ids[start - first * self.block :][:n]

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(self.n_blocks):
            yield self.read_block(k)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, block: int = 65_536, text: str = "text") -> DataFrame:
    """Writes all documents in ascending doc_id order; one row per file.

    Files are numbered in that order: ``part, path, n_ids, n_docs``. Rows are
    dealt out by ranges of doc_id (rows of one doc_id by a hash of the text) and
    sorted in each, equal rows side by side, so a task that runs again writes the
    same file again under the same name. Rows without doc_id come first, marked
    as such in the file; any doc_id, also a negative one, comes back as it is.
    Null texts are empty: the end id alone. A long text is encoded in pieces and
    written block by block. Other columns are not read. An empty table gives no
    file.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, coder, out = TaskContext.get(), encoder(vocabulary), None
        part = context.partitionId()
        path = f"{folder}/tokens-{part:06d}.bin"
        bits = max(1, (coder.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, texts in slices(batch, 1, _SLICE):
                ids, starts = coder.encode(texts)
                out = out or TokenFileWriter(path, bits, block, f"{context.taskAttemptId()}.part")
                for k in range(len(texts)):
                    out.add(doc_ids[at + k], np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)))
        if out:
            n = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_ids": [n], "n_docs": [len(out.doc_ids)]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return written(ordered.transform(bounded).mapInArrow(work, "part int, path string, n_ids long, n_docs long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, read from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it in all files. The list
    of files has a row per task of the writer; its sums are made on the driver.
    """
    spark = files.sparkSession
    listed = sorted((r.part, r.path, r.n_ids) for r in files.collect())
    jobs, before = [], 0
    for _, path, n in listed:
        jobs.append((path, before))
        before += n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _digests(TokenFile(path), first)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not jobs:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(jobs, "path string, first long").repartition(len(jobs)).transform(bounded).mapInArrow(work, schema)


def _digests(file: TokenFile, first: int, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Each document's digest; one block is in memory at a time."""
    k, at, crc, found = 0, 0, 0, []
    for ids in file.blocks():
        data, used = ids.astype("<u4").tobytes(), 0
        while used < len(ids) and k < file.n_docs:
            taken = min(len(ids) - used, int(file.starts[k + 1]) - at)
            crc = zlib.crc32(data[4 * used : 4 * (used + taken)], crc)
            used, at = used + taken, at + taken
            if at == file.starts[k + 1]:
                found.append(crc)
                k, crc = k + 1, 0
    for a in range(0, len(found), most):
        b = min(len(found), a + most)
        ids = file.doc_ids[a:b]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=~file.has_id[a:b]), pa.array(first + file.starts[a:b]), pa.array(file.starts[a + 1 : b + 1] - file.starts[a:b]), pa.array(found[a:b], pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Writes the token files to the shared folder and reads them back."""
    return read_token_files(write_token_files(docs, scratch(docs.sparkSession, "tokens"), vocabulary, end_id))
