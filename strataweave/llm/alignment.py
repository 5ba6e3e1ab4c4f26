"""Which tokens of two tokenizers cover the same bytes.

A byte-level vocabulary (A) and a piece vocabulary (B) cut a text in different
places. Where both end a token at one byte, a group ends; tokens are linked when
they share a group.

Neither vocabulary has a token that goes on over a space from one word to the
next, so a text may be cut before such spaces and its stretches be aligned by
themselves: the groups of a text are those of its stretches, one after the other.
The corpus has far fewer different stretches than stretches. The different ones
are aligned by relations alone (:func:`align_stretches`): tokens by
``posexplode``, their ends by a running sum of lengths, cuts by an equi-join on
stretch and end, groups by running counts of cuts, links by a join on stretch and
group. Where a vocabulary could go on over a space, a stretch is a whole text.

A document's figures are put together from those of its stretches. Documents are
dealt into blocks of bounded size (:func:`blocks`), which keep the numbers of their
stretches in the place of texts, and a block is told of each of its different
stretches once. It gives each document's different pairs and how often it has them;
the documents that hold a pair and the sums over these numbers follow by relations.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, partitions, scratch, written
from .exact_dedup import join_groups

#: Characters of texts in a block, unless a single text has more.
BLOCK = 8_000_000
#: Characters of texts in one compressed part of a block.
_PART = 4_000_000
#: Pair counts of at most so many rows (32 bytes each) are broadcast.
BROADCAST_ROWS = 1 << 20
_HELD_PAIRS = 200_000
#: Rounds that the blocks make their trips in.
ROUNDS = 4
#: Shares of stretches for each partition.
_SHARES = 256
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Without this, every space is a cut.
_UNEVEN = re.compile(r"\A\s|\s\s|\s\Z")
_NUMBERS = pa.schema([("doc_id", pa.int64()), ("ks", pa.list_(pa.int32()))])


def piece_path() -> str:
    """The piece vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Coder:
    """The two tokenizers, and the bytes that each token stands for."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        signs = {chr(s): b for b, s in _byte_signs().items()}
        with open(byte_level, encoding="utf-8") as file:
            rule = json.load(file).get("pre_tokenizer") or {}
        added = set(self.a.get_added_tokens_decoder())
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = b"" if i in added else bytes(signs.get(c, 63) for c in token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        one_word = all("▁" not in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        #: Whether texts may be cut before spaces.
        self.cuts = one_word and rule.get("type") == "ByteLevel" and rule.get("use_regex", True)

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text, each without the space before it; none of an empty text."""
        if not text or not self.cuts:
            return [text] if text else []
        return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, list[pa.ListArray]]:
        """Of stretches, a space before each: whether both give its bytes; A's tokens, each with the byte at which it ends, and B's."""
        wholes = [b" " + w.encode() for w in stretches]
        coded_a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in stretches], add_special_tokens=False)]
        same, lists = np.ones(len(stretches), bool), []
        for coded, known in ((coded_a, self.a_bytes), (self.b.encode(stretches, num_threads=1), self.b_bytes)):
            starts = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(ids) for ids in coded], out=starts[1:])
            parts = [known[i] for i in chain.from_iterable(coded)]
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            edges = np.concatenate([[0], ends])[starts]
            given = b"".join(parts)
            same &= np.fromiter((given[i:j] == w for i, j, w in zip(edges.tolist(), edges[1:].tolist(), wholes)), bool, len(wholes))
            ids = np.fromiter(chain.from_iterable(coded), np.int32, len(parts))
            own = (ends - np.repeat(edges[:-1], np.diff(starts))).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(ids), pa.array(own)], ["id", "end"])))
        return same, lists


def _byte_signs() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def coder(byte_level: str, pieces: str) -> Coder:
    """One pair of tokenizers for each Python worker."""
    return Coder(byte_level, pieces)


def _packed(doc_ids: list[int | None], numbers: list[array]) -> bytes:
    starts = np.zeros(len(numbers) + 1, np.int32)
    np.cumsum([len(ks) for ks in numbers], out=starts[1:])
    every = np.concatenate([np.frombuffer(ks, np.int32) for ks in numbers if ks] or [np.zeros(0, np.int32)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _NUMBERS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(starts), pa.array(every))], schema=_NUMBERS))
    return sink.getvalue().to_pybytes()


def _unpacked(payloads: pa.ChunkedArray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's stretches by their numbers."""
    for payload in payloads:
        for batch in pa.ipc.open_stream(payload.as_buffer()):
            starts, every = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                yield doc_id, every[starts[i] : starts[i + 1]]


_BLOCKS = "block long, part int, payload binary, k int, stretch string"


def blocks(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Documents in blocks, compressed, and the different stretches of each block: two kinds of rows.

    ``block, part, payload`` has documents in order, each by the numbers of its
    stretches, ``block, k, stretch`` the stretches of a block, numbered as they
    first occur.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = coder(byte_level, pieces).stretches
        names = ["block", "part", "payload", "k", "stretch"]
        number, part, size, held = TaskContext.get().partitionId() << 32, 0, 0, 0
        known: dict[str, int] = defaultdict(count().__next__)
        doc_ids: list[int | None] = []
        numbers: list[array] = []

        def payload() -> pa.RecordBatch:
            row = [pa.array([number], pa.int64()), pa.array([part], pa.int32()), pa.array([_packed(doc_ids, numbers)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())]
            return pa.RecordBatch.from_arrays(row, names)

        def told() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(range(i, i + n), pa.int32()), pa.array(some, pa.string())], names)

        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                t = value.as_py() or ""
                if size and size + len(t) > block:
                    if numbers:
                        yield payload()
                    yield from told()
                    number, part, size, held = number + 1, 0, 0, 0
                    known, doc_ids, numbers = defaultdict(count().__next__), [], []
                numbers.append(array("i", map(known.__getitem__, split(t))))
                doc_ids.append(doc_id.as_py())
                size, held = size + len(t), held + len(t)
                if held > _PART or len(numbers) >= 10_000:
                    yield payload()
                    part, held, doc_ids, numbers = part + 1, 0, [], []
        if numbers:
            yield payload()
        yield from told()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).transform(bounded).mapInArrow(work, _BLOCKS)


_CODED = "deal int, key long, same boolean, a array<struct<id:int,end:int>>, b array<struct<id:int,end:int>>, blocks array<long>, ks array<int>"


def encode_stretches(uses: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row for each different stretch of ``block, k, stretch``.

    It has a number (``key``) and a share (``deal``) that it was dealt by, whether both tokenizers give the stretch's bytes
    (``same``), its tokens, and the blocks with their numbers for it. Equal stretches lie one after the other, a batch at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = TaskContext.get().partitionId() << 40, None
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks() if held or batch else None
            if rows is None or not rows.num_rows:
                continue
            words = rows.column("stretch").combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(words[1:], words[:-1])) + 1, [len(words)]])
            if batch is not None:
                # the last stretch may go on in the next batch
                held = rows.slice(starts[-2]).combine_chunks().to_batches()[0]
                starts = starts[:-1]
            n = len(starts) - 1
            if not n:
                continue
            same, lists = coder(byte_level, pieces).encode(words.take(pa.array(starts[:-1])).to_pylist())
            deals = rows.column("deal").combine_chunks().take(pa.array(starts[:-1]))
            used = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows.column(c).combine_chunks().slice(0, starts[-1])) for c in ("block", "k")]
            yield pa.RecordBatch.from_arrays([deals, pa.array(np.arange(key, key + n)), pa.array(same), *lists, *used], ["deal", "key", "same", "a", "b", "blocks", "ks"])
            key += n

    n = partitions(uses.sparkSession)
    dealt = uses.select("block", "k", "stretch", F.pmod(F.xxhash64("stretch"), F.lit(n * _SHARES)).cast("int").alias("deal"))
    return dealt.repartition(n, "deal").sortWithinPartitions("deal", "stretch").transform(bounded).mapInArrow(work, _CODED)


@contextmanager
def _sorted_once(spark: SparkSession) -> Iterator[None]:
    """Rows that lie together by some of a join's keys are not shuffled again for all of them; lists are collected in the order that joins need."""
    names = ["spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.useObjectHashAggregateExec"]
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


@contextmanager
def _bucketed(rows: DataFrame, key: str) -> Iterator[DataFrame]:
    """``rows``, which lie together by ``key``, as a table whose files are dealt by it, for as long as it is needed."""
    spark, n, name = rows.sparkSession, partitions(rows.sparkSession), f"stretches_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, key).option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def tokens(coded: DataFrame, side: str) -> DataFrame:
    """``deal, key, pos, id, end``: the tokens of one side, and the byte at which each ends."""
    return coded.select("deal", "key", F.posexplode(side)).select("deal", "key", "pos", "col.id", "col.end")


def grouped_tokens(own: DataFrame, other: DataFrame) -> DataFrame:
    """``deal, key, g, pos, id``: the tokens of one side with the number of cuts before them in their stretch.

    A cut is where a token of the other side ends at the same byte.
    """
    cuts = other.select("deal", "key", "end", F.lit(1).alias("cut"))
    before = Window.partitionBy("deal", "key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return own.join(cuts, ["deal", "key", "end"], "left").withColumn("g", F.coalesce(F.sum("cut").over(before), F.lit(0))).select("deal", "key", "g", "pos", "id")


def _listed(grouped: DataFrame, side: str) -> DataFrame:
    """``deal, key, g`` and the ids of a group on one side, in order."""
    return grouped.groupBy("deal", "key", "g").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda t: t["id"].cast("string")).alias(side))


def align_stretches(coded: DataFrame) -> DataFrame:
    """``deal, key, groups``: all groups of a stretch as ``a1,a2|b1;a3|b2,b3``.

    Stretches whose bytes the tokenizers don't give back have no rows. All joins and
    windows work on rows that were dealt by ``deal`` once.
    """
    whole = coded.where("same")
    a, b = tokens(whole, "a"), tokens(whole, "b")
    both = _listed(grouped_tokens(a, b), "a").join(_listed(grouped_tokens(b, a), "b"), ["deal", "key", "g"])
    text = F.concat(F.array_join("a", ","), F.lit("|"), F.array_join("b", ","))
    groups = F.sort_array(F.collect_list(F.struct("g", text.alias("text"))))
    return both.groupBy("deal", "key").agg(groups.alias("groups")).select("deal", "key", F.array_join("groups.text", ";").alias("groups"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """As :func:`written`, packed tighter."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _spread(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The values of some lists, one list after the other."""
    sizes = starts[which + 1] - starts[which]
    return values[np.repeat(starts[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Told:
    """What a block is told about its stretches: by number, their groups; each different group is read once."""

    def __init__(self, n: int, ks: list[int], groups: pa.ChunkedArray):
        self.groups: list[str | None] = [None] * n
        for k, text in zip(ks, groups.to_pylist()):
            self.groups[k] = text
        self.whole = np.array([text is not None for text in self.groups], bool)
        known: dict[str, int] = defaultdict(count().__next__)
        ids, self.starts = array("i"), np.zeros(n + 1, np.int64)
        for k, text in enumerate(self.groups):
            if text is not None:
                ids.extend(map(known.__getitem__, text.split(";")))
            self.starts[k + 1] = len(ids)
        self.ids = np.array(ids, np.int32)
        pairs = array("q")
        self.figures, self.pair_starts = np.ones((len(known), 4), np.int64), np.zeros(len(known) + 1, np.int64)
        for i, group in enumerate(known):
            left, right = (list(map(int, side.split(","))) for side in group.split("|"))
            pairs.extend([x << 32 | y for x in left for y in right])
            self.figures[i] = len(left), len(right), 1, len(left) * len(right)
            self.pair_starts[i + 1] = len(pairs)
        self.pairs = np.array(pairs, np.int64)

    def figures_of(self, ks: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Of a document with these stretches: ``n_a, n_b, n_groups, n_links``, its different pairs, and how often it has each."""
        found, times = np.unique(_spread(self.ids, self.starts, ks), return_counts=True)
        sizes = self.pair_starts[found + 1] - self.pair_starts[found]
        pairs, place = np.unique(_spread(self.pairs, self.pair_starts, found), return_inverse=True)
        often = np.bincount(place, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
        return (times @ self.figures[found]).tolist(), pairs, often


_FIRST = "block long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,times:long>>"
_FIRST_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
_FIRST_NAMES = ["block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]


def first_trip(parts: DataFrame, told: DataFrame) -> DataFrame:
    """For each document its groups' figures, its different pairs, and how often it has each of them."""

    def work(block: pa.Table, known: pa.Table) -> pa.Table:
        block = block.sort_by("part")
        number = block.column("block")[0].as_py() if block.num_rows else 0
        table = Told(known.num_rows, known.column("k").to_pylist(), known.column("groups"))
        del known
        tables: list[pa.Table] = []
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, none = 0, np.zeros(0, np.int64)

        def add_up() -> None:
            nonlocal rows, held, size
            starts = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(pairs) for pairs, _ in held], out=starts[1:])
            columns = [np.concatenate([none, *(h[i] for h in held)]) for i in (0, 1)]
            pairs = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["pair", "times"]))
            figures = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, _FIRST_TYPES)]
            tables.append(pa.Table.from_arrays([*figures, pairs], _FIRST_NAMES))
            rows, held, size = [], [], 0

        for at, (doc_id, ks) in enumerate(_unpacked(block.column("payload"))):
            if not len(ks) or not table.whole[ks].all():
                rows.append((number, at, doc_id, 0, 0, 0, 0, ""))
                held.append((none, none))
                continue
            figures, *pairs = table.figures_of(ks)
            rows.append((number, at, doc_id, *figures, hashlib.sha256(";".join([table.groups[k] for k in ks.tolist()]).encode()).hexdigest()))
            held.append(tuple(pairs))
            size += len(pairs[0])
            if size > _HELD_PAIRS:
                add_up()
        add_up()
        return pa.concat_tables(tables)

    return parts.groupBy("block").cogroup(told.toDF(*told.columns).groupBy("block")).applyInArrow(work, _FIRST)


def pair_counts(first: DataFrame) -> DataFrame:
    """``a, b, docs, best``: the documents that hold a pair, and whether no pair of its A id is held by more."""
    counts = written(first.select(F.inline("pairs")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pair-counts")
    counts = counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "docs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return written(counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-ranks")


def document_sums(first: DataFrame, counts: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``block, at, n_best, count_sum`` over the links of a document.

    Up to a checked number of pairs their counts are broadcast; beyond, documents'
    pairs meet them by pair, where frequent pairs are dealt out.
    """
    key = (F.col("a").cast("long") * 2**32 + F.col("b")).alias("pair")
    counts = counts.select(key, "docs", F.col("best").cast("long").alias("best"))
    links = first.select("block", "at", F.inline("pairs"))
    if counts.count() <= most_rows:
        found = links.join(F.broadcast(counts), "pair")
    else:
        uses = links.groupBy("pair").agg(F.count(F.lit(1)).alias("uses"))
        found = join_groups(links, uses.join(counts, "pair"), "pair", "uses", links.count())
    return found.groupBy("block", "at").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum"))


def _tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _round() -> Column:
    return F.pmod(F.xxhash64("block"), F.lit(ROUNDS)).cast("int").alias("round")


@contextmanager
def _told(uses: DataFrame, byte_level: str, pieces: str) -> Iterator[DataFrame]:
    """``block, k, groups`` written once, by round, for as long as it is needed: no round joins all stretches again."""
    spark, name = uses.sparkSession, f"told_{uuid.uuid4().hex}"
    with _sorted_once(spark), _bucketed(encode_stretches(uses, byte_level, pieces), "deal") as coded:
        _tidy(spark)
        found = coded.select("deal", "key", F.arrays_zip("blocks", "ks").alias("uses")).join(align_stretches(coded), ["deal", "key"], "left")
        told = found.select(F.explode("uses").alias("use"), "groups").select(F.col("use.blocks").alias("block"), F.col("use.ks").alias("k"), "groups")
        told.select("*", _round()).write.partitionBy("round").option("compression", "zstd").saveAsTable(name)
    _tidy(spark)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _in_rounds(payload: DataFrame, told: DataFrame, trip: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> DataFrame:
    """A trip of some of the blocks after the other: what is shuffled at a time takes less disk."""
    parts = []
    for i in range(ROUNDS):
        parts.append(_kept(trip(payload.where(_round() == i), told.where(F.col("round") == i).drop("round")), name))
        _tidy(payload.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", block: int = BLOCK, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A is the byte-level vocabulary with a space before the text, B the piece
    vocabulary, which adds the space itself; strings of special tokens are plain
    text. ``n_links`` counts the pairs of token occurrences that share a group.
    The count of an id pair is how many documents hold it linked; ``count_sum``
    adds these over the links, ``n_best`` counts the links whose pair has the
    highest count of its A id, ties included.

    Null and empty texts, and those whose bytes the tokenizers don't give back,
    have zeros and an empty digest. Long texts are a block of their own, whole.
    Repeated rows count as documents each; doc_id may be missing or repeated.
    Other columns are not read; an empty table gives no rows.
    """
    parts = _kept(blocks(docs, byte_level, pieces, text, block), "token-blocks")
    payload = parts.where("payload IS NOT NULL").select("block", "part", "payload")
    with _told(parts.where("stretch IS NOT NULL").select("block", "k", "stretch"), byte_level, pieces) as told:
        first = _in_rounds(payload, told, lambda p, t: first_trip(p, t), "token-first")
    sums = document_sums(first, pair_counts(first), most_rows)
    found = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return first.join(sums, ["block", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *found, "groups_sha256")
