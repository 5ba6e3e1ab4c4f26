"""Collocations by level-wise passes in the manner of Apriori.

Pass k counts phrases of k words. It is told which phrases of k - 1 words are
frequent and counts a phrase only if both of those that it overlaps are: a phrase
is never more frequent than its parts. What is told is a bit array of fixed
greatest size (:data:`MOST_BITS`), filled from the level's table by Spark and
broadcast. A bit set by another phrase lets a phrase through to be counted; its
exact count then decides, so the size of the array changes cost and no result.

A task counts a slice of texts at a time with numpy and hands on each phrase of
the slice once; Spark adds the counts up before and after the shuffle. Scores,
cuts and the choice among overlapping phrases are joins of the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, partitions, slices, written

#: Bits for each frequent phrase, up to the greatest size of an array (16 MB).
BITS, MOST_BITS = 16, 1 << 27
#: A language that is missing.
NO_LANGUAGE = "und"
_SLICE = 4_000_000
_ROWS = 100_000
# A to Z in lower case; what ends a piece becomes a line feed
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_COUNTS = "lang string, phrase string, n long"
_SEED = 42  # of Spark's xxhash64


def _chained(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte integers, each with a seed of its own, as ``F.xxhash64`` goes on from column to column."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    h = seeds + p5 + np.uint64(8)
    h = turned(h ^ (turned(values * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


class Slice:
    """The words of some texts: a number for each, its piece and its language.

    Phrases of the level at hand are numbered too: ``code`` has the number of the
    phrase that begins at each word (-1: none), ``parts`` the words of each.
    """

    def __init__(self, texts: list[str], langs: list[str]):
        coded = [t.encode() for t in texts]
        data = b"\n".join(coded).translate(_FOLD)
        points = np.frombuffer(data, np.uint8)
        between = (points == 32) | (points == 10)
        starts = ~between
        starts[1:] &= between[:-1]
        at = np.flatnonzero(starts)
        self.piece = np.cumsum(points == 10)[at]
        numbers, names = pd.factorize(np.array(langs, object))
        ends = np.cumsum([len(c) + 1 for c in coded])
        spoken = numbers[np.searchsorted(ends, at, "right")]
        words = np.empty(len(at), object)
        words[:] = data.split()
        codes, different = pd.factorize(words)
        self.names = pa.array([name.encode() for name in names], pa.binary())
        self.words = pa.array(different, pa.binary())
        #: Words are told apart by language: of each, its language, its number among all words, its hash.
        pairs, self.first = np.unique(codes * len(names) + spoken, return_inverse=True)
        self.lang, self.word = pairs % max(1, len(names)), pairs // max(1, len(names))
        seeds = [xxhash.xxh64_intdigest(name.encode(), _SEED) for name in names]
        self.hash = np.fromiter((xxhash.xxh64_intdigest(different[w], seeds[n]) for n, w in zip(self.lang.tolist(), self.word.tolist())), np.uint64, len(pairs))
        self.code, self.parts = self.first, [np.arange(len(pairs))]

    def keep(self, frequent: np.ndarray) -> None:
        """Forgets the phrases of this level that are not in a bit array."""
        place = np.full(len(self.parts[0]), _SEED, np.uint64)
        for part in self.parts:
            place = _chained(self.hash[part], place)
        place = (place & np.uint64(len(frequent) * 64 - 1)).astype(np.int64)
        known = (frequent[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        if len(known):
            self.code = np.where((self.code >= 0) & known[np.maximum(self.code, 0)], self.code, -1)

    def longer(self) -> None:
        """Goes on to phrases of one word more whose overlapping parts are both kept."""
        code, size = self.code, len(self.parts)
        ends = np.arange(size, len(code))
        begins = ends - size
        valid = (code[begins] >= 0) & (code[begins + 1] >= 0) & (self.piece[begins] == self.piece[ends])
        begins, ends = begins[valid], ends[valid]
        width = max(1, len(self.hash))
        keys, found = np.unique(code[begins] * width + self.first[ends], return_inverse=True)
        self.code = np.full(len(code), -1, np.int64)
        self.code[begins] = found
        self.parts = [*(part[keys // width] for part in self.parts), keys % width]

    def counts(self) -> Iterator[pa.RecordBatch]:
        n = np.bincount(self.code[self.code >= 0], minlength=len(self.parts[0]))
        for i in range(0, len(n), _ROWS):
            parts = [part[i : i + _ROWS] for part in self.parts]
            spelled = [self.words.take(pa.array(self.word[part])) for part in parts]
            phrases = pc.binary_join_element_wise(*spelled, b" ") if len(spelled) > 1 else spelled[0]
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(self.lang[parts[0]])).cast(pa.string()), phrases.cast(pa.string()), pa.array(n[i : i + _ROWS], pa.int64())], ["lang", "phrase", "n"])


def level(docs: DataFrame, size: int, frequent: list[Broadcast], text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, n``: how often each phrase of ``size`` words occurs; ``frequent`` has the bit arrays of all lower levels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, texts in slices(batch, 0, _SLICE):
                held = Slice(texts, langs[at : at + len(texts)])
                for bits in frequent:
                    held.keep(np.frombuffer(bits.value, np.uint64))
                    held.longer()
                yield from held.counts()

    read = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    return read.transform(bounded).mapInArrow(count, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_array(frequent: DataFrame, size: int) -> Broadcast:
    """A bit array of the phrases of ``size`` words of a table, broadcast as 64-bit words; its greatest size is fixed."""
    spark = frequent.sparkSession
    bits = min(MOST_BITS, 1 << max(10, (frequent.count() * BITS - 1).bit_length()))
    words = F.split("phrase", " ", -1)
    place = F.xxhash64(*(F.xxhash64("lang", F.element_at(words, i + 1)) for i in range(size))).bitwiseAND(bits - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    filled = frequent.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    array = np.zeros(bits // 64, np.int64)
    array[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    return spark.sparkContext.broadcast(array.tobytes())


def level_tables(docs: DataFrame, words: int, min_count: int, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """The tables of phrases of 1 to ``words`` words, written; those of 2 and more have only frequent phrases."""
    tables: list[DataFrame] = []
    frequent: list[Broadcast] = []
    for size in range(1, words + 1):
        found = level(docs, size, frequent, text, lang)
        tables.append(written(found if size == 1 else found.where(F.col("n") >= min_count), f"phrases-{size}"))
        if size < words:
            frequent.append(bit_array(tables[-1].where(F.col("n") >= min_count), size))
    for bits in frequent:
        bits.unpersist()
    return tables


def _words(phrase: Column, begin: int, size: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), begin, size), " ")


def scored(tables: list[DataFrame], min_count: int) -> DataFrame:
    """Candidates ``lang, phrase, size, a, l, r, score`` with their lowest-scoring cut, of ties the first.

    ``score`` is floor(1000000 * a * a / (l * r)) in integers of up to 38 digits.
    """
    frequent = [t.where(F.col("n") >= min_count) for t in tables]
    out = []
    for size, table in enumerate(frequent[1:], 2):
        rows = table.withColumnRenamed("n", "a")
        for cut in range(1, size):
            for side, part, begin, length in (("l", frequent[cut - 1], 1, cut), ("r", frequent[size - cut - 1], cut + 1, size - cut)):
                name = f"{side}{cut}"
                rows = rows.withColumn("part", _words(F.col("phrase"), begin, length))
                rows = rows.join(part.select("lang", F.col("phrase").alias("part"), F.col("n").alias(name)), ["lang", "part"]).drop("part")
        cuts = [
            F.struct(
                F.expr(f"(1000000 * cast(a AS decimal(16, 0)) * cast(a AS decimal(16, 0))) div (cast(l{k} AS decimal(19, 0)) * cast(r{k} AS decimal(19, 0)))").alias("score"),
                F.lit(k).alias("cut"),
                F.col(f"l{k}").alias("l"),
                F.col(f"r{k}").alias("r"),
            )
            for k in range(1, size)
        ]
        best = F.least(*cuts) if size > 2 else cuts[0]
        out.append(rows.withColumn("best", best).select("lang", "phrase", F.lit(size).alias("size"), "a", "best.l", "best.r", "best.score"))
    return reduce(DataFrame.unionByName, out)


def _covered(tables: list[DataFrame], min_count: int, share: int) -> DataFrame:
    """``lang, phrase, longest``: phrases within longer candidates, and the highest count of those."""
    parts = []
    for size, table in enumerate(tables[1:], 2):
        for length in range(2, size):
            for begin in range(1, size - length + 2):
                parts.append(table.where(F.col("n") >= min_count).select("lang", _words(F.col("phrase"), begin, length).alias("phrase"), F.col("n").alias("longest")))
    return reduce(DataFrame.unionByName, parts).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))


def collocations(docs: DataFrame, words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts, A to Z in lower case, end a piece at ``.,;:!?`` and line ends; words
    are what is between spaces and tabs. A candidate has 2 to ``words`` words and
    occurs ``a >= min_count`` times within pieces, overlaps counted. Of its cuts
    in two the lowest-scoring counts (ties: the first). A candidate goes if a
    longer one that contains it has ``share`` percent of its occurrences or more.
    Order: score and count descending, then phrase by its bytes. ``n`` counts all
    words of the language.

    Null texts are empty, a null language is ``und``; repeated rows count each
    time; doc_id and other columns are not read; an empty table gives no rows.
    Long texts are counted whole, one at a time. Rows are chosen in two rounds,
    first within shares of a language, so no language goes to one task whole.
    """
    tables = level_tables(docs, words, min_count, text, lang)
    totals = tables[0].groupBy("lang").agg(F.sum("n").alias("n"))
    found = scored(tables, min_count)
    if words > 2:
        found = found.join(_covered(tables, min_count, share), ["lang", "phrase"], "left").where(f"longest IS NULL OR 100 * longest < {share} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = Window.partitionBy("lang", "deal").orderBy(*order)
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    dealt = dealt.withColumn("place", F.row_number().over(deal)).where(F.col("place") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
