"""Exact deduplication with two passes of Bloom filtering, in DataFrame functions alone.

Pass 1 counts filter cells. A document sets one of 2**40 cells, chosen by the
hash of its text. A task's share of so large a bit array is nearly empty (as many
bits as it has documents), so a task hands on the cells that it has set, each
once, and these small rows are merged instead of arrays. Cells set twice or more
go into a second filter of 64-bit words, three bits for a cell, with about twelve
bits of room for each: its size follows from their number.

Pass 2 asks that filter about each document. Up to a proven size every task has
the whole filter; a larger one is joined by word, against digests without texts.
Documents that it doesn't know pass straight through. The others shuffle and are
grouped by the digest of their whole text, so a false alarm costs a little and
changes nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Pass 1 has 2**40 cells: with 3e10 documents 3 % of unique texts share one.
CELL_BITS = 40
#: Room in the second filter for each of its cells.
BITS = 12
#: A filter of more words than this, of 16 bytes each, is not broadcast but joined.
FILTER_WORDS = 1 << 20


class Filter(NamedTuple):
    """Rows ``word, bits``; ``words`` is how many words there can be."""

    table: DataFrame
    words: int


def normalised(text: str = "text") -> Column:
    """The text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return F.regexp_replace(text_or_empty(text), "[\\x20\\x09-\\x0D]+", "")


def cell_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - CELL_BITS)


def _word(cell: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(cell, F.lit("word")), F.lit(words))


def _mask(cell: Column) -> Column:
    bits = F.xxhash64(cell, F.lit("bits"))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, n).bitwiseAND(63).cast("int")) for n in (0, 6, 12)]
    return masks[0].bitwiseOR(masks[1]).bitwiseOR(masks[2])


def repeated_filter(keys: DataFrame) -> Filter:
    """The second filter of pass 1 for the column ``key``: the cells that are set more than once."""
    cells = keys.select(cell_of(F.col("key")).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    return _filter(written(cells, "filter-cells"))


def member_filter(keys: DataFrame) -> Filter:
    """A Bloom filter of the column ``key``, in the same form."""
    return _filter(written(keys.select(cell_of(F.col("key")).alias("cell")).distinct(), "filter-cells"))


def _filter(cells: DataFrame) -> Filter:
    words = 1 << max(6, (cells.count() * BITS // 64).bit_length())
    return Filter(written(cells.groupBy(_word(F.col("cell"), words).alias("word")).agg(F.bit_or(_mask(F.col("cell"))).alias("bits")), "filter-words"), words)


def with_alarm(rows: DataFrame, key: Column, known: Filter, most_words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` with a column ``alarm``: False if the filter certainly lacks ``key``."""
    cell = cell_of(key)
    asked = rows.withColumns({"_word": _word(cell, known.words), "_mask": _mask(cell)})
    words = known.table.withColumnRenamed("word", "_word").withColumnRenamed("bits", "_bits")
    return (
        asked.join(F.broadcast(words) if known.words <= most_words else words, "_word", "left")
        .withColumn("alarm", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
        .drop("_word", "_mask", "_bits")
    )


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with their group (one row a key), safe for groups of any size.

    A group of more than a ten-thousandth of all rows is dealt out: its rows by a
    hash of theirs, its one row to every share. That makes at most 10,000 more
    rows; only the keys of such groups and their numbers of shares, at most
    10,000 small rows, are broadcast.
    """
    least = max(1000, -(-n_rows // 10_000))
    sized = groups.withColumn("_shares", F.greatest(F.lit(1), F.floor(F.col(size) / least)).cast("int"))
    hot = F.broadcast(sized.where("_shares > 1").select(key, "_shares"))
    share = F.coalesce(F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.col("_shares")), F.lit(0)).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_share", share).drop("_shares")
    spread = sized.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return dealt.join(spread, [key, "_share"]).drop("_share")


def exact_duplicates(docs: DataFrame, text: str = "text", most_words: int = FILTER_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after :func:`normalised`; null counts as empty.
    Of equal texts the one with the most code points (as it is) stays, then that
    of the smallest doc_id; a missing doc_id comes last. Of rows repeated in all
    of this, the first read stays. ``kept`` holds for exactly one row of a group.
    Long texts are normalised and hashed whole where they are read. Other columns
    are not read; an empty table gives no rows. Texts are not shuffled, only
    digests.
    """
    keyed = written(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(normalised(text), 256)).alias("key"),
            F.length(text_or_empty(text)).alias("points"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "text-digests",
    )
    asked = with_alarm(keyed, F.col("key"), repeated_filter(keyed), most_words)
    unique = asked.where("NOT alarm").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "key")
    rows = asked.where("alarm").drop("alarm")
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("least"), F.bitwise_not("row").alias("row"))).alias("best")
    groups = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), best), "text-groups")
    groups = groups.select("key", "group_size", F.bitwise_not("best.least").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"))
    grouped = join_groups(rows, groups, "key", "group_size", keyed.count())
    grouped = grouped.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "key")
    return unique.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", most_words: int = FILTER_WORDS) -> DataFrame:
    """The rows of ``docs`` without those that :func:`exact_duplicates` would drop.

    All columns stay. Rows of texts that occur once are filtered where they are
    read; only the others are shuffled, one row per text and task.
    """
    keyed = docs.select(F.unhex(F.sha2(normalised(text), 256)).alias("key"), F.struct(*docs.columns).alias("row"))
    asked = with_alarm(keyed, F.col("key"), repeated_filter(keyed.select("key")), most_words)
    order = F.struct(F.length(text_or_empty(f"row.{text}")), F.bitwise_not("row.doc_id"), F.xxhash64("row"))
    kept = asked.where("alarm").groupBy("key").agg(F.max(F.struct(order.alias("order"), F.col("row").alias("row"))).alias("best"))
    return asked.where("NOT alarm").select("row.*").unionByName(kept.select("best.row.*"))
