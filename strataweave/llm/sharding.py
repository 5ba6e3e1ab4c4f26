"""Sharding by jump consistent hashing, in DataFrame functions alone.

The walk of jumps does not depend on the number of shards: with n shards a key
lies where the last jump below n went. One walk so answers for n and n + 1
shards, and a key moves only if a jump of its walk is n itself, that is into
the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, written

_MULTIPLIER = "2862933555777941757"


def _state(key: Column) -> Column:
    """The key as an unsigned 64-bit number."""
    wide = key.cast("decimal(38,0)")
    return F.when(wide < 0, wide + F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(wide).cast("decimal(38,0)")


def _step(state: Column) -> Column:
    """The next state of the generator, modulo 2**64. Products stay below 10**38."""
    product = state.cast("decimal(20,0)") * F.lit(_MULTIPLIER).cast("decimal(19,0)")
    return ((product.cast("decimal(38,0)") + F.lit(1).cast("decimal(38,0)")) % F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(38,0)")


def jump_shards(key: Column, shards: int) -> Column:
    """A struct ``shard`` and ``grown_shard``: the shard of ``key`` among ``shards`` and ``shards + 1``.

    Null keys are taken as 0. At most ``shards`` jumps below the limit exist, as
    each goes further than the one before.
    """
    start = F.struct(_state(F.coalesce(key, F.lit(0))).alias("state"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("shard"), F.lit(0).alias("grown"))

    def jump(held: Column, _: Column) -> Column:
        state = _step(held["state"])
        high = F.floor(state / F.lit("8589934592").cast("decimal(38,0)")).cast("double")
        to = F.floor((held["at"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1.0))).cast("long")
        moved = F.struct(
            state.alias("state"),
            to.alias("at"),
            F.when(to < shards, to.cast("int")).otherwise(held["shard"]).alias("shard"),
            F.when(to <= shards, to.cast("int")).otherwise(held["grown"]).alias("grown"),
        )
        return F.when(held["at"] > shards, held).otherwise(moved)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump)
    return F.struct(walk["shard"].alias("shard"), walk["grown"].alias("grown_shard"))


def assign_shards(docs: DataFrame, shards: int = 16, rows_per_cell: int = 250_000, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's bytes plus 1 (null: 1) and ``text_crc32`` that of its
    UTF-8 bytes (null: of none). The law is ``key``: doc_id and the number of
    shards decide. ``slot`` counts a shard's rows
    from 0 without gaps, by doc_id (missing ones first), then by the other
    columns. A shard may be larger than a task can hold, so rows are dealt into
    cells by ranges of that order; each cell is ranked alone and starts where the
    cells before it end. Cells grow in number with the rows, not in size. Equal
    rows get different slots. A missing doc_id counts as key 0. Long texts are
    only measured and summed; no text is shuffled.
    """
    keyed = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_shards(F.col("doc_id"), shards).alias("walk"),
    ).select("doc_id", "size", "text_crc32", "walk.shard", "walk.grown_shard")
    order = ["doc_id", "text_crc32", "size"]
    cells = max(partitions(docs.sparkSession), -(-docs.count() // rows_per_cell))
    keyed = written(written(keyed, "shard-rows").repartitionByRange(cells, "shard", *order).withColumn("cell", F.spark_partition_id()), "shard-cells")
    # a row for each shard and cell: one for every rows_per_cell documents
    counts = keyed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order))
    return (
        keyed.withColumn("rank", rank)
        .join(firsts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )
