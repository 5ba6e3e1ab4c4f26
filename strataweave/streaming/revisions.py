"""Document revisions that arrive as files, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import maintain
from ..sources.shared import written
from ..sources.snapshots import SnapshotStore

SCHEMA = "doc_id long, version long, source string, text string"


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of revisions written as JSON lines into a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """Of each document the last version in a batch."""
    return batch.groupBy("doc_id").agg(F.max_by(F.struct("version", "source", "text"), F.col("version")).alias("r")).select("doc_id", "r.*")


def apply(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``update(last versions, batch number)`` for each micro-batch of what is there, then stops."""
    return stream.writeStream.foreachBatch(lambda df, n: update(latest(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(store: SnapshotStore, chunker: Callable[[DataFrame], DataFrame], extract, stream: str = "revisions") -> Callable[[DataFrame, int], None]:
    """What brings the tables of a store up to a batch's revisions, exactly once.

    ``chunker`` makes ``chunk_id, source, page, text`` of ``doc_id, source,
    text``; a revision without text takes its document away. The graph, the
    chunks and the ledger's row of the batch are one commit: a batch that comes
    again after a failure is skipped if the commit was made, and is made anew if
    it was not. A version older than one applied before is passed over.
    """

    def update(batch: DataFrame, number: int) -> None:
        if store.has(stream, number):
            return
        tables = store.tables()
        known = tables.pop("versions")
        fresh = latest(batch).join(known.withColumnRenamed("version", "_known"), "doc_id", "left").where("_known IS NULL OR version > _known").drop("_known")
        fresh = written(fresh, "fresh-revisions")
        versions = known.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh.select("doc_id", "version"))
        chunks = chunker(fresh.where("text IS NOT NULL").select("doc_id", "source", "text"))
        after = maintain.update_documents(tables, fresh.select("source"), chunks, extract)
        store.commit(stream, number, {**after, "versions": versions})

    return update


def begun(store: SnapshotStore, tables: dict[str, DataFrame], stream: str = "revisions") -> bool:
    """Puts the first tables (chunks, mentions, edges, nodes) into a store; False if there are some."""
    versions = store.spark.createDataFrame([], "doc_id long, version long")
    return store.commit(stream, -1, {**tables, "versions": versions})


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of time, late ones dropped; works on streams and tables (``ts, event_type``)."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
