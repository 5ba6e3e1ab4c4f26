"""Tables that describe a corpus and its graph: counts, shares, pages, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunks_by_source(chunks: DataFrame) -> DataFrame:
    """``source, n, total``; chunks without a source as (unknown)."""
    counts = chunks.groupBy(F.coalesce("source", F.lit("(unknown)")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a source


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``nodes, edges``."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))  # one row each


def relation_histogram(edges: DataFrame) -> DataFrame:
    """``type, n, percent``."""
    counts = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # one row a type


def label_histogram(nodes: DataFrame) -> DataFrame:
    """``label, n``; a node of several labels (parted by |) counts for each."""
    return nodes.select(F.explode(F.split("label", r"\|")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def legend_counts(edges: DataFrame, label: Column) -> DataFrame:
    """``label, n``: the different ends of all edges by a label that ``label`` makes of their ``id``."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends.distinct(), "id", "left_anti")


def inverse_pairs(edges: DataFrame) -> DataFrame:
    """``src, dst, type_a, type_b``: what is said from src to dst and, by another relation, back; each once."""
    a = edges.select("src", "dst", F.col("type").alias("type_a"))
    b = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("type").alias("type_b"))
    return a.join(b, ["src", "dst"]).where("type_a < type_b")


def page_offsets(chunks: DataFrame, size: int = 20) -> DataFrame:
    """``chunk_id, source, page_offset``: on which page of its source's chunks, by chunk_id, each one stands."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("chunk_id")) - 1
    return chunks.select("chunk_id", "source", (F.floor(place / size) * size).cast("long").alias("page_offset"))


def page_of(chunks: DataFrame, source: str, offset: int, size: int = 20) -> DataFrame:
    """One page of a source's chunks, by chunk_id."""
    return chunks.where(F.col("source") == source).orderBy("chunk_id").offset(offset).limit(size)


def first_pages(chunks: DataFrame, more: int = 1) -> DataFrame:
    """Chunks on the first page of their source, or at most ``more`` after it."""
    first = chunks.groupBy("source").agg(F.min("page").alias("_first"))
    return chunks.join(first, "source").where(F.col("page") <= F.col("_first") + more).drop("_first")


def collections(rows: DataFrame, column: str = "collection", hidden: str = "_entities") -> DataFrame:
    """``collection, n`` without the collections whose name ends in ``hidden``."""
    return rows.where(~F.col(column).endswith(hidden)).groupBy(F.col(column).alias("collection")).agg(F.count(F.lit(1)).alias("n"))
