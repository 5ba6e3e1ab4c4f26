"""The property graph as DataFrames.

nodes     ``id, label`` and properties such as ``name, aliases, pagerank``
edges     ``src, type, dst, source_chunks array<string>, extraction_count long``
mentions  ``chunk_id, node_id``
chunks    ``chunk_id, source, page, text``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

EDGE_KEY = ["src", "type", "dst"]
ADMIN_LABELS = ["ProcessedChunk", "SchemaMeta", "GraphProvenance"]
FACT_LABELS = ["CondFact", "Cond"]


def _flag(nodes: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in nodes.columns else F.lit(False)


def entities(nodes: DataFrame, facts: bool = False) -> DataFrame:
    """Nodes that stand for things: no administration, hash ids, values or anaphora; facts if asked."""
    hidden = ADMIN_LABELS + ([] if facts else FACT_LABELS)
    is_entity = F.col("id").isNotNull() & ~F.col("label").isin(hidden) & ~F.col("id").rlike(r"\A[0-9a-f]{32,}\z")
    return nodes.where(is_entity & ~_flag(nodes, "is_value") & ~_flag(nodes, "is_anaphor"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: ``a, b`` and the edge's columns with an ``edge_id``; a self-loop once."""
    keyed = edges.withColumn("edge_id", F.concat_ws("|", *EDGE_KEY))
    ends = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")))).otherwise(
        F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    )
    return keyed.withColumn("_ends", F.explode(ends)).select("*", "_ends.a", "_ends.b").drop("_ends")


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, type, dst): counts summed (null as 1), source chunks united and sorted."""
    chunks = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_chunks", F.array())))))
    return edges.groupBy(*EDGE_KEY).agg(F.sum(F.coalesce("extraction_count", F.lit(1))).alias("extraction_count"), chunks.alias("source_chunks"))


def attach_source_chunks(triples: DataFrame) -> DataFrame:
    """Extracted triples (``src, type, dst, chunk_id``) as edges: one count an extraction, each chunk once."""
    return triples.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("extraction_count"), F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"))


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends moved by ``old, new``; edges that become loops through it are dropped, the rest merged."""
    a, b = (mapping.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")) for c in ("src", "dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left")
    changed = F.col("new_src").isNotNull() | F.col("new_dst").isNotNull()
    src, dst = F.coalesce("new_src", "src"), F.coalesce("new_dst", "dst")
    return merged_edges(moved.where(~(changed & (src == dst))).select(src.alias("src"), "type", dst.alias("dst"), "extraction_count", "source_chunks"))


def settled(mapping: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``old, new`` with chains followed to their end (a to b and b to c: a to c); each round doubles the steps.

    A circle has no end: not settling in ``most_rounds`` is an error.
    """
    for _ in range(most_rounds):
        step = mapping.select(F.col("old").alias("new"), F.col("new").alias("next"))
        moved = mapping.join(step, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "settled")
        mapping = moved.drop("moved")
        if moved.where("moved").limit(1).count() == 0:
            return mapping
    raise RuntimeError(f"the mapping has chains that do not end in {most_rounds} rounds")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``ids`` (column ``id``) and the edges at them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows of equal keys replaced by those of ``changes``, new ones added."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def delete_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without *all* edges from ``src`` to ``dst`` of ``pairs``."""
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*edges.columns)


def relabel(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the label of ``changes`` (``id, label``)."""
    new = changes.groupBy("id").agg(F.max("label").alias("_label"))
    return nodes.join(new, "id", "left").withColumn("label", F.coalesce("_label", "label")).select(*nodes.columns)
