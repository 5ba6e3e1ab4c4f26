"""Enrichment and consolidation steps in the order in which a graph needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import enrich, model, paths


def enriched(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, light: bool = False) -> DataFrame:
    """Nodes (``id, aliases, canonical_form`` and more) with ``mention_count, norm_id, search_keys``, and ``pagerank`` unless ``light``.

    The light form is for updates of single documents: it keeps the ranks that
    nodes have; new ones are null.
    """
    old = [c for c in ("mention_count", "norm_id", "search_keys") if c in nodes.columns]
    rows = nodes.drop(*old).join(enrich.mention_counts(nodes, mentions), "id", "left").join(enrich.search_keys(nodes), "id", "left")
    if not light:
        return rows.drop("pagerank").join(enrich.pagerank(model.entities(nodes), edges), "id", "left")
    return rows if "pagerank" in rows.columns else rows.withColumn("pagerank", F.lit(None).cast("double"))


def with_canonical_relations(edges: DataFrame, choices: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """Edges with the chosen schema relation (``type, candidate, chosen``) for their type, merged; protected types stay."""
    new = choices.where("chosen").where(~F.col("type").isin(protected or [])).groupBy("type").agg(F.min("candidate").alias("_new"))
    return model.merged_edges(edges.join(F.broadcast(new), "type", "left").withColumn("type", F.coalesce("_new", "type")))  # one row a relation of the schema


def consolidated(nodes: DataFrame, edges: DataFrame, schema: list[str] | None = None, choices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, aliases, is_value`` and edges after the merges that follow a build.

    In order: nodes of one id become one, spelling variants in kana go to the
    most linked, relations are normalised, then (``choices``) put under those of
    a schema. Enrich again afterwards.
    """
    none = nodes.select(F.col("id").alias("old"), F.col("id").alias("new")).limit(0)
    once, edges = enrich.merge_nodes(nodes, edges, none)
    degree = once.select("id").join(paths.degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    once, edges = enrich.merge_nodes(once, edges, enrich.kana_mapping(degree))
    edges = enrich.normalize_relations(edges, schema)
    if choices is not None:
        edges = with_canonical_relations(edges, choices, schema)
    return enrich.flag_values(once), edges


def with_dictionary(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and mentions after merging what a dictionary names, taking over its properties, and light enrichment."""
    degree = nodes.select("id").distinct().join(paths.degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    mapping = enrich.dictionary_mapping(degree, entries).select("old", "new")
    merged, edges = enrich.merge_nodes(nodes, edges, mapping)
    moved = mentions.join(mapping.withColumnRenamed("old", "node_id"), "node_id", "left").select("chunk_id", F.coalesce("new", "node_id").alias("node_id")).distinct()
    named = enrich.apply_dictionary(merged.withColumn("canonical_form", F.lit(None).cast("string")), entries)
    return enriched(named, edges, moved, light=True), edges, moved
