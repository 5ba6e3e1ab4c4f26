"""Path search, subgraphs and what is pulled along paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .containment import containing
from .model import undirected

#: Paths kept by number of hops, candidates after parsing, start nodes.
PATHS_BY_HOP = {1: 30, 2: 50, 3: 80}
START_NODES = 20


def start_nodes(nodes: DataFrame, keys: DataFrame, most: int = START_NODES) -> DataFrame:
    """``question_id, id`` of at most ``most`` nodes whose search keys contain a question's key.

    ``keys`` has ``question_id, key``; a node without search keys has its id in
    lower case. Exact matches come first, then higher pagerank, then id. Terms
    and keys meet by their grams (:func:`~.containment.containing`).
    """
    own = F.coalesce(F.col("search_keys"), F.array(F.lower("id"))) if "search_keys" in nodes.columns else F.array(F.lower("id"))
    rank = F.col("pagerank") if "pagerank" in nodes.columns else F.lit(0.0)
    terms = nodes.select("id", rank.alias("pagerank"), F.explode(own).alias("term"))
    pairs = containing(terms.select(F.col("term").alias("text")), keys).withColumnRenamed("text", "term")
    hits = terms.join(pairs, "term").join(keys.select("question_id", "key").distinct(), "key")
    best = hits.groupBy("question_id", "id").agg(F.max((F.col("term") == F.col("key")).cast("int")).alias("exact"), F.max(F.coalesce("pagerank", F.lit(0.0))).alias("pagerank"))
    order = Window.partitionBy("question_id").orderBy(F.desc("exact"), F.desc("pagerank"), "id")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("question_id", "id")


def trails(edges: DataFrame, starts: DataFrame, hops: int, blocked: DataFrame | None = None, group: list[str] | None = None) -> DataFrame:
    """Walks of 1 to ``hops`` edges from ``starts`` (column ``id``) that use no edge twice.

    Nodes may repeat, but an end differs from its start. ``blocked`` nodes
    (column ``id``) may be ends, not starts or between. Columns: ``group``'s,
    ``nodes, types, edge_ids, strength`` (sum of extraction counts, null as 1).
    One join a hop; blocked nodes are dropped before they are walked on.
    """
    group = group or []
    step = undirected(edges).select("a", "b", "type", "edge_id", F.coalesce("extraction_count", F.lit(1)).cast("double").alias("weight"))
    inner = (lambda df, c: df.join(blocked.select(F.col("id").alias(c)).distinct(), c, "left_anti")) if blocked is not None else (lambda df, c: df)
    walk = inner(starts, "id").select(*group, F.array("id").alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("edge_ids"), F.lit(0.0).alias("strength"), F.col("id").alias("a"))
    found = None
    for hop in range(hops):
        walk = (inner(walk, "a") if hop else walk).join(step, "a").where(~F.array_contains("edge_ids", F.col("edge_id")))
        walk = walk.select(
            *group,
            F.concat("nodes", F.array("b")).alias("nodes"),
            F.concat("types", F.array("type")).alias("types"),
            F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"),
            (F.col("strength") + F.col("weight")).alias("strength"),
            F.col("b").alias("a"),
        )
        ended = walk.where(F.col("a") != F.element_at("nodes", 1)).drop("a")
        found = ended if found is None else found.unionByName(ended)
    return found


def one_hop(edges: DataFrame, starts: DataFrame, hidden_ends: DataFrame | None = None, group: list[str] | None = None) -> DataFrame:
    """Edges at the start nodes, loops too: ``start, type, end, extraction_count`` as walked."""
    step = undirected(edges)
    found = starts.select(*(group or []), F.col("id").alias("a")).join(step, "a")
    if hidden_ends is not None:
        found = found.join(hidden_ends.select(F.col("id").alias("b")).distinct(), "b", "left_anti")
    return found.select(*(group or []), F.col("a").alias("start"), "type", F.col("b").alias("end"), F.coalesce("extraction_count", F.lit(1)).alias("extraction_count"))


def scored(walks: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Walks with ``length``, ``mean_strength`` (by edge) and ``mean_rank`` (pagerank by node, null as 0)."""
    walks = walks.withColumn("length", F.size("types")).withColumn("mean_strength", F.col("strength") / F.size("types"))
    if nodes is None:
        return walks.withColumn("mean_rank", F.lit(0.0))
    keyed = walks.withColumn("walk", F.concat_ws(">", "edge_ids", F.element_at("nodes", 1)))
    ranks = keyed.select("walk", F.explode("nodes").alias("id")).join(nodes.select("id", "pagerank"), "id").groupBy("walk").agg(F.sum("pagerank").alias("rank"))
    return keyed.join(ranks, "walk", "left").withColumn("mean_rank", F.coalesce("rank", F.lit(0.0)) / (F.col("length") + 1)).drop("walk", "rank")


def best_paths(walks: DataFrame, most: int, group: list[str] | None = None) -> DataFrame:
    """The best ``most`` different paths (by nodes and types) of each group, with a ``rank``."""
    text = F.concat_ws(">", "nodes", F.lit("#"), "types")
    group = group or []
    once = walks.withColumn("_text", text).groupBy(*group, "_text").agg(*(F.first(c).alias(c) for c in ("nodes", "types", "length")), F.max("mean_strength").alias("mean_strength"), F.max("mean_rank").alias("mean_rank"))
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("mean_strength"), F.desc("mean_rank"), "_text")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_text")


def path_triples(paths: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The different triples of ranked paths in order of first appearance: ``start, type, end, ordinal``."""
    steps = F.posexplode(F.arrays_zip(F.col("nodes").alias("start"), F.col("types").alias("type"), F.slice("nodes", 2, 1_000_000_000).alias("end")))
    rows = paths.select(*(group or []), "rank", steps.alias("pos", "t")).where("t.type IS NOT NULL").select(*(group or []), "rank", "pos", "t.*")
    return rows.groupBy(*(group or []), "start", "type", "end").agg(F.min(F.col("rank") * 1000 + F.col("pos")).alias("ordinal"))


def chunks_of_triples(triples: DataFrame, edges: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks that the triples were extracted from, whatever their direction: ``chunk_id`` and the chunk's columns."""
    pair = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    known = edges.where(F.col("source_chunks").isNotNull()).select(*pair("src", "dst"), "type", "source_chunks")
    ids = triples.select(*pair("start", "end"), "type").distinct().join(known, ["lo", "hi", "type"]).select(F.explode("source_chunks").alias("chunk_id")).distinct()
    found = chunks.join(ids, "chunk_id", "left_semi")
    return found if most is None else found.orderBy("chunk_id").limit(most)


def chunks_of_entities(names: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """Chunks that mention most of the named nodes: ``chunk_id, entities``."""
    hits = mentions.join(names.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    return hits.groupBy("chunk_id").agg(F.count_distinct("node_id").alias("entities")).orderBy(F.desc("entities"), "chunk_id").limit(most)


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: edges at a node, a self-loop once."""
    return undirected(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def overview(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Edges with their ends' labels and degrees, the strongest ends first."""
    edges = written(edges.select("src", "type", "dst"), "overview-edges")
    ends = nodes.select("id", "label").join(degrees(edges), "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    a, b = (ends.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"), F.col("degree").alias(f"{c}_degree")) for c in ("src", "dst"))
    joined = edges.select("src", "type", "dst").join(a, "src", "left").join(b, "dst", "left")
    return joined.orderBy(F.desc(F.col("src_degree") + F.col("dst_degree")), "src", "type", "dst").limit(most)


def ego(edges: DataFrame, centres: DataFrame, hops: int, strict: bool = False) -> DataFrame:
    """Edges around the centres (column ``id``): those at nodes within ``hops``, or (strict) only those leaving reached nodes."""
    edges = written(edges.select("src", "type", "dst"), "ego-edges")
    step = undirected(edges).select("a", "b").distinct()
    frontier, reached = centres.select("id").distinct(), None
    for _ in range(hops):
        frontier = frontier.withColumnRenamed("id", "a").join(step, "a").select(F.col("b").alias("id")).distinct()
        reached = frontier if reached is None else reached.unionByName(frontier).distinct()
    inside = reached if strict else reached.unionByName(centres.select("id")).distinct()
    leaving = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi")
    if not strict:
        leaving = leaving.unionByName(edges.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return leaving.select("src", "type", "dst").distinct()


def with_labels(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples with the label of either end (of several the first by name)."""
    label = nodes.groupBy("id").agg(F.min("label").alias("label"))
    a, b = (label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_type")) for c in ("start", "end"))
    return triples.join(a, "start", "left").join(b, "end", "left")


def search_nodes(nodes: DataFrame, text: str, most: int) -> DataFrame:
    """Ids that contain ``text`` whatever the case, the shortest first; ``most`` is held to 1 to 500."""
    return nodes.where(F.contains(F.lower("id"), F.lit(text.lower()))).select("id").distinct().orderBy(F.length("id"), "id").limit(max(1, min(500, most)))




def display_edges(triples: DataFrame) -> DataFrame:
    """Triples with both ends, types that miss as Unknown, each once."""
    there = (F.coalesce("start", F.lit("")) != "") & (F.coalesce("end", F.lit("")) != "")
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    kinds = [named(c).alias(c) for c in ("start_type", "end_type") if c in triples.columns]
    return triples.where(there).select("start", named("type").alias("type"), "end", *kinds).distinct()


def incident_triples(edges: DataFrame, starts: DataFrame, most: int = 20) -> DataFrame:
    """What path search falls back to: directed edges at a start node on either end, in a fixed order."""
    ids = starts.select("id").distinct()
    hit = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return hit.select(F.col("src").alias("start"), "type", F.col("dst").alias("end")).distinct().orderBy("start", "type", "end").limit(most)
