"""Counts, ranks, keys and flags that enrich a graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.shared import written
from .model import EDGE_KEY, entities, merged_edges, rewire

# Old type -> new type, and whether the direction turns.
RELATION_RULES: dict[str, tuple[str, bool]] = {
    "BELONGS_TO_CATEGORY": ("IS_A", False),
    "HAS_VALUE": ("HAS_ATTRIBUTE", False),
    "MEASURED_IN": ("HAS_ATTRIBUTE", False),
    "MITIGATES": ("PREVENTS", False),
    "DEPENDS_ON": ("REQUIRES", False),
    "COVERS": ("APPLIES_TO", False),
    "TARGETS": ("APPLIES_TO", False),
    "OPERATED_BY": ("MANAGED_BY", False),
    "GOVERNED_BY": ("MANAGED_BY", False),
    "PUBLISHED_BY": ("ISSUED_BY", False),
    "ENACTED_BY": ("ISSUED_BY", False),
    "REQUIRES_BEFORE": ("FOLLOWS", False),
    "REQUIRED_BEFORE": ("FOLLOWS", False),
    "RELATES_TO": ("RELATED_TO", False),
    "MANAGES_BY": ("MANAGED_BY", False),
    "DEFINES_BY": ("DEFINED_BY", False),
    "DESCRIBES_IN": ("DESCRIBED_IN", False),
    "HAS_PART": ("PART_OF", True),
    "PRECEDES": ("FOLLOWS", True),
    "USED_BY": ("USES", True),
    "REQUIRED_BY": ("REQUIRES", True),
    "CONTAINS": ("PART_OF", True),
    "INCLUDES": ("PART_OF", True),
    "DEFINES": ("DEFINED_BY", True),
    "DESCRIBES": ("DESCRIBED_IN", True),
    "MANAGES": ("MANAGED_BY", True),
    "GOVERNS": ("MANAGED_BY", True),
}


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees that checkpoints have a folder: the session's, or in one JVM alone (tests) a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strataweave-"))


def mention_counts(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """``id, mention_count``: different chunks that mention a node, 0 kept."""
    counts = mentions.groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("chunk_id").alias("mention_count"))
    return nodes.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("mention_count", F.lit(0)).alias("mention_count"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, most_rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """``id, pagerank`` over the directed graph with parallel edges as one.

    The rank of nodes without outgoing edges is spread over all. Stops when the
    ranks change by less than nodes times ``tolerance`` in all; without a
    tolerance after ``most_rounds``. Not getting there is an error.
    Nodes are numbered once; the links stay where they are, dealt by source, and
    the ranks of each round are written, as the next one reads them thrice.
    """
    ids = written(nodes.select("id").distinct().withColumn("key", F.monotonically_increasing_id()), "rank-ids")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    end = lambda c: ids.select(F.col("id").alias(c), F.col("key").alias(f"{c}_key"))
    links = edges.select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
    links = written(links, "rank-links")
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    held = links.join(out, "src").repartition("src").persist()
    held.count()
    ranks = written(ids.join(out.withColumnRenamed("src", "key"), "key", "left").select("key", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")), "ranks")
    settled = False
    for _ in range(most_rounds):
        loose = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        given = held.join(ranks.select(F.col("key").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        new = ranks.join(given, "key", "left").crossJoin(F.broadcast(loose))  # one row
        new = written(new.select("key", "dangling", F.col("rank").alias("old"), (F.lit((1 - alpha) / n) + alpha * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n)).alias("rank")), "ranks")
        ranks = new.select("key", "dangling", "rank")
        if tolerance is not None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0] < n * tolerance:
            settled = True
            break
    held.unpersist()
    if tolerance is not None and not settled:
        raise RuntimeError(f"the ranks still changed after {most_rounds} rounds")
    return ids.join(ranks, "key").select("id", F.col("rank").alias("pagerank"))


def search_keys(nodes: DataFrame, normalize=tx.normalize_entity) -> DataFrame:
    """``id, norm_id, search_keys``: normal forms of id, aliases and canonical form, then their kana skeletons, each once."""
    given = F.concat(F.array("id"), F.coalesce("aliases", F.array()), F.array("canonical_form"))
    rows = nodes.select("id", F.posexplode(given).alias("at", "key")).where("key IS NOT NULL").withColumn("key", normalize(F.col("key")))
    plain = rows.select("id", "at", "key")
    kana = rows.select("id", (F.col("at") + 1_000_000).alias("at"), tx.kana_skeleton(F.col("key")).alias("key"))
    keys = plain.unionByName(kana).where(F.col("key") != "").groupBy("id", "key").agg(F.min("at").alias("at"))
    listed = keys.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("k"))
    return listed.select("id", F.element_at("k", 1)["key"].alias("norm_id"), F.transform("k", lambda x: x["key"]).alias("search_keys"))


def flag_values(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("is_value", tx.is_value(F.col("id")))


def normalize_relations(edges: DataFrame, schema: list[str] | None = None) -> DataFrame:
    """Edges by :data:`RELATION_RULES`, merged; with a schema only types that it lacks change, and only into its own."""
    rules = {k: v for k, v in RELATION_RULES.items() if schema is None or (k not in schema and v[0] in schema)}
    if not rules:
        return merged_edges(edges)
    table = F.create_map(*(x for k, (new, turn) in rules.items() for x in (F.lit(k), F.struct(F.lit(new).alias("new"), F.lit(turn).alias("turn")))))
    rule = F.try_element_at(table, F.col("type"))
    turned = F.coalesce(F.col("rule.turn"), F.lit(False))
    ruled = edges.withColumn("rule", rule)
    return merged_edges(
        ruled.select(
            F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"),
            F.coalesce("rule.new", "type").alias("type"),
            F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"),
            "extraction_count",
            "source_chunks",
        )
    )


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids of several nodes: ``id, n, labels``."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("label")).alias("labels")).where("n > 1")


def keepers(nodes: DataFrame, edges_degree: DataFrame, group: str) -> DataFrame:
    """``old, new``: every node of a group but the one of the highest degree (then the smallest key) goes to that one."""
    ranked = nodes.join(edges_degree.withColumnRenamed("id", "node_key"), "node_key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = ranked.groupBy(group).agg(F.min_by("node_key", F.struct(-F.col("degree"), F.col("node_key"))).alias("new"))
    return ranked.join(best, group).where("node_key <> new").select(F.col("node_key").alias("old"), "new")


def merge_nodes(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, aliases`` merged by ``old, new``: labels and aliases united, old ids added as aliases."""
    named = nodes.join(mapping.withColumnRenamed("old", "id"), "id", "left").withColumn("target", F.coalesce("new", "id"))
    own = F.when(F.col("new").isNotNull(), F.array("id")).otherwise(F.array().cast("array<string>"))
    rows = named.groupBy(F.col("target").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set("label")), "|").alias("label"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(own, F.coalesce("aliases", F.array())))))).alias("aliases"),
    )
    return rows, rewire(edges, mapping)


def kana_mapping(nodes: DataFrame) -> DataFrame:
    """``old, new`` of entities that differ in kana only, joined through pairs of one skeleton; the most linked stays.

    ``nodes`` needs ``id, degree``. Pairs are formed within a skeleton only.
    """
    keyed = entities(nodes.withColumn("label", F.lit(""))).select("id", "degree", tx.normalize_entity("id").alias("norm")).withColumn("skeleton", tx.kana_skeleton(F.col("norm"))).where("skeleton <> ''")
    a, b = keyed.select("skeleton", F.col("id").alias("a"), F.col("norm").alias("na")), keyed.select("skeleton", F.col("id").alias("b"), F.col("norm").alias("nb"))
    pairs = a.join(b, "skeleton").where("a < b").where((F.col("na") == F.col("nb")) | tx.is_kana_variant("na", "nb")).select("a", "b")
    groups = connected(pairs)
    ranked = groups.join(keyed.select(F.col("id").alias("node"), "degree"), "node")
    best = ranked.groupBy("component").agg(F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("new"))
    return ranked.join(best, "component").where("node <> new").select(F.col("node").alias("old"), "new")


def connected(pairs: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``node, component`` (its smallest node): nodes of ``a, b`` go into their smallest neighbours, then edges between what is left.

    Each round writes the edges between different roots, each once: at least
    half of the nodes that have edges are no roots, so edges shrink. Not settling in
    ``most_rounds`` is an error.
    """
    edges = written(pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "component-edges")
    found = None
    for _ in range(most_rounds):
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _roots(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), most_rounds)
        if found is None:
            found = roots.select("node", F.col("root").alias("component"))
        else:
            found = found.join(roots.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        # one end at a time: what is equal by then moves once
        half = edges.where("a <> b").join(roots.select(F.col("node").alias("a"), "root"), "a").select(F.col("root").alias("a"), "b").distinct()
        whole = half.join(roots.select(F.col("node").alias("b"), "root"), "b").select("a", F.col("root").alias("b")).where("a <> b")
        edges = written(whole.distinct(), "component-edges")
        found = written(found, "components")
        if edges.limit(1).count() == 0:
            return found
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _roots(steps: DataFrame, most_rounds: int) -> DataFrame:
    """``node, root``: steps to smaller nodes followed to their end, twice as far each round."""
    for _ in range(most_rounds):
        steps = written(steps, "component-roots")
        onward = steps.where("node <> root").join(steps.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").where("further <> root")
        if onward.limit(1).count() == 0:
            return steps
        steps = steps.join(onward.select("node", "further"), "node", "left").select("node", F.coalesce("further", "root").alias("root"))
    raise RuntimeError(f"components have chains that do not end in {most_rounds} rounds")


def direct_clusters(pairs: DataFrame, scores: DataFrame, most: int = 5) -> DataFrame:
    """``old, new`` without chains: a node goes to the best of its direct partners, if that goes nowhere itself.

    Best: highest pagerank, then mention count, then shortest id. Clusters of
    more than ``most`` nodes are dropped.
    """
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    all_ = both.unionByName(both.select("id", F.col("id").alias("other"))).distinct()
    value = F.struct(F.coalesce("pagerank", F.lit(0.0)), F.coalesce("mention_count", F.lit(0)), -F.length("other"), F.col("other"))
    best = all_.join(scores.select(F.col("id").alias("other"), "pagerank", "mention_count"), "other", "left").groupBy("id").agg(F.max_by("other", value).alias("new"))
    roots = best.where("id = new").select("new")
    moves = best.where("id <> new").join(roots, "new", "left_semi")
    small = moves.groupBy("new").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 <= most)
    return moves.join(small, "new", "left_semi").select(F.col("id").alias("old"), "new")


def dictionary_mapping(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """``old, new, canonical`` of nodes that a dictionary entry names (``canonical, aliases``).

    A node of the canonical name stays, else the most linked (``degree``); the
    others go to it. A node that several entries name belongs to the first by
    canonical name.
    """
    keys = entries.select("canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array()))).alias("id"))
    hits = nodes.select("id", "degree").distinct().join(keys, "id").groupBy("id", "degree").agg(F.min("canonical").alias("canonical"))
    best = hits.groupBy("canonical").agg(F.min_by("id", F.struct((F.col("id") != F.col("canonical")).cast("int"), -F.col("degree"), F.col("id"))).alias("new"))
    return hits.join(best, "canonical").where("id <> new").select(F.col("id").alias("old"), "new", "canonical")


def apply_dictionary(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes of canonical names with the entry's properties; what the entry lacks is cleared, other nodes stay."""
    fields = ["aliases", "category", "definition", "notes"]
    own = entries.groupBy(F.col("canonical").alias("id")).agg(*(F.max(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    joined = nodes.join(own, "id", "left")
    missing = {"aliases": F.lit(None).cast("array<string>")}
    old = lambda c: F.col(c) if c in nodes.columns else missing.get(c, F.lit(None).cast("string"))
    return joined.select(*(c for c in nodes.columns if c not in fields), *(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(old(c)).alias(c) for c in fields))


def dictionary_status(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each entry the number of nodes it names: merge_candidate (2 or more), matched or unmatched."""
    keys = entries.select("canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array()))).alias("id"))
    hits = keys.join(nodes.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left").groupBy("canonical").agg(F.count("hit").alias("n"))
    return hits.select("canonical", "n", F.when(F.col("n") >= 2, "merge_candidate").when(F.col("n") == 1, "matched").otherwise("unmatched").alias("status"))


def resolve_anaphora(nodes: DataFrame, mentions: DataFrame, chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, formal, is_anaphor``: an alias that all documents mentioning it resolve to one name; else whether it is one.

    ``aliases`` has ``source, alias, formal``.
    """
    sources = mentions.join(chunks.select("chunk_id", "source"), "chunk_id").select(F.col("node_id").alias("id"), "source").distinct()
    named = sources.join(aliases.select("source", F.col("alias").alias("id"), "formal"), ["id", "source"], "left")
    agreed = named.groupBy("id").agg(F.when((F.count_distinct("formal") == 1) & (F.count("formal") == F.count(F.lit(1))), F.max("formal")).alias("formal"))
    return nodes.select("id").distinct().join(agreed, "id", "left").select("id", "formal", (F.col("formal").isNull() & tx.is_anaphor(F.col("id"))).alias("is_anaphor"))


def canonical_relations(similar: DataFrame, least: float = 0.8, shortlist: int = 3) -> DataFrame:
    """``type, candidate, rank, chosen``: schema relations by similarity (``type, candidate, score``), the first if near enough."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "candidate"))
    return similar.withColumn("rank", rank).where(F.col("rank") <= shortlist).withColumn("chosen", (F.col("rank") == 1) & (F.col("score") >= least))


def once(edges: DataFrame, order: Column, keys: list[str] = EDGE_KEY) -> DataFrame:
    """The first edge of each (src, type, dst), or of other keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return edges.withColumn("_n", rank).where("_n = 1").drop("_n")
