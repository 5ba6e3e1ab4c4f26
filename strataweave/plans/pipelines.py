"""The two large jobs: building a graph from documents, and retrieving for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors
from ..operators import chunking, conditions, enrich, hooks, maintain, model, paths, references, retrieval

#: Extracts triples ``src, type, dst, chunk_id`` and mentions ``chunk_id, node_id`` from chunks.
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Graph:
    chunks: DataFrame
    mentions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    references: DataFrame | None = None
    facts: DataFrame | None = None
    #: Relation documents ``relation_id, start, type, end, embedding`` for the route by themes.
    relations: DataFrame | None = None


def build(documents: DataFrame, extract: Extractor, embedder: hooks.Embedder | None = None, processed: DataFrame | None = None, schema: list[str] | None = None, rank: bool = True) -> Graph:
    """Documents (``source, text``, optionally ``page``) to chunks, mentions, nodes and edges.

    In order: chunk and deduplicate, leave out processed chunks, extract, merge,
    normalise relations, link references, resolve anaphora, enrich. Figures are
    chunks but nothing is extracted from them.
    """
    pieces = chunking.markdown_chunks(documents)
    keyed = pieces.withColumn("chunk_id", tx.chunk_id(F.col("source"), F.col("text"))).dropDuplicates(["chunk_id"])
    chunks = keyed.select("chunk_id", "source", F.col("ordinal").alias("page"), F.concat_ws(" > ", "h1", "h2", "h3").alias("section"), "text", tx.tokens(F.col("text")).alias("tokens"))
    if processed is not None:
        chunks = maintain.pending(chunks, processed)
    if embedder is not None:
        chunks = hooks.embedded(chunks, embedder)
    triples, mentions = extract(chunks)
    edges = enrich.normalize_relations(model.attach_source_chunks(triples), schema)
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).unionByName(mentions.select(F.col("node_id").alias("id"))).distinct()
    nodes = enrich.flag_values(ids.select("id", F.lit("Term").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("canonical_form")))
    found = references.inventory(chunks)
    links, _ = references.extract(chunks, found)
    resolved = enrich.resolve_anaphora(nodes, mentions, chunks, found["aliases"])
    nodes = nodes.join(resolved, "id", "left").withColumn("canonical_form", F.coalesce("canonical_form", "formal")).drop("formal")
    nodes = nodes.join(enrich.mention_counts(nodes, mentions), "id", "left").join(enrich.search_keys(nodes), "id", "left")
    if rank:
        nodes = nodes.join(enrich.pagerank(model.entities(nodes), edges), "id", "left")
    else:
        nodes = nodes.withColumn("pagerank", F.lit(0.0))
    return Graph(chunks, mentions, nodes, edges, links)


@dataclass
class Options:
    mode: str = "hybrid"
    k: int = 5
    pool: int = 20
    hops: int = 1
    relation_k: int = 15
    follow_references: bool = False
    use_conditions: bool = False
    graph_lines: bool = True
    fallback_entities: int = 5
    theme_relations: int = 8
    extra: dict = field(default_factory=dict)


def retrieve(graph: Graph, questions: DataFrame, options: Options | None = None, themes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents, paths, triples and the context for each question (``question_id, text, names, embedding``).

    Everything is ranked by question in one plan; ``names`` are the entity names
    that a model found in it. The graph is entered in three ways: at the nodes of
    these names; through relations near the question's themes (``themes``, a
    table ``question_id, embedding``, and the graph's ``relations``); and, for a
    question whose names lead nowhere, at nodes that hold one of its words.
    ``mode`` none searches the graph alone. A followed reference adds chunks of
    the documents referred to that the keyword search ranks best. What later
    steps read several times (start nodes, paths, ranked documents; a bounded
    number a question) is checkpointed once.
    """
    enrich.checkpoint_folder(questions.sparkSession)
    o = options or Options()
    docs = graph.chunks.select(F.col("chunk_id").alias("id"), "text", "source", "page")
    searched = None
    if o.mode != "none":
        keyword = retrieval.bm25(docs, questions, o.pool)
        vector = None
        if "embedding" in graph.chunks.columns:
            numbered = graph.chunks.select(F.xxhash64("chunk_id").alias("vec_id"), "chunk_id", "embedding")
            near = vectors.top_k(numbered, questions.select(F.col("question_id").alias("query_id"), "embedding"), o.pool)
            vector = near.join(numbered.select("vec_id", "chunk_id"), "vec_id").select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("id"), "score", "rank")
        found = retrieval.search(o.mode if vector is not None else "keyword", vector if vector is not None else keyword, keyword, o.pool)
        texts = found.select("question_id", "id", "rank").join(docs.select("id", "text"), "id")
        searched = retrieval.rerank(texts, retrieval.overlap_scores(texts, questions), o.k, o.pool).checkpoint()
    keys = retrieval.match_keys(questions)
    alive = model.entities(graph.nodes)
    starts = paths.start_nodes(alive, keys).checkpoint()
    lost = questions.join(starts.select("question_id").distinct(), "question_id", "left_anti")
    starts = starts.unionByName(retrieval.keyword_entities(alive, lost, o.fallback_entities).select("question_id", "id").checkpoint())
    blocked = graph.nodes.where("is_value") if "is_value" in graph.nodes.columns else None
    walks = paths.trails(graph.edges, starts, o.hops, blocked, ["question_id"])
    best = paths.best_paths(paths.scored(walks, graph.nodes.select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))), paths.PATHS_BY_HOP.get(o.hops, 80), ["question_id"])
    best = best.where(F.col("rank") <= o.relation_k).withColumn("path_text", tx.path_text(F.col("nodes"), F.col("types"))).checkpoint()
    triples = paths.path_triples(best, ["question_id"])
    if themes is not None and graph.relations is not None:
        near = retrieval.theme_relations(graph.relations, themes, triples, o.theme_relations)
        after = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("theme_score"), "start", "type", "end")) + 1_000_000
        triples = triples.unionByName(near.select(*(after.cast("int").alias(c) if c == "ordinal" else c for c in triples.columns)))
    routes = []
    if searched is not None:
        routes.append(("documents", searched.join(docs.select("id", "text"), "id").select("question_id", "text", "rank")))
    named = starts.join(graph.mentions.withColumnRenamed("node_id", "id"), "id").groupBy("question_id", "chunk_id").agg(F.count_distinct("id").cast("double").alias("score"))
    by_graph = retrieval.ranked(named.withColumnRenamed("chunk_id", "id"), o.k).join(docs.select("id", F.substring("text", 1, 2000).alias("text")), "id")
    routes.append(("graph", by_graph.select("question_id", "text", "rank")))
    if o.follow_references and graph.references is not None and searched is not None:
        hits = searched.join(docs, "id").select("question_id", "source", "page")
        followed = references.follow(hits, graph.chunks, graph.references).join(graph.chunks.select("chunk_id", "text"), "chunk_id")
        routes.append(("references", followed.select("question_id", "text", F.lit(1).alias("rank"))))
        targets = followed.join(graph.chunks.select("text", "source"), "text").groupBy("question_id", "source").agg(F.lit(1).alias("ordinal"))
        within = retrieval.scoped(keyword.join(docs.select("id", "source"), "id"), targets, o.k).join(docs.select("id", "text"), "id")
        routes.append(("referred documents", within.select("question_id", "text", "rank")))
    documents = retrieval.merged_documents(*routes)
    lines = None
    if o.graph_lines or o.mode == "none":
        sources = graph.mentions.join(graph.chunks.select("chunk_id", "source"), "chunk_id").select(F.col("node_id").alias("id"), "source")
        own = retrieval.graph_lines(best, sources, ["question_id"])
        none = questions.select("question_id").join(own.select("question_id").distinct(), "question_id", "left_anti")
        lines = own.unionByName(none.select("question_id", F.lit(0).alias("place"), F.lit("(グラフデータなし)").alias("text")))
    facts = None
    if o.use_conditions and graph.facts is not None:
        facts = conditions.block(conditions.route(questions, graph.facts)).select("question_id", F.col("block").alias("text"), F.lit(1).alias("place"))
    return {"documents": documents, "paths": best, "triples": triples, "context": retrieval.context(documents, lines, facts)}


def answer(graph: Graph, questions: DataFrame, language_model: hooks.LanguageModel, options: Options | None = None) -> DataFrame:
    """``question_id, answer, context``: the context goes to the model in batches."""
    found = retrieve(graph, questions, options)["context"]
    prompts = questions.select("question_id", "text").join(found, "question_id", "left").withColumn("prompt", F.concat_ws("\n\n", "context", "text"))
    return hooks.completed(prompts, language_model, "prompt").select("question_id", "answer", "context")


def sample_for_schema(chunks: DataFrame, documents: int, each: int) -> DataFrame:
    """The first ``each`` chunks of the first ``documents`` sources, to discover a vocabulary from."""
    first = chunks.select("source").distinct().orderBy("source").limit(documents)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("page", "chunk_id"))
    return chunks.join(F.broadcast(first), "source").withColumn("n", rank).where(F.col("n") <= each).drop("n")


def schema_report(active: DataFrame, configured: dict) -> DataFrame:
    """``domain, version, changed`` of the stamped vocabulary against the configured one."""
    same = (F.col("domain") == configured["domain"]) & (F.col("version") == configured["version"])
    return active.select("domain", "version", (~F.coalesce(same, F.lit(False))).alias("changed"))
