"""Queries of the graph, maintenance and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import enrich, evaluate, linking, maintain, model, paths, reports, retrieval
from ..sources import writers
from .registry import query
from .tables import Tables


@query("SELECT source, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM chunks GROUP BY source")
def source_chunk_counts(t: Tables) -> DataFrame:
    return reports.chunks_by_source(t.chunks)


@query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_stats(t: Tables) -> DataFrame:
    return reports.graph_stats(t.nodes, t.edges)


@query("SELECT n.id, count(DISTINCT m.chunk_id) AS mention_count FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN mentions m ON m.node_id = n.id GROUP BY n.id")
def mention_count(t: Tables) -> DataFrame:
    return enrich.mention_counts(t.nodes, t.mentions)


@query("SELECT a AS id, count(*) AS degree FROM both_ways GROUP BY a ORDER BY degree DESC, id LIMIT 50")
def degree_topk(t: Tables) -> DataFrame:
    return paths.degrees(t.edges).orderBy(F.desc("degree"), "id").limit(50)


@query("SELECT label, count(*) AS n FROM nodes GROUP BY label")
def label_histogram(t: Tables) -> DataFrame:
    return reports.label_histogram(t.nodes)


@query("SELECT type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM edges GROUP BY type")
def relation_histogram(t: Tables) -> DataFrame:
    return reports.relation_histogram(t.edges)


@query("SELECT id, count(*) AS n, list_sort(list(DISTINCT label)) AS labels FROM nodes GROUP BY id HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    return enrich.duplicate_ids(t.nodes)


@query("SELECT label, count(*) AS n FROM nodes ANTI JOIN (SELECT src AS id FROM edges WHERE type = 'USES' UNION ALL SELECT dst FROM edges WHERE type = 'USES') u USING (id) GROUP BY label")
def isolated_nodes(t: Tables) -> DataFrame:
    """Nodes that no sale joins to anything."""
    return reports.label_histogram(reports.isolated(t.nodes, t.edges.where("type = 'USES'")))


@query("""
    SELECT e.src, e.type, e.dst, s.label AS src_label, d.label AS dst_label, a.n AS src_degree, b.n AS dst_degree
    FROM edges e JOIN (SELECT id, min(label) AS label FROM nodes WHERE label = split_part(id, ':', 1) GROUP BY id) s ON s.id = e.src
    JOIN (SELECT id, min(label) AS label FROM nodes WHERE label = split_part(id, ':', 1) GROUP BY id) d ON d.id = e.dst
    JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) a ON a.a = e.src JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) b ON b.a = e.dst
    ORDER BY a.n + b.n DESC, e.src, e.type, e.dst LIMIT 500""")
def overview_edges(t: Tables) -> DataFrame:
    own = t.nodes.where(F.col("label") == F.split_part("id", F.lit(":"), F.lit(1)))
    return paths.overview(own, t.edges, 500)


def _ego_sql(hops: int) -> str:
    steps = ", ".join(f"r{i} AS (SELECT DISTINCT w.b AS id FROM r{i - 1} JOIN both_ways w ON w.a = r{i - 1}.id)" for i in range(1, hops + 1))
    union = " UNION ".join(f"SELECT id FROM r{i}" for i in range(hops + 1))
    return f"+ r0 AS (SELECT 'nation:3' AS id), {steps}, reached AS ({union}) SELECT DISTINCT src, type, dst FROM edges WHERE src IN (SELECT id FROM reached) OR dst IN (SELECT id FROM reached)"


def _ego(t: Tables, hops: int) -> DataFrame:
    return paths.ego(t.edges, t.spark.createDataFrame([("nation:3",)], "id string"), hops)


@query(_ego_sql(1))
def ego_subgraph_1(t: Tables) -> DataFrame:
    return _ego(t, 1)


@query(_ego_sql(2))
def ego_subgraph_2(t: Tables) -> DataFrame:
    return _ego(t, 2)


@query("SELECT DISTINCT id FROM nodes WHERE contains(lower(id), 'nation:1') ORDER BY length(id), id LIMIT 20")
def node_search(t: Tables) -> DataFrame:
    return paths.search_nodes(t.nodes, "Nation:1", 20).select("id")


_STARTS = "('customer:1'), ('customer:2'), ('nation:3')"


def _starts(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("customer:1",), ("customer:2",), ("nation:3",)], "id string")


@query(f"SELECT w.a AS start, w.type, w.b AS \"end\", w.extraction_count FROM both_ways w JOIN (VALUES {_STARTS}) s(id) ON s.id = w.a")
def paths_1hop(t: Tables) -> DataFrame:
    return paths.one_hop(t.edges, _starts(t))


def _trail_sql(hops: int) -> str:
    one = f"t1 AS (SELECT [s.id, w.b] AS nodes, [w.type] AS types, [w.edge_id] AS eids, CAST(w.extraction_count AS DOUBLE) AS strength FROM (VALUES {_STARTS}) s(id) JOIN both_ways w ON w.a = s.id)"
    more = "".join(
        f", t{i} AS (SELECT list_append(t.nodes, w.b) AS nodes, list_append(t.types, w.type) AS types, list_append(t.eids, w.edge_id) AS eids, t.strength + w.extraction_count AS strength"
        f" FROM t{i - 1} t JOIN both_ways w ON w.a = t.nodes[-1] WHERE NOT list_contains(t.eids, w.edge_id))"
        for i in range(2, hops + 1)
    )
    union = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(1, hops + 1))
    return f"+ {one}{more}, trails AS (SELECT * FROM ({union}) WHERE nodes[1] <> nodes[-1])"


_PATH_COLUMNS = " SELECT array_to_string(nodes, ' ') AS nodes, array_to_string(types, ' ') AS types, CAST(len(types) AS INTEGER) AS length, round(strength / len(types), 6) AS mean_strength FROM trails"


def _shown(walks: DataFrame) -> DataFrame:
    s = paths.scored(walks)
    return s.select(F.array_join("nodes", " ").alias("nodes"), F.array_join("types", " ").alias("types"), "length", F.round("mean_strength", 6).alias("mean_strength"))


@query(_trail_sql(2) + _PATH_COLUMNS)
def paths_2hop(t: Tables) -> DataFrame:
    return _shown(paths.trails(t.edges, _starts(t), 2))


@query(_trail_sql(3) + _PATH_COLUMNS)
def paths_3hop(t: Tables) -> DataFrame:
    return _shown(paths.trails(t.edges, _starts(t), 3))


@query(_trail_sql(2) + """ , best AS (SELECT nodes, types, strength / len(types) AS s, array_to_string(nodes, '>') || '>#>' || array_to_string(types, '>') AS k FROM trails),
    top AS (SELECT nodes, types, CAST(row_number() OVER (ORDER BY s DESC, k) AS INTEGER) AS rank FROM (SELECT DISTINCT nodes, types, s, k FROM best) QUALIFY rank <= 50),
    steps AS (SELECT nodes[i] AS start, types[i] AS type, nodes[i + 1] AS "end", rank * 1000 + i - 1 AS o FROM (SELECT *, unnest(range(1, len(types) + 1)) AS i FROM top))
    SELECT start, type, "end", CAST(min(o) AS INTEGER) AS ordinal FROM steps GROUP BY ALL""")
def path_triples(t: Tables) -> DataFrame:
    best = paths.best_paths(paths.scored(paths.trails(t.edges, _starts(t), 2)), 50)
    return paths.path_triples(best)


@query("""SELECT c.chunk_id, c.source FROM order_chunks c WHERE c.chunk_id IN (
    SELECT unnest(source_chunks) FROM edges WHERE type = 'USES' AND src IN ('customer:1', 'customer:2'))""")
def chunk_pull_strict(t: Tables) -> DataFrame:
    some = t.edges.where("type = 'USES' AND src IN ('customer:1', 'customer:2')").select(F.col("dst").alias("start"), "type", F.col("src").alias("end"))
    return paths.chunks_of_triples(some, t.edges.where("type = 'USES'"), t.order_chunks).select("chunk_id", "source")


@query("SELECT chunk_id, count(DISTINCT node_id) AS entities FROM mentions WHERE node_id IN ('customer:1', 'part:1', 'part:2', 'supplier:3') GROUP BY chunk_id ORDER BY entities DESC, chunk_id LIMIT 30")
def chunk_pull_mentions(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("customer:1",), ("part:1",), ("part:2",), ("supplier:3",)], "id string")
    return paths.chunks_of_entities(names, t.mentions, 30)


def _pagerank_sql(rounds: int) -> str:
    steps = ", r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS rank FROM ids)"
    for i in range(1, rounds + 1):
        steps += f""", g{i} AS (SELECT l.dst AS id, sum(r.rank / o.n) AS given FROM links l JOIN r{i - 1} r ON r.id = l.src JOIN outs o ON o.src = l.src GROUP BY l.dst),
        r{i} AS MATERIALIZED (SELECT i.id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * (coalesce(g.given, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} ANTI JOIN outs ON src = id) / (SELECT count(*) FROM ids)) AS rank
            FROM ids i LEFT JOIN g{i} g ON g.id = i.id)"""
    return f"+ ids AS MATERIALIZED (SELECT DISTINCT id FROM nodes), links AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), outs AS (SELECT src, count(*) AS n FROM links GROUP BY src){steps} SELECT id, round(rank, 9) AS pagerank FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank_fixed_rounds(t: Tables) -> DataFrame:
    return enrich.pagerank(t.nodes, t.edges, most_rounds=5, tolerance=None).select("id", F.round("pagerank", 9).alias("pagerank"))


@query()
def pagerank(t: Tables) -> DataFrame:
    return enrich.pagerank(t.nodes, t.edges)


_RULED = """
    SELECT CASE WHEN type = 'HAS_PART' THEN dst ELSE src END AS src,
           CASE type WHEN 'HAS_PART' THEN 'PART_OF' WHEN 'BELONGS_TO_CATEGORY' THEN 'IS_A' ELSE type END AS type,
           CASE WHEN type = 'HAS_PART' THEN src ELSE dst END AS dst,
           CAST(sum(coalesce(extraction_count, 1)) AS BIGINT) AS extraction_count FROM edges GROUP BY ALL"""


@query(_RULED)
def relation_normalize(t: Tables) -> DataFrame:
    return enrich.normalize_relations(t.edges).select("src", "type", "dst", "extraction_count")


_MERGE = """+ mapping AS (SELECT 'part:' || p_partkey AS old, 'part:' || min(p_partkey) OVER (PARTITION BY p_brand) AS new FROM part),
    m AS (SELECT * FROM mapping WHERE old <> new),
    moved AS (SELECT coalesce(a.new, e.src) AS src, e.type, coalesce(b.new, e.dst) AS dst, e.extraction_count, a.new IS NOT NULL OR b.new IS NOT NULL AS changed FROM edges e LEFT JOIN m a ON a.old = e.src LEFT JOIN m b ON b.old = e.dst)
    SELECT src, type, dst, CAST(sum(coalesce(extraction_count, 1)) AS BIGINT) AS extraction_count FROM moved WHERE NOT (changed AND src = dst) GROUP BY ALL"""


@query(_MERGE)
def merge_duplicates(t: Tables) -> DataFrame:
    parts = t.read("part")
    keep = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("keep"))
    key = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    mapping = parts.join(keep, "p_brand").where("p_partkey <> keep").select(key("p_partkey").alias("old"), key("keep").alias("new"))
    return model.rewire(t.edges, mapping).select("src", "type", "dst", "extraction_count")


_ENTRIES = "(VALUES ('nation:1', ['nation:2', 'nation:99']), ('country x', ['nation:3', 'nation:4']), ('nobody', ['none']))"


def _entries(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("nation:1", ["nation:2", "nation:99"]), ("country x", ["nation:3", "nation:4"]), ("nobody", ["none"])], "canonical string, aliases array<string>")


@query(f"""+ keys AS (SELECT canonical, unnest(list_prepend(canonical, aliases)) AS id FROM {_ENTRIES} e(canonical, aliases)),
    deg AS (SELECT a AS id, count(*) AS degree FROM both_ways GROUP BY a),
    hits AS (SELECT DISTINCT k.canonical, k.id, coalesce(d.degree, 0) AS degree FROM keys k JOIN nodes n ON n.id = k.id LEFT JOIN deg d ON d.id = k.id),
    best AS (SELECT *, first_value(id) OVER (PARTITION BY canonical ORDER BY id <> canonical, degree DESC, id) AS new FROM hits)
    SELECT id AS old, new, canonical FROM best WHERE id <> new""")
def dictionary_merge(t: Tables) -> DataFrame:
    nodes = t.nodes.select("id").distinct().join(paths.degrees(t.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return enrich.dictionary_mapping(nodes, _entries(t))


@query(f"""+ keys AS (SELECT canonical, unnest(list_prepend(canonical, aliases)) AS id FROM {_ENTRIES} e(canonical, aliases))
    SELECT canonical, count(n.id) AS n, CASE WHEN count(n.id) >= 2 THEN 'merge_candidate' WHEN count(n.id) = 1 THEN 'matched' ELSE 'unmatched' END AS status
    FROM keys LEFT JOIN (SELECT DISTINCT id FROM nodes) n USING (id) GROUP BY canonical""")
def dictionary_status(t: Tables) -> DataFrame:
    return enrich.dictionary_status(_entries(t), t.nodes)


@query("SELECT src, dst, type, CAST(row_number() OVER (PARTITION BY src, dst ORDER BY type) - 1 AS INTEGER) AS key FROM edges")
def export_keys(t: Tables) -> DataFrame:
    return writers.export_keys(t.edges).select("src", "dst", "type", "key")


@query("SELECT src, max(type) AS type, dst FROM edges GROUP BY src, dst")
def keep_first_edge(t: Tables) -> DataFrame:
    return enrich.once(t.edges, F.desc("type"), ["src", "dst"]).select("src", "type", "dst")


@query("""+ said AS (SELECT src, type, dst FROM edges UNION ALL SELECT dst, 'PART_OF', src FROM edges WHERE type = 'HAS_PART')
    SELECT a.src, a.dst, a.type AS type_a, b.type AS type_b FROM said a JOIN said b ON a.src = b.dst AND a.dst = b.src WHERE a.type < b.type""")
def inverse_pairs(t: Tables) -> DataFrame:
    """The graph with every HAS_PART said the other way round as well."""
    stored = t.edges.select("src", "dst", "type")
    turned = stored.where("type = 'HAS_PART'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("PART_OF").alias("type"))
    return reports.inverse_pairs(stored.unionByName(turned))


_OLD, _NEW = "SELECT chunk_id FROM order_chunks WHERE CAST(split_part(chunk_id, ':', 2) AS BIGINT) % 3 <> 0", "SELECT chunk_id FROM order_chunks WHERE CAST(split_part(chunk_id, ':', 2) AS BIGINT) % 4 <> 0"


@query(f"""SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN a.chunk_id IS NULL THEN 'added' WHEN b.chunk_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change
    FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.chunk_id = b.chunk_id""")
def chunk_delta(t: Tables) -> DataFrame:
    n = F.split_part("chunk_id", F.lit(":"), F.lit(2)).cast("long")
    return maintain.delta(t.order_chunks.where(n % 3 != 0), t.order_chunks.where(n % 4 != 0))


_GONE = "SELECT chunk_id FROM order_chunks WHERE source = '1-URGENT'"


@query(f"""+ gone AS ({_GONE}), flat AS (SELECT src, type, dst, unnest(source_chunks) AS chunk_id FROM edges WHERE source_chunks IS NOT NULL)
    SELECT src, type, dst, count(*) AS n_chunks FROM flat ANTI JOIN gone USING (chunk_id) GROUP BY ALL
    UNION ALL SELECT src, type, dst, 0 FROM edges WHERE source_chunks IS NULL""")
def prune_edges(t: Tables) -> DataFrame:
    pruned = maintain.prune_edges(t.edges, t.order_chunks.where("source = '1-URGENT'"))
    return pruned.select("src", "type", "dst", F.size(F.coalesce("source_chunks", F.array())).cast("long").alias("n_chunks"))


@query(f"""+ gone AS ({_GONE}), flat AS (SELECT src, type, dst, unnest(source_chunks) AS chunk_id FROM edges WHERE type = 'USES'),
    left_over AS (SELECT src, type, dst, count(*) AS n, count(g.chunk_id) AS lost FROM flat LEFT JOIN gone g USING (chunk_id) GROUP BY ALL),
    m AS (SELECT * FROM mentions ANTI JOIN gone USING (chunk_id)),
    ends AS (SELECT src AS id FROM left_over WHERE lost < n UNION ALL SELECT dst FROM left_over WHERE lost < n)
    SELECT 'chunks' AS kind, count(*) AS n FROM gone UNION ALL SELECT 'mentions', count(*) FROM mentions SEMI JOIN gone USING (chunk_id)
    UNION ALL SELECT 'edges changed', count(*) FROM left_over WHERE lost > 0 AND lost < n UNION ALL SELECT 'edges', count(*) FROM left_over WHERE lost = n
    UNION ALL SELECT 'nodes', count(*) FROM (SELECT DISTINCT id FROM nodes) ANTI JOIN (SELECT node_id AS id FROM m UNION ALL SELECT id FROM ends) USING (id)""")
def prune_counts(t: Tables) -> DataFrame:
    """What removing urgent orders would take from the graph of sales."""
    tables = {"chunks": t.order_chunks, "mentions": t.mentions, "edges": t.edges.where("type = 'USES'"), "nodes": t.nodes.select("id").distinct()}
    return maintain.prune_report(tables, t.order_chunks.where("source = '1-URGENT'"))


@query("SELECT DISTINCT id FROM nodes ANTI JOIN (SELECT node_id AS id FROM mentions UNION ALL SELECT src FROM edges WHERE type = 'USES' UNION ALL SELECT dst FROM edges WHERE type = 'USES') m USING (id)")
def orphans(t: Tables) -> DataFrame:
    return maintain.orphans(t.nodes, t.mentions, t.edges.where("type = 'USES'"))


@query("SELECT c.chunk_id FROM order_chunks c WHERE c.chunk_id NOT IN (SELECT chunk_id FROM order_chunks WHERE text = 'O')")
def pending_chunks(t: Tables) -> DataFrame:
    return maintain.pending(t.order_chunks, t.order_chunks.where("text = 'O'").select(F.col("chunk_id").alias("hash"))).select("chunk_id")


def _records(t: Tables) -> DataFrame:
    """Each customer: the parts bought in its first orders against all."""
    return t.sales.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("l_orderkey") % 2 == 0, F.col("l_partkey"))).alias("predicted"), F.collect_set("l_partkey").alias("correct"))


_COVERAGE = """+ r AS (SELECT o_custkey, list(DISTINCT l_partkey) FILTER (WHERE l_orderkey % 2 = 0) AS p, list(DISTINCT l_partkey) AS c FROM sales GROUP BY o_custkey),
    s AS (SELECT len(coalesce(list_intersect(p, c), [])) AS h, len(c) AS g FROM r)
    SELECT count(*) AS n, round(avg(CASE WHEN h = g THEN 1.0 ELSE 0.0 END), 9) AS full_coverage, round(avg(h / g), 9) AS match_rate, round(sum(h) / sum(g), 9) AS micro_match_rate FROM s"""


@query(_COVERAGE)
def coverage(t: Tables) -> DataFrame:
    c = evaluate.coverage(_records(t))
    return c.select("n", *(F.round(x, 9).alias(x) for x in ("full_coverage", "match_rate", "micro_match_rate")))


@query("""+ gold AS (SELECT DISTINCT src AS s, type AS p, dst AS o FROM edges WHERE type IN ('USES', 'BELONGS_TO_CATEGORY')),
    found AS (SELECT DISTINCT src AS s, type AS p, dst AS o FROM edges WHERE type IN ('USES', 'PART_OF') AND hash(src) IS NOT NULL AND (type = 'PART_OF' OR extraction_count > 1 OR length(src) % 2 = 0)),
    h AS (SELECT count(*) AS hits FROM gold SEMI JOIN found USING (s, p, o)), n AS (SELECT (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM found) AS found)
    SELECT hits, gold, found, round(hits / found, 9) AS precision, round(hits / gold, 9) AS recall, round(2 * hits / (gold + found), 9) AS f1 FROM h, n""")
def prf1(t: Tables) -> DataFrame:
    spo = lambda df: df.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))
    found = t.edges.where("type = 'PART_OF' OR (type = 'USES' AND (extraction_count > 1 OR length(src) % 2 = 0))")
    row = evaluate.triple_scores(spo(t.edges.where("type IN ('USES', 'BELONGS_TO_CATEGORY')")), spo(found))
    return row.select("hits", "gold", "found", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""+ gold AS (SELECT DISTINCT o_custkey AS question_id, l_partkey AS id FROM sales),
    ranked AS (SELECT o_custkey AS question_id, l_partkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_partkey) AS rank FROM (SELECT DISTINCT o_custkey, l_partkey FROM sales WHERE l_orderkey % 3 <> 0)),
    j AS (SELECT g.question_id, r.rank, k FROM gold g LEFT JOIN ranked r USING (question_id, id), unnest([5, 10, 20]) u(k)),
    q AS (SELECT k, question_id, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) AS recall FROM j GROUP BY ALL)
    SELECT k, round(avg(recall), 9) AS recall, round(avg(CASE WHEN recall = 1 THEN 1.0 ELSE 0.0 END), 9) AS "full" FROM q GROUP BY k""")
def recall_at_k(t: Tables) -> DataFrame:
    sales = t.sales.select(F.col("o_custkey").alias("question_id"), F.col("l_partkey").alias("id"), "l_orderkey")
    found = sales.where("l_orderkey % 3 <> 0").select("question_id", "id").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("id")))
    r = evaluate.recall_at(sales.select("question_id", "id"), ranked, [5, 10, 20])
    return r.select("k", F.round("recall", 9).alias("recall"), F.round("full", 9).alias("full"))


@query("""+ r AS (SELECT c_mktsegment AS segment, CAST(c_nationkey % 3 AS VARCHAR) AS zone, CASE WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'graph' END AS cond, CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END AS ok FROM customer),
    l AS (SELECT 'segment' AS axis, segment AS value, cond, ok FROM r UNION ALL SELECT 'zone', zone, cond, ok FROM r),
    p AS (SELECT axis, value, avg(ok) FILTER (WHERE cond = 'base') AS base, avg(ok) FILTER (WHERE cond = 'graph') AS graph FROM l GROUP BY ALL)
    SELECT axis, value, round(base, 9) AS base, round(graph, 9) AS graph, round(graph - base, 9) AS delta_graph FROM p""")
def axis_crosstab(t: Tables) -> DataFrame:
    c = t.read("customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).alias("zone"), F.when(F.col("c_custkey") % 2 == 0, "base").otherwise("graph").alias("cond"), F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0).alias("ok"))
    r = evaluate.crosstab(c, ["segment", "zone"], "cond", "ok", ["base", "graph"])
    return r.select("axis", "value", *(F.round(x, 9).alias(x) for x in ("base", "graph", "delta_graph")))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither
    FROM (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels)""")
def pair_compare(t: Tables) -> DataFrame:
    labels = t.read("labels")
    run = lambda c: labels.select(F.col("doc_id").alias("question"), (F.col(c) == 1).alias("ok"))
    return evaluate.compare(run("quality"), run("toxic"))


@query("""SELECT lang AS category, count(*) AS n, round(avg(s), 9) AS mean, count(*) FILTER (WHERE s = 2) AS "full", count(*) FILTER (WHERE s = 1) AS partial, count(*) FILTER (WHERE s = 0) AS "none"
    FROM (SELECT lang, quality + toxic AS s FROM labels JOIN documents USING (doc_id)) GROUP BY lang""")
def judge_distribution(t: Tables) -> DataFrame:
    rows = t.read("labels").join(t.read("documents").select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("category"), (F.col("quality") + F.col("toxic")).alias("score"))
    d = evaluate.judge_distribution(rows)
    return d.withColumn("mean", F.round("mean", 9))


@query("""+ k AS (SELECT DISTINCT event_type AS key, user_id AS source, event_id FROM events WHERE user_id IS NOT NULL)
    SELECT key, count(DISTINCT source) AS documents, count(*) AS mentions FROM k GROUP BY key HAVING count(DISTINCT source) >= 2""")
def recurrence(t: Tables) -> DataFrame:
    return evaluate.recurrence(t.read("events").where("user_id IS NOT NULL").select(F.col("event_type").alias("key"), F.col("user_id").alias("source")))


@query("SELECT src_label AS label, count(*) AS n FROM (SELECT DISTINCT split_part(src, ':', 1) AS src_label, src FROM edges UNION SELECT DISTINCT split_part(dst, ':', 1), dst FROM edges) GROUP BY src_label")
def legend_counts(t: Tables) -> DataFrame:
    return reports.legend_counts(t.edges, F.split_part("id", F.lit(":"), F.lit(1)))


@query("""+ n AS (SELECT DISTINCT p_brand AS label, p_name AS id FROM part),
    p AS (SELECT a.label, a.id AS a, b.id AS b, levenshtein(lower(a.id), lower(b.id)) AS distance, least(2, greatest(1, floor(0.2 * least(length(a.id), length(b.id))))) AS most FROM n a JOIN n b ON a.label = b.label AND a.id < b.id WHERE length(a.id) >= 4 AND length(b.id) >= 4)
    SELECT label, a, b, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= most AND distance > 0""")
def fuzzy_pairs(t: Tables) -> DataFrame:
    names = t.read("part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("id"))
    return linking.fuzzy_pairs(names)


def _components_sql(rounds: int) -> str:
    """The least node within so many steps; the graph of the tables is narrower than that."""
    steps = ", c0 AS (SELECT DISTINCT id, id AS component FROM nodes)"
    for i in range(1, rounds + 1):
        steps += f", c{i} AS MATERIALIZED (SELECT id, min(component) AS component FROM (SELECT id, component FROM c{i - 1} UNION ALL SELECT w.b, c.component FROM both_ways w JOIN c{i - 1} c ON c.id = w.a) GROUP BY id)"
    return f"+ {steps.lstrip(', ')} SELECT id AS node, component FROM c{rounds}"


@query(_components_sql(10))
def connected_components(t: Tables) -> DataFrame:
    alone = t.nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
    return enrich.connected(t.links.unionByName(alone))


@query("""SELECT chunk_id, source, CAST(floor((rn - 1) / 20) * 20 AS BIGINT) AS page_offset FROM (SELECT chunk_id, source, row_number() OVER (PARTITION BY source ORDER BY chunk_id) AS rn FROM chunks)""")
def chunk_page_focus(t: Tables) -> DataFrame:
    return reports.page_offsets(t.chunks, 20)


@query("SELECT source, page, count(*) AS n FROM chunks GROUP BY source, page")
def chunk_dedupe(t: Tables) -> DataFrame:
    return t.chunks.groupBy("source", "page").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, chunk_id, page FROM (SELECT *, min(page) OVER (PARTITION BY source) AS f FROM chunks) WHERE page <= f + 1""")
def first_pages(t: Tables) -> DataFrame:
    return reports.first_pages(t.chunks).select("source", "chunk_id", "page")


@query("SELECT src AS start, type, dst AS \"end\" FROM edges WHERE src IN ('nation:3', 'region:1') OR dst IN ('nation:3', 'region:1') ORDER BY 1, 2, 3 LIMIT 20")
def fallback_triples(t: Tables) -> DataFrame:
    return paths.incident_triples(t.edges, t.spark.createDataFrame([("nation:3",), ("region:1",)], "id string"))


@query("""SELECT e.src AS start, e.type, e.dst AS "end", s.label AS start_type, d.label AS end_type FROM edges e
    LEFT JOIN (SELECT id, min(label) AS label FROM nodes GROUP BY id) s ON s.id = e.src LEFT JOIN (SELECT id, min(label) AS label FROM nodes GROUP BY id) d ON d.id = e.dst""")
def annotated_triples(t: Tables) -> DataFrame:
    return paths.with_labels(t.edges.select(F.col("src").alias("start"), "type", F.col("dst").alias("end")), t.nodes)


@query("""+ gold AS (SELECT DISTINCT o_custkey AS question_id, l_partkey AS id FROM sales)
    SELECT question_id, id, id % 2 = 0 AS vector, id % 3 = 0 AS graph, concat_ws('+', CASE WHEN id % 2 = 0 THEN 'vector' END, CASE WHEN id % 3 = 0 THEN 'graph' END) AS found_by FROM gold""")
def route_trace(t: Tables) -> DataFrame:
    gold = t.sales.select(F.col("o_custkey").alias("question_id"), F.col("l_partkey").alias("id"))
    return retrieval.trace(gold, {"vector": gold.where("id % 2 = 0"), "graph": gold.where("id % 3 = 0")})


@query("SELECT src, type, dst, type = 'HAS_PART' OR extraction_count > 1 AS added FROM edges")
def merge_edge_list(t: Tables) -> DataFrame:
    return writers.merge_edges(t.edges.where("type <> 'HAS_PART' AND extraction_count = 1"), t.edges)
