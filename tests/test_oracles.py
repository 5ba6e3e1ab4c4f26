"""Registered queries against their own SQL in DuckDB, on small tables of the shapes that larger ones have."""

import random
from collections import Counter

import duckdb
import pytest

from strataweave.operators import cascade, conditions, enrich, linking, retrieval, tables
from strataweave.operators.keyword_index import KeywordIndex
from strataweave.plans import registry

def most_rows(df):
    """The rows of ``df``, and the most rows that an operator of its plan put out."""
    rows, most = df.collect(), 0
    open_nodes = [df._jdf.queryExecution().executedPlan()]
    while open_nodes:
        node = open_nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            open_nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            open_nodes.append(node.plan())
        else:
            open_nodes += [node.children().apply(i) for i in range(node.children().size())]
        counted = node.metrics().get("numOutputRows")
        if counted.isDefined():
            most = max(most, counted.get().value())
    return rows, most


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def same(spark, at, name, **tables):
    """Whether a query gives the rows of its SQL on ``tables`` (rows and schema)."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
    found = registry.QUERIES[name](spark, str(at))
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in found.collect()) == Counter(want)
    return len(want)


def test_pages_of_four_digits_are_referred_to(spark, tmp_path):
    # pages 1 to 1,002 of fifty documents, of which two have all parts
    parts = [(50 * n + d, "hot bolt", "Brand#1", "SMALL", 1) for n in range(1002) for d in (3, 7)]
    parts += [(1_000_000 + 50 * n, "hot bolt", "Brand#1", "SMALL", 1) for n in range(50_100 - len(parts))]
    assert same(spark, tmp_path, "reference_graph", part=(parts, PART)) > 3000


def test_headers_of_lines_with_signs_of_their_own(spark, tmp_path):
    texts = ["plain", "## two", "###x\n### y\n#  z", "#\n#\n\n#", "a\r# b\u2028#c\n#d", " # e", "", None, "x# y\n \n###"]
    assert same(spark, tmp_path, "spaced_headers", documents=(list(enumerate(texts)), "doc_id long, text string")) == len(texts)


def test_a_frequent_word_meets_few_nodes_at_its_places(spark):
    nodes = spark.createDataFrame([(f"part:{i}",) for i in range(2000)], "id string")
    asked = spark.createDataFrame([(i, "the part art") for i in range(500)], "question_id int, text string")
    rows, most = most_rows(retrieval.keyword_entities(nodes, asked, 2))
    assert Counter(tuple(r) for r in rows) == Counter((i, f"part:{n}", 1) for i in range(500) for n in (0, 1))
    assert most <= 20_000


def test_names_with_other_numbers_do_not_meet_unless_asked_for(spark, monkeypatch):
    rows = [(f"red valve unit no {i}", "T", 0.5) for i in range(300)] + [(f"red valve unlt no {i}", "T", 0.1) for i in range(0, 300, 3)]
    names = spark.createDataFrame(rows, "id string, label string, pagerank double")
    none = spark.createDataFrame([], "src string, type string, dst string, extraction_count long, source_chunks array<string>")
    seen = []
    monkeypatch.setattr(cascade, "fuzzy_pairs", lambda df: seen.append(linking.fuzzy_pairs(df)) or seen[-1])
    found = {numbers: cascade.link(names, none, numbers_apart=numbers).mapping.collect() for numbers in (True, False)}
    assert set(found[True]) == set(found[False]) and len(found[False]) == 100
    met = [most_rows(df)[1] for df in seen]
    assert met[1] <= 20_000 < met[0]


def test_a_search_makes_no_pairs_of_questions_and_shards(spark):
    docs = [(f"d{i:03}", " ".join(f"w{(i * j) % 97}" for j in range(1, 20))) for i in range(600)] + [(None, "w1 w2 w3")]
    asked = spark.createDataFrame([(i, " ".join(f"w{(i + 7 * j) % 97}" for j in range(15))) for i in range(150)], "question_id int, text string")
    table = spark.createDataFrame(docs, "id string, text string")
    rows, most = most_rows(KeywordIndex.build(table, shard=15).search(asked, 4).select("question_id", "id", "score", "rank"))
    every = retrieval.ranked(retrieval.bm25_scores(table, asked).selectExpr("question_id", "id", "round(score, 6) AS score"), 4)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, every.select("question_id", "id", "score", "rank").collect()))
    assert most <= 25_000


def test_facts_are_cut_before_they_meet_questions(spark):
    facts = spark.createDataFrame([(f"f{i:04}", "l", i % 50, "", "s", [("平日区分", "")]) for i in range(1000)], "fact_id string, label string, value_num long, unit string, source string, conditions array<struct<value:string,norm_value:string>>")
    asked = spark.createDataFrame([(i, "A 平日 (を含む)") for i in range(300)], "question_id int, text string")
    rows, most = most_rows(conditions.route(asked, facts, 3).select("question_id", "fact_id", "rank"))
    assert Counter(map(tuple, rows)) == Counter((i, f"f{n:04}", r) for i in range(300) for r, n in ((1, 0), (2, 50), (3, 100)))
    assert most <= 10_000


LINE = "l_orderkey long, l_partkey long, l_quantity double"


def test_tables_in_one_task_do_not_touch_each_other(spark, tmp_path):
    lines = [(order, (order * 7 + i * 13) % 50, float((order + i) % 9)) for order in range(400) for i in range(order % 6 + 1)]
    lines = sorted({(o, p): (o, p, q) for o, p, q in lines}.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert same(spark, tmp_path, "merged_cell_tables", lineitem=(lines, LINE)) == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_are_placed_without_a_group_for_each_table(spark):
    cells = spark.createDataFrame([("a", 0, 0, 2, 1, "x"), ("a", 1, 0, 1, 1, "y"), ("b", 0, 0, None, 2, "z"), ("b", 0, 1, 1, 1, "w"), (None, 0, 0, 1, 1, "n"), ("b", None, 0, 1, 1, "-")], "table_id string, row int, n int, row_span int, column_span int, text string")
    found = tables.placed(cells)
    assert "InArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert Counter((r.table_id, r.row, r.column, r.text) for r in found.collect()) == Counter([("a", 0, 0, "x"), ("a", 1, 1, "y"), ("b", 0, 0, "z"), ("b", 0, 2, "w"), (None, 0, 0, "n")])


def test_edges_shrink_while_components_are_found(spark, monkeypatch):
    rng = random.Random(7)
    names = [f"n{i:04}" for i in rng.sample(range(3000), 3000)]
    pairs = list(zip(names[:900], names[1:901]))  # a path
    pairs += [(names[1000], n) for n in names[1001:1800]] * 2 + [(n, n) for n in names]
    pairs += [(rng.choice(names[1800:2600]), rng.choice(names[1800:2600])) for _ in range(900)] + [(None, names[5]), (names[6], None)]
    want = {n: n for n in names}

    def top(n):
        while want[n] != n:
            n = want[n]
        return n

    for a, b in pairs:
        if a and b:
            low, high = sorted((top(a), top(b)))
            want[high] = low
    sizes = []
    monkeypatch.setattr(enrich, "written", lambda df, name, f=enrich.written: sizes.append((name, (out := f(df, name)).count())) or out)
    found = enrich.connected(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {r.node: r.component for r in found} == {n: top(n) for n in names} and len(found) == len(names)
    edges = [n for name, n in sizes if name == "component-edges"]
    assert edges[-1] == 0 and edges[1] < edges[0] / 4 and len(edges) <= 8
