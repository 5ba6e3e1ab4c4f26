import json

import pytest
from pyspark.sql import functions as F

from strataweave.functions import vectors
from strataweave.operators import evaluate, hooks, retrieval
from strataweave.plans import pipelines
from strataweave.sources import readers, writers
from strataweave.streaming import revisions


def test_readers(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_text("# A\ntext", encoding="utf-8")
    (tmp_path / "docs/sub/b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "docs/c.txt").write_text("  ")
    (tmp_path / "docs/d.bin").write_text("no")
    got = {r.source: r.text for r in readers.read_texts(spark, str(tmp_path / "docs")).collect()}
    assert got == {"a.md": "# A\ntext", "b.txt": "caf�"}
    edges = tmp_path / "e.csv"
    edges.write_text("﻿From, To ,Relation\n a ,b,USES\nc,,X\nd,e,\n", encoding="utf-8")
    assert {tuple(r) for r in readers.read_edges(spark, str(edges)).collect()} == {("a", "USES", "b"), ("d", "RELATED_TO", "e")}
    q = tmp_path / "q.csv"
    q.write_text("question,level\nwhat?,1\n ,2\n")
    assert [tuple(r) for r in readers.read_questions(spark, str(q)).collect()] == [("what?", "1")]
    with pytest.raises(ValueError):
        readers.read_questions(spark, str(edges))
    d = tmp_path / "d.json"
    d.write_text(json.dumps({"entries": [{"canonical": " Ａ  b ", "aliases": ["x"]}, {"canonical": ""}]}))
    assert [(r.canonical, r.aliases) for r in readers.read_dictionary(spark, str(d)).collect()] == [("A b", ["x"])]
    c = tmp_path / "d.csv"
    c.write_text("canonical,aliases\nA,x| y |\n")
    assert [(r.canonical, r.aliases) for r in readers.read_dictionary(spark, str(c)).collect()] == [("A", ["x", "y"])]
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"domain": "d", "version": "1", "relations": [{"name": "R", "definition": "x"}]}))
    assert readers.read_schema(spark, str(s))["relations"] == {"R": "x"}
    assert readers.read_schema(spark, str(tmp_path / "none.json"))["version"] == "builtin-v1"
    j = tmp_path / "c.jsonl"
    j.write_text(json.dumps({"chunk_id": "1", "doc_id": "d", "page": 2, "section_path": ["a", "b"], "text": "t"}))
    assert tuple(readers.read_chunks(spark, str(j)).head()) == ("1", "d", 2, "a > b", "t")
    tasks = readers.read_tasks(spark, json.dumps([{"question": "q", "axes": {"level": {"value": 3}}}]), ["level"])
    assert tuple(tasks.head()) == ("q", "3")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "t")], "chunk_id string, text string")
    path = str(tmp_path / "col")
    writers.write_collection(rows, path, "a")
    writers.write_collection(rows, path, "b_entities")
    writers.write_collection(rows, path, "a", replace=True)
    assert {tuple(r) for r in writers.collections(spark, path).collect()} == {("a", 1)}
    assert writers.read_collection(spark, path, "b_entities").count() == 1
    nodes = spark.createDataFrame([("a", "T")], "id string, label string")
    edges = spark.createDataFrame([("a", "R", "b"), ("a", "S", "b")], "src string, type string, dst string")
    writers.backup(nodes, edges, str(tmp_path / "bak"))
    n, e = writers.restore(spark, str(tmp_path / "bak"), "id string, label string", "src string, type string, dst string")
    assert n.collect() == nodes.collect() and sorted(e.collect()) == sorted(edges.collect())
    out = [json.loads(r.json) for r in writers.node_link_json(nodes, edges).where("kind = 'edge'").collect()]
    assert sorted((o["type"], o["key"]) for o in out) == [("R", 0), ("S", 1)]
    writers.write_csv(spark.createDataFrame([(1, ["a", "b"])], "n int, l array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).head().l == "a;b"
    writers.stamp(spark, str(tmp_path / "stamp"), collection="c", doc_count=3)
    assert spark.read.parquet(str(tmp_path / "stamp")).head().collection == "c"
    assert tuple(retrieval.gate(spark.read.parquet(str(tmp_path / "stamp")), "x").head()) == (False, "mismatch")
    images = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),)], "content binary")
    assert [r.name for r in writers.image_files(images).collect()] == ["2d711642b726b044.png"]


def test_vector_search_matches_plain_cosine(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [0.0] * 8), (92, [1.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = corpus.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4096, 3):
        got = vectors.top_k(corpus.repartition(3), asked, 5, block=block).orderBy("query_id", "rank").collect()
        assert [r.vec_id for r in got] == [int(i) for q in range(7) for i in np.argsort(-(u @ u[q]))[:5]]


def test_fusion_and_reranking(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "c", 0.7, 1)], "question_id int, id string, score double, rank int")
    k = spark.createDataFrame([(1, "b", 5.0, 1)], "question_id int, id string, score double, rank int")
    got = {(r.question_id, r.rank): (r.id, r.score_type) for r in retrieval.hybrid(v, k, 5).collect()}
    assert got == {(1, 1): ("b", "rrf"), (1, 2): ("a", "rrf"), (2, 1): ("c", "cosine")}
    c = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcd")], "question_id int, id string, rank int")
    s = spark.createDataFrame([(1, "c", 0.9), (1, "a", 0.1)], "question_id int, id string, score double")
    assert [r.id for r in retrieval.rerank(c, s, 4).orderBy("rank").collect()] == ["c", "a", "b", "d"]
    o = spark.createDataFrame([(1, "3, 1,3,9,x")], "question_id int, answer string")
    assert [r.id for r in retrieval.rerank_by_order(c, o, 4).orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_answer_measures(spark):
    rows = spark.createDataFrame([("Tokyo.", "tokyo"), ("in Osaka!", "Osaka"), ("abc", "abd"), (None, "x")], "predicted string, gold string")
    r = evaluate.answer_scores(rows).head()
    assert (r.n, r.exact, r.contained) == (4, 0.25, 0.5) and abs(r.f1 - (1 + 10 / 12 + 4 / 6 + 0) / 4) < 1e-9
    facts = evaluate.fact_coverage(spark.createDataFrame([("a, b and C", "A; c ;zz"), ("x", None)], "answer string, key_facts string")).collect()
    assert [f.coverage for f in facts] == [2 / 3, None]


def test_build_and_retrieve_end_to_end(spark):
    docs = spark.createDataFrame([("guide", "# Guide\n## Pumps\nThe pump needs a valve and a filter.\n## Care\nClean the filter with water."), ("notes", "Water drives the turbine.")], "source string, text string")
    names = spark.createDataFrame([(n,) for n in ("pump", "valve", "filter", "water", "turbine")], "id string")
    graph = pipelines.build(docs, lambda chunks: hooks.cooccurrence_triples(chunks, names), hooks.HashedWords(32), rank=False)
    assert {(r.src, r.dst) for r in graph.edges.collect()} == {("pump", "valve"), ("valve", "filter"), ("filter", "water"), ("water", "turbine")}
    asked = hooks.embedded(spark.createDataFrame([(1, "what does the pump need", ["Pump"]), (2, "turbine speed", ["nobody"]), (3, "zzz", ["nobody"])], "question_id long, text string, names array<string>"), hooks.HashedWords(32))
    found = pipelines.retrieve(graph, asked, pipelines.Options(hops=2))
    assert "pump -[RELATED_TO]-> valve" in {r.path_text for r in found["paths"].collect()}
    contexts = {r.question_id: r.context for r in found["context"].collect()}
    assert "The pump needs a valve" in contexts[1] and "推論パス" in contexts[1] and "  [P" in contexts[1] and "[出典: guide]" in contexts[1]
    assert "turbine" in contexts[2] and "(グラフデータなし)" in contexts[3]  # a word of the question leads into the graph, or nothing does
    answers = pipelines.answer(graph, asked, hooks.FirstSentence(), pipelines.Options(mode="none"))
    assert answers.count() == 3 and answers.orderBy("question_id").head().answer


def test_revisions_stream_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"doc_id": 1, "version": v, "source": "s", "text": f"v{v}"}) for v in (1, 3, 2)))
    seen = []
    query = revisions.apply(revisions.revisions(spark, str(tmp_path / "in")), lambda df, n: seen.extend((r.doc_id, r.text) for r in df.collect()), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert seen == [(1, "v3")]


def test_themes_scopes_and_clearing(spark, tmp_path):
    relations = spark.createDataFrame([(1, "a", "R", "b", [1.0, 0.0]), (2, "c", "R", "d", [0.9, 0.1]), (3, "e", "R", "f", [0.0, 1.0])], "relation_id long, start string, type string, end string, embedding array<float>")
    themes = spark.createDataFrame([(7, [1.0, 0.0])], "question_id long, embedding array<float>")
    known = spark.createDataFrame([(7, "a", "R", "b")], "question_id long, start string, type string, end string")
    assert [(r.start, r.theme_score) for r in retrieval.theme_relations(relations, themes, known).collect()] == [("c", 0.9939)]
    hits = spark.createDataFrame([(1, "x", "s1", 0.9), (1, "y", "s2", 0.8), (1, "z", "s9", 1.0)], "question_id int, id string, source string, score double")
    targets = spark.createDataFrame([(1, "s2", 0), (1, "s1", 1)], "question_id int, source string, ordinal int")
    assert [r.id for r in retrieval.scoped(hits, targets, 5).orderBy("rank").collect()] == ["x", "y"]
    path = str(tmp_path / "c")
    for name in ("a", "b"):
        writers.write_collection(spark.createDataFrame([("1",)], "chunk_id string"), path, name)
    assert writers.clear_collection(spark, path, "a") == 1 and [r.collection for r in writers.collections(spark, path).collect()] == ["b"]
    records = spark.createDataFrame([(["p1", "p2"], ""), (["p1"], "multi-hop"), (["p1"], None)], "correct array<string>, question_type string")
    assert [r.multihop for r in evaluate.is_multihop(records).collect()] == [True, True, False]
