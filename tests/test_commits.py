import json

import pytest
from pyspark.sql import functions as F

from strataweave.operators import hooks, maintain
from strataweave.sources import writers
from strataweave.sources.snapshots import SnapshotStore
from strataweave.streaming import revisions

TRIPLES, MENTIONS = "src string, type string, dst string, chunk_id string", "chunk_id string, node_id string"


def chunker(docs):
    lines = docs.select("source", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return lines.select(F.sha2(F.concat_ws("\n", "source", "text"), 256).alias("chunk_id"), "source", "page", "text")


def extract(chunks):
    words = chunks.select("chunk_id", F.split("text", " ").alias("w")).where("size(w) > 1")
    triples = words.select(F.get("w", F.lit(0)).alias("src"), F.lit("R").alias("type"), F.get("w", F.lit(1)).alias("dst"), "chunk_id")
    mentions = words.select("chunk_id", F.explode("w").alias("node_id")).distinct()
    return triples, mentions


def empty(spark):
    return {
        "chunks": spark.createDataFrame([], "chunk_id string, source string, page int, text string"),
        "mentions": spark.createDataFrame([], MENTIONS),
        "edges": spark.createDataFrame([], "src string, type string, dst string, extraction_count long, source_chunks array<string>"),
        "nodes": spark.createDataFrame([], "id string"),
    }


def state(store):
    t = store.tables()
    edges = sorted((r.src, r.dst, r.extraction_count, len(r.source_chunks)) for r in t["edges"].collect())
    return sorted(r.text for r in t["chunks"].collect()), edges, sorted(r.id for r in t["nodes"].collect()), sorted((r.doc_id, r.version) for r in t["versions"].collect())


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, version long, source string, text string")


def test_a_batch_counts_once_however_often_it_comes(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert revisions.begun(store, empty(spark)) and not revisions.begun(store, empty(spark))
    update = revisions.applied(store, chunker, extract)
    first = batch(spark, [(1, 1, "a", "x y\np q"), (2, 1, "b", "x y")])
    update(first, 0)
    once = state(store)
    assert once == (["p q", "x y", "x y"], [("p", "q", 1, 1), ("x", "y", 2, 2)], ["p", "q", "x", "y"], [(1, 1), (2, 1)])
    update(first, 0)
    assert state(store) == once and store.ledger().count() == 2
    update(batch(spark, [(1, 3, "a", "x y\nn m"), (1, 2, "a", "old"), (2, 2, "b", None), (3, 1, "c", "k")]), 1)
    assert state(store) == (["k", "n m", "x y"], [("n", "m", 1, 1), ("x", "y", 2, 1)], ["m", "n", "x", "y"], [(1, 3), (2, 2), (3, 1)])
    update(batch(spark, [(1, 2, "a", "late")]), 2)  # an older version is passed over
    assert state(store)[0] == ["k", "n m", "x y"]
    assert [len(store.tables(n)) for n in range(3)] == [5, 5, 5] and store.tables(1)["chunks"].count() == 3


def test_a_commit_that_breaks_off_changes_nothing_and_is_made_anew(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    revisions.begun(store, empty(spark))
    before = state(store)
    calls = []

    def failing(chunks):
        calls.append(1)
        triples, mentions = extract(chunks)
        if len(calls) == 1:
            mentions = mentions.withColumn("node_id", F.raise_error(F.lit("broken")))
        return triples, mentions

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"doc_id": d, "version": 1, "source": f"s{d}", "text": "u v"}) for d in (1, 2)))
    run = lambda: revisions.apply(revisions.revisions(spark, str(tmp_path / "in")), revisions.applied(store, chunker, failing), str(tmp_path / "check")).awaitTermination(120)
    with pytest.raises(Exception):  # noqa: B017
        run()
    assert state(store) == before and store.ledger().count() == 1
    run()  # the same batch comes again
    after = state(store)
    assert after[1] == [("u", "v", 2, 2)] and store.ledger().count() == 2
    revisions.applied(store, chunker, extract)(batch(spark, [(9, 9, "z", "not to be seen")]), 0)
    assert state(store) == after
    gone = store.vacuum()
    assert gone and state(store) == after and not store.vacuum()


def graph(spark, n=200):
    nodes = spark.createDataFrame([(f"n{i}", "L") for i in range(n)] + [("日本", None)], "id string, label string")
    edges = spark.createDataFrame([(f"n{i}", "R", f"n{i + 1}") for i in range(n)], "src string, type string, dst string")
    return nodes, edges


def test_restore_goes_on_where_it_stopped(spark, tmp_path):
    nodes, edges = graph(spark)
    path, target = str(tmp_path / "backup"), str(tmp_path / "target")
    manifest = writers.backup(nodes, edges, path, parts=4)
    assert {r.kind: r.n for r in manifest.groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {"node": 201, "edge": 200}
    first = writers.resume(spark, path, target).collect()
    assert len(first) == 8 and {r.state for r in first} == {"written"}
    writers.wipe(spark, f"{target}/kind=edge/part=2")
    spark.createDataFrame([("{}",)], "row string").write.mode("append").json(f"{target}/kind=node/part=1")  # half of another run
    again = {(r.kind, r.part): r.state for r in writers.resume(spark, path, target).collect()}
    assert {k for k, s in again.items() if s == "written"} == {("edge", 2), ("node", 1)}
    n, e = writers.restore(spark, target, "id string, label string", "src string, type string, dst string")
    assert sorted(map(str, n.collect())) == sorted(map(str, nodes.collect())) and sorted(e.collect()) == sorted(edges.collect())
    assert writers.wipe(spark, target) and not writers.wipe(spark, target)


def test_a_damaged_backup_is_an_error(spark, tmp_path):
    nodes, edges = graph(spark, 20)
    writers.backup(nodes, edges, str(tmp_path / "b"), parts=2)
    spark.createDataFrame([("{}",)], "row string").write.mode("append").json(str(tmp_path / "b/rows/kind=node/part=0"))
    with pytest.raises(ValueError, match="manifest"):
        writers.resume(spark, str(tmp_path / "b"), str(tmp_path / "t"))


def test_pruning_can_be_looked_at_first(spark):
    edges = spark.createDataFrame([("a", "R", "b", 2, ["1", "2"]), ("b", "R", "c", 1, ["1"]), ("c", "R", "d", 1, None), ("d", "R", "e", 1, ["3"])], "src string, type string, dst string, extraction_count long, source_chunks array<string>")
    tables = {
        "edges": edges,
        "chunks": spark.createDataFrame([("1", "s"), ("2", "s"), ("3", "s")], "chunk_id string, source string"),
        "mentions": spark.createDataFrame([("1", "z"), ("1", "a"), ("2", "a")], MENTIONS),
        "nodes": spark.createDataFrame([(i,) for i in "abcdez"], "id string"),
    }
    removed = spark.createDataFrame([("1",), ("9",)], "chunk_id string")
    assert {r.kind: r.n for r in maintain.prune_report(tables, removed).collect()} == {"chunks": 1, "mentions": 2, "edges changed": 1, "edges": 1, "nodes": 1}
    left = sorted((r.src, r.source_chunks) for r in maintain.prune_edges(edges, removed).collect())
    assert left == [("a", ["2"]), ("c", None), ("d", ["3"])]


@pytest.mark.parametrize(
    "text",
    ["SELECT 'drop table x; set' AS created", "WITH delete AS (SELECT 1 AS a) SELECT * FROM delete JOIN seen USING (a)", "values (1), (2)", "```sql\nTABLE seen;\n```", "SELECT a, count(*) FROM seen WHERE a IN (SELECT a FROM seen) GROUP BY a HAVING count(*) > 0 ORDER BY a LIMIT 3", "SELECT * FROM range(3)"],
)
def test_reading_statements_are_run(spark, text):
    spark.range(1, 9).selectExpr("id AS a").createOrReplaceTempView("seen")
    assert hooks.read_only_sql(spark, text, 2, ["seen"]).count() in (1, 2)


@pytest.mark.parametrize(
    "text",
    ["INSERT INTO seen SELECT 1", "CREATE TABLE z AS SELECT 1", "DROP VIEW seen", "SET a = 1", "EXPLAIN SELECT 1", "SELECT 1; SELECT 2", "SELECT reflect('java.lang.System', 'lineSeparator')", "SELECT (SELECT java_method('java.lang.System', 'lineSeparator'))", "SELECT * FROM parquet.`/tmp/x`", "nonsense", "SELECT * FROM other", "CACHE TABLE seen", "MERGE INTO seen USING seen AS u ON seen.a = u.a WHEN MATCHED THEN DELETE"],
)
def test_other_statements_are_refused(spark, text):
    spark.range(1, 9).selectExpr("id AS a").createOrReplaceTempView("seen")
    with pytest.raises(ValueError):
        hooks.read_only_sql(spark, text, 2, ["seen"])
