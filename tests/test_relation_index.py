import json

from pyspark.sql import functions as F

from strataweave.operators import hooks, relation_index, retrieval

EDGES = "src string, type string, dst string, extraction_count long, source_chunks array<string>, keywords array<string>"


def model(_):
    class Model:
        def complete(self, prompts):
            out = []
            for p in prompts:
                lines = p.split("\n")[1:]
                if any("broken" in line for line in lines):
                    raise ConnectionError
                out.append("```json\n" + json.dumps([{"i": i, "kw": ["theme", line.split(" ")[1], "", "c", "d", "e"]} for i, line in enumerate(lines, 1) if "silent" not in line] + [{"i": 99, "kw": ["x"]}, {"kw": 3}]) + "\n```")
            return out

    return Model()


def test_only_open_relations_between_entities_are_annotated(spark):
    rows = [
        ("pump", "USES", "valve", 1, ["c1"], None),
        ("valve", "PART_OF", "plant", 1, None, ["old"]),
        ("a" * 32, "USES", "pump", 1, None, None),
        ("pump", "USES", "secret", 1, None, None),
        ("silent", "USES", "pump", 1, None, None),
    ]
    edges = spark.createDataFrame(rows, EDGES).coalesce(1)
    nodes = spark.createDataFrame([("pump", "T"), ("secret", "QmsDoc"), ("secret", "T")], "id string, label string")
    chunks = spark.createDataFrame([("c1", "x" * 500)], "chunk_id string, text string")
    found = {(r.src, r.dst): r.keywords for r in relation_index.annotate(edges, nodes, model(0), chunks).collect()}
    assert found == {("pump", "valve"): ["theme", "pump", "c", "d"], ("valve", "plant"): ["old"], ("a" * 32, "pump"): None, ("pump", "secret"): None, ("silent", "pump"): None}
    assert relation_index.annotate(edges.drop("keywords"), nodes, model(0), protected="").where("keywords IS NOT NULL").count() == 3


def test_a_prompt_that_fails_leaves_its_relations_open(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", "R", "broken" if i == 3 else "m", 1, None, None) for i in range(6)], EDGES).coalesce(1).sortWithinPartitions("src")
    nodes = spark.createDataFrame([("m", "T")], "id string, label string")
    done = relation_index.annotate(edges, nodes, model(0), batch=2, protected="")
    assert done.where("keywords IS NULL").count() == 2 and done.count() == 6
    assert relation_index.read_keywords("no list", 2) == [None, None] and relation_index.read_keywords(None, 1) == [None] and relation_index.read_keywords('[{"i": "x", "kw": []}, 3]', 1) == [None]


def test_index_embeds_what_is_new_and_serves_themes(spark):
    edges = spark.createDataFrame([("pump", "USES", "valve", 1, None, ["pressure", "safety"]), ("road", "PART_OF", "town", 1, None, None)], EDGES)
    first = relation_index.refreshed(edges, hooks.HashedWords(64)).cache()
    more = edges.where("src = 'pump'").unionByName(spark.createDataFrame([("town", "HAS", "bridge", 1, None, ["traffic"])], EDGES))

    class OnlyNew(hooks.HashedWords):
        def embed(self, texts):
            assert all("bridge" in t for t in texts), texts
            return super().embed(texts)

    second = relation_index.refreshed(more, OnlyNew(64), first)
    assert sorted(r.start for r in second.collect()) == ["pump", "town"]
    themes = hooks.embedded(spark.createDataFrame([(1, "pressure safety"), (2, "traffic")], "question_id long, text string"), hooks.HashedWords(64))
    known = spark.createDataFrame([], "question_id long, start string, type string, end string")
    hits = {(r.question_id, r.start) for r in retrieval.theme_relations(second, themes.select("question_id", F.col("embedding")), known, 1).collect()}
    assert hits == {(1, "pump"), (2, "town")}
