import random

import pytest
from pyspark.sql import functions as F

from strataweave.operators import conditions, linking, paths, retrieval
from strataweave.operators.containment import containing, like
from strataweave.operators.ranges import between

NESTED = ("NestedLoop", "Cartesian")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return sorted({"".join(rng.choice("abcAB日本%_\\ ") for _ in range(rng.randint(0, 12))) for _ in range(300)}) + [None]


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_containment_is_that_of_all_pairs(spark, texts):
    rng = random.Random(5)
    keys = [t[i : i + rng.randint(0, 6)] for t in texts[:-1] for i in [rng.randint(0, max(0, len(t) - 1))]] + ["zzz", "", None, "a", "日"]
    found = containing(column(spark, "text", texts + texts), column(spark, "key", keys + keys))
    pairs = [tuple(r) for r in found.select("text", "key").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(t, k) for t in texts if t is not None for k in keys if k and k in t}
    assert not any(n in plan(found) for n in NESTED)


def test_like_is_that_of_all_pairs(spark, texts):
    words = ["a", "AB", "a%b", "_", "%", "__________", "a_b", "b_%a", "%%日", "本", "zz", "", "ba"]
    found = {tuple(r) for r in like(column(spark, "text", texts), column(spark, "word", words)).select("text", "word").collect()}
    both = column(spark, "text", texts).distinct().crossJoin(column(spark, "word", [w for w in words if w]))
    assert found == {tuple(r) for r in both.where(F.expr("text ILIKE concat('%', word, '%')")).collect()}


def test_no_nested_loops_are_left(spark):
    nodes = spark.createDataFrame([("abc", "L"), ("bcd", "L")], "id string, label string")
    asked = spark.createDataFrame([(1, "bc")], "question_id int, key string")
    assert not any(n in plan(paths.start_nodes(nodes, asked)) for n in NESTED)
    assert not any(n in plan(linking.presence(nodes, asked.select(F.col("key").alias("name")))) for n in NESTED)


def test_route_to_the_largest_and_by_key(spark):
    rows = [(f"f{i}", "l", v, "", "s", [("平日の割増", "")] if i % 2 else []) for i, v in enumerate([5, 9, None, 9, 1, -1, 7])]
    facts = spark.createDataFrame(rows, "fact_id string, label string, value_num long, unit string, source string, conditions array<struct<value:string,norm_value:string>>")
    asked = spark.createDataFrame([(1, "7%以上"), (2, "0%以上"), (3, "平日の条件"), (4, "何"), (5, "99%以上")], "question_id int, text string")
    found = sorted((r.question_id, r["rank"], r.fact_id) for r in conditions.route(asked, facts, 3).collect())
    assert found == [(1, 1, "f1"), (1, 2, "f3"), (1, 3, "f6"), (2, 1, "f1"), (2, 2, "f3"), (2, 3, "f6")]


def test_keyword_entities_takes_k_a_word_in_order(spark):
    nodes = spark.createDataFrame([(i,) for i in ("Alpha", "alphabet", "beta", "a%b", "axb")], "id string")
    asked = spark.createDataFrame([(1, "zeta ALPHA bet a_b x")], "question_id int, text string")
    found = {(r.id, r.first) for r in retrieval.keyword_entities(nodes, asked, 1).collect()}
    assert found == {("Alpha", 1), ("alphabet", 2), ("a%b", 3)}


@pytest.mark.parametrize("seed", [0, 1])
def test_range_join_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    group = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    points = [(group(), rng.choice([None, *range(6)]) if seed else str(rng.randint(0, 30)), i) for i in range(200)]
    spans = [(group(), *sorted([x, y]), i) if rng.random() < 0.9 else (group(), y, x, i) for i in range(60) for x, y in [(str(rng.randint(0, 30)), str(rng.randint(0, 30)))]]
    kind = "string"
    if seed:
        points, kind = [(g, v, i) for g, v, i in points], "int"
        spans = [(g, int(x) % 6, int(y) % 6 if i % 9 else None, i) for g, x, y, i in spans]
    p = spark.createDataFrame(points + points[:5], f"source string, v {kind}, p int").repartition(3)
    s = spark.createDataFrame(spans, f"source string, a {kind}, b {kind}, s int")
    found = between(p, s, ["source"], "v", "a", "b")
    assert set(found.columns) == {"source", "v", "p", "a", "b", "s"}
    expected = sorted((i, j) for g, v, i in points + points[:5] for h, x, y, j in spans if g is not None and g == h and None not in (v, x, y) and x <= v <= y)
    assert sorted((r.p, r.s) for r in found.collect()) == expected
    assert not any(n in plan(found) for n in NESTED)
    assert between(p.limit(0), s, ["source"], "v", "a", "b").count() == 0
