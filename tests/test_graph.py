from collections import Counter

import pytest

from strataweave.operators import enrich, linking, maintain, model, paths

EDGE = "src string, type string, dst string, extraction_count long, source_chunks array<string>"


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, *([1, ["c"]] if len(r) == 3 else [])) for r in rows], EDGE)


@pytest.fixture(scope="module")
def tiny(spark):
    return edges_of(spark, [("a", "R", "b"), ("b", "R", "c"), ("c", "R", "a"), ("a", "S", "b"), ("d", "R", "d"), ("c", "R", "53"), ("53", "R", "e")])


def walks(edges, starts, hops, blocked):
    both = [(s, d, i) for i, (s, _, d) in enumerate(edges)] + [(d, s, i) for i, (s, _, d) in enumerate(edges) if s != d]
    out = Counter()

    def go(nodes, used):
        if used and nodes[0] != nodes[-1]:
            out[(tuple(nodes), tuple(edges[i][1] for i in used))] += 1
        if len(used) < hops and (not used or nodes[-1] not in blocked):
            for s, d, i in both:
                if s == nodes[-1] and i not in used:
                    go([*nodes, d], [*used, i])

    for s in starts:
        if s not in blocked:
            go([s], [])
    return out


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_trails_match_depth_first_search(spark, tiny, hops):
    starts = spark.createDataFrame([("a",), ("53",), ("d",)], "id string")
    blocked = spark.createDataFrame([("53",)], "id string")
    found = paths.trails(tiny, starts, hops, blocked).collect()
    rows = [(r.src, r.type, r.dst) for r in tiny.collect()]
    assert Counter((tuple(r.nodes), tuple(r.types)) for r in found) == walks(rows, ["a", "53", "d"], hops, {"53"})


def test_pagerank_sums_to_one_and_orders_hubs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = edges_of(spark, [("a", "R", "d"), ("b", "R", "d"), ("c", "R", "d"), ("a", "S", "d")])
    ranks = {r.id: r.pagerank for r in enrich.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-3 and ranks["d"] > 2 * ranks["a"]
    assert enrich.pagerank(nodes.limit(0), edges).count() == 0


def test_merging_twice_is_merging_once(spark, tiny):
    mapping = spark.createDataFrame([("b", "a"), ("c", "b")], "old string, new string")
    flat = model.settled(mapping)
    assert {(r.old, r.new) for r in flat.collect()} == {("b", "a"), ("c", "a")}
    once = model.rewire(tiny, flat)
    key = lambda df: sorted((r.src, r.type, r.dst, r.extraction_count) for r in df.collect())
    assert key(once) == key(model.rewire(once, flat))
    assert ("d", "R", "d", 1) in key(once) and not any(r[0] == r[2] == "a" for r in key(once))


def test_missing_counts_merge_as_one(spark):
    rows = spark.createDataFrame([("a", "R", "b", None, ["x"]), ("a", "R", "b", None, None), ("a", "R", "b", 3, ["x", "y"])], EDGE)
    r = model.merged_edges(rows).head()
    assert (r.extraction_count, r.source_chunks) == (5, ["x", "y"])


def test_relation_rules_turn_and_respect_a_schema(spark):
    edges = edges_of(spark, [("a", "HAS_PART", "b"), ("b", "PART_OF", "a"), ("a", "COVERS", "c")])
    got = {(r.src, r.type, r.dst): r.extraction_count for r in enrich.normalize_relations(edges).collect()}
    assert got == {("b", "PART_OF", "a"): 2, ("a", "APPLIES_TO", "c"): 1}
    kept = {r.type for r in enrich.normalize_relations(edges, ["HAS_PART", "COVERS"]).collect()}
    assert kept == {"HAS_PART", "PART_OF", "COVERS"}


def test_kana_variants_merge_into_the_most_linked(spark):
    names = [("ガス軸受", 5), ("ガス軸受け", 1), ("データの連携", 1), ("データ連携", 1), ("U7314", 1), ("U7414", 9), ("取締役", 1), ("監査役", 1)]
    got = {(r.old, r.new) for r in enrich.kana_mapping(spark.createDataFrame(names, "id string, degree long")).collect()}
    assert got == {("ガス軸受け", "ガス軸受"), ("データ連携", "データの連携")} or got == {("ガス軸受け", "ガス軸受"), ("データの連携", "データ連携")}


def test_direct_clusters_do_not_chain(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    scores = spark.createDataFrame([("a", 0.9, 1), ("b", 0.5, 1), ("c", 0.1, 1)], "id string, pagerank double, mention_count long")
    assert {(r.old, r.new) for r in enrich.direct_clusters(pairs, scores).collect()} == {("b", "a")}


def test_dictionary_applies_and_clears(spark):
    nodes = spark.createDataFrame([("x", "T", ["old"], "cat"), ("y", "T", ["keep"], "cat")], "id string, label string, aliases array<string>, category string")
    entries = spark.createDataFrame([("x", ["new"], None, "def", None)], "canonical string, aliases array<string>, category string, definition string, notes string")
    got = {r.id: (r.aliases, r.category, r.definition) for r in enrich.apply_dictionary(nodes, entries).collect()}
    assert got == {"x": (["new"], None, "def"), "y": (["keep"], "cat", None)}


def test_ego_and_overview(spark, tiny):
    centre = spark.createDataFrame([("e",)], "id string")
    got = {(r.src, r.dst) for r in paths.ego(tiny, centre, 1).collect()}
    assert got == {("53", "e"), ("c", "53")}
    assert {(r.src, r.dst) for r in paths.ego(tiny, centre, 1, strict=True).collect()} == {("53", "e")}


def test_entities_hide_values_hashes_and_administration(spark):
    rows = [("a", "T", False), ("b", "T", True), ("0" * 32, "T", None), ("c", "SchemaMeta", None), ("d", "Cond", None), (None, "T", None)]
    nodes = spark.createDataFrame(rows, "id string, label string, is_value boolean")
    assert {r.id for r in model.entities(nodes).collect()} == {"a"}
    assert {r.id for r in model.entities(nodes, facts=True).collect()} == {"a", "d"}


def test_updates_and_deletes(spark, tiny):
    nodes = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "T")], "id string, label string")
    left, edges = model.delete_nodes(nodes, tiny, nodes.where("id = 'b'"))
    assert {r.id for r in left.collect()} == {"a", "c"} and not any("b" in (r.src, r.dst) for r in edges.collect())
    changed = model.upsert(nodes, spark.createDataFrame([("a", "U"), ("z", "U")], "id string, label string"), ["id"])
    assert {(r.id, r.label) for r in changed.collect()} == {("a", "U"), ("b", "T"), ("c", "T"), ("z", "U")}
    assert model.delete_edges(tiny, edges_of(spark, [("a", "any", "b")])).count() == 5
    assert {r.label for r in model.relabel(nodes, spark.createDataFrame([("a", "V")], "id string, label string")).collect()} == {"T", "V"}


def test_fuzzy_pairs_match_brute_force(spark):
    import random

    rng = random.Random(0)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(150)})
    got = {(r.a, r.b, r.distance) for r in linking.fuzzy_pairs(spark.createDataFrame([(n, "T") for n in names], "id string, label string")).collect()}

    def distance(x, y):
        before = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            now = [i]
            for j, b in enumerate(y, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
            before = now
        return before[-1]

    want = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if min(len(a), len(b)) >= 4 and 0 < (d := distance(a, b)) <= min(2, max(1, int(0.2 * min(len(a), len(b))))):
                want.add((a, b, d))
    assert got == want


def tables(spark):
    return {
        "chunks": spark.createDataFrame([("k1", "s", 1, "t1"), ("k2", "s", 2, "t2"), ("k3", "r", 1, "t3")], "chunk_id string, source string, page int, text string"),
        "mentions": spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "a")], "chunk_id string, node_id string"),
        "nodes": spark.createDataFrame([("a", "T"), ("b", "T")], "id string, label string"),
        "edges": spark.createDataFrame([("a", "R", "b", 1, ["k2"]), ("b", "R", "a", 1, ["k1", "k2"]), ("a", "X", "a", 1, None)], EDGE),
    }


def test_pruning_removes_what_nothing_holds(spark):
    t = tables(spark)
    out = maintain.prune(t, t["chunks"].where("chunk_id = 'k2'"))
    assert {(r.src, r.type, tuple(r.source_chunks or ())) for r in out["edges"].collect()} == {("b", "R", ("k1",)), ("a", "X", ())}
    assert {r.id for r in out["orphans"].collect()} == set()
    out = maintain.prune(t, t["chunks"].where("chunk_id IN ('k1', 'k2')"))
    assert {r.id for r in out["orphans"].collect()} == {"b"} and {r.id for r in out["nodes"].collect()} == {"a"}


def test_delta_parts_the_new_version(spark):
    old, new = (spark.createDataFrame([(x,) for x in s], "chunk_id string") for s in ("abc", "bcd"))
    assert {(r.chunk_id, r.change) for r in maintain.delta(old, new).collect()} == {("a", "removed"), ("b", "unchanged"), ("c", "unchanged"), ("d", "added")}


def test_updating_to_the_same_version_changes_nothing(spark):
    t = tables(spark)
    nothing = (spark.createDataFrame([], "src string, type string, dst string, chunk_id string"), spark.createDataFrame([], "chunk_id string, node_id string"))
    out = maintain.update_document(t, "s", t["chunks"].where("source = 's'"), lambda _: nothing)
    for name in ("chunks", "mentions", "nodes"):
        assert sorted(map(tuple, out[name].collect())) == sorted(map(tuple, t[name].collect()))
    assert out["edges"].count() == 3


def test_vectors_follow_their_document(spark):
    stored = spark.createDataFrame([("k1", "s", 1.0), ("k2", "s", 2.0), ("k9", "r", 9.0)], "chunk_id string, source string, v double")
    now = spark.createDataFrame([("k2", "s", 20.0), ("k3", "s", 3.0)], "chunk_id string, source string, v double")
    assert {(r.chunk_id, r.v) for r in maintain.sync_vectors(stored, now, "s").collect()} == {("k2", 2.0), ("k3", 3.0), ("k9", 9.0)}
