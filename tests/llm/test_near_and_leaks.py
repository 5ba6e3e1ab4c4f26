import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataweave.llm import decontaminate as dc
from strataweave.llm import ngram_join as nj
from strataweave.llm.components import components


def brute_join(rows):
    sets = [frozenset(nj.shingle_set(t).tolist()) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    parent = {s: s for s in kinds}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = Counter()
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if 10 * len(a & b) >= 8 * len(a | b):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for (doc_id, _), s in zip(rows, sets):
        if s:
            members[find(s)].append(doc_id)
    out = Counter()
    for (doc_id, _), s in zip(rows, sets):
        if s:
            m = members[find(s)]
            out[(doc_id, min((d for d in m if d is not None), default=None), len(m), sets.count(s), links[s])] += 1
        else:
            out[(doc_id, doc_id, 1, 1, 0)] += 1
    return out


@pytest.fixture(scope="module")
def near(messy):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 + 20 * g + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_join_matches_brute_force(spark, near, block):
    docs = spark.createDataFrame(near, "doc_id long, text string")
    found = nj.near_duplicates(docs, block_sets=block).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.same_set, r.links) for r in found) == brute_join(near)


@pytest.mark.parametrize("block", [1024, 1])
def test_rows_without_doc_id_link(spark, block):
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "end"])), (7, " ".join([*words, "more"])), (None, " ".join(other)), (None, " ".join([*other, "end"])), (None, " ".join([*other, "end"]))]
    found = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_sets=block).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.same_set, r.links) for r in found) == brute_join(rows)
    assert sorted(r.links for r in found) == [1, 1, 1, 2, 2, 2]


def test_join_of_odd_tables(spark, clashing, empty):
    assert nj.near_duplicates(empty).count() == 0
    kept = nj.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, None, 6, 7, 8}


def test_only_the_near_copies_go(spark):
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join([*words, "end"]), " ".join(f"v{i}" for i in range(60))
    rows = [(1, " ".join(words)), (2, near), (2, other), (None, near + " too"), (None, other + " more"), (None, "alone here"), (-4, other + " again")]
    kept = nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([rows[0], rows[5], rows[6]])


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        components(chain, most_rounds=1).count()


def test_pruning_keeps_similar_pairs():
    least = nj.least_agreements(0.8, 1e-6)
    assert all(0 < m < n for n, m in least.items())
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**32, nj.HASHES, dtype=np.uint64).astype(np.uint32)
    near = base.copy()
    near[::6] = 1
    far = rng.integers(0, 2**32, nj.HASHES, dtype=np.uint64).astype(np.uint32)
    assert nj.bucket_forest(np.stack([base, far, near]), least).tolist() == [0, 1, 0]


def test_components_of_a_chain_and_loops(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("900", "900"), ("901", "902")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(61)}, "900": "900", "901": "901", "902": "901"}


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_leaks_with_edits_match_brute_force():
    rng = random.Random(1)
    letters = "abcde fgh"
    items = [(i, dc.plain("".join(rng.choice(letters) for _ in range(rng.randint(60, 200))))) for i in range(12)]
    index = dc.ItemIndex(items, 12, 0.05)
    for _ in range(60):
        k = rng.randrange(len(items))
        budget = dc.edit_budget(len(items[k][1]), 0.05)
        changed = list(items[k][1])
        for _ in range(rng.randint(0, budget + 2)):
            at = rng.randrange(len(changed))
            rng.choice([lambda: changed.__setitem__(at, "z"), lambda: changed.pop(at), lambda: changed.insert(at, "y")])()
        text = dc.plain("".join(rng.choice(letters) for _ in range(120)) + " " + "".join(changed) + " tail of the text")
        true = distance(items[k][1], text)
        found = [f for f in index.leaks([text])[0] if f[0] == items[k][0]]
        assert bool(found) == (true <= budget)
        if found:
            assert found[0][3] == true and distance(items[k][1], text[found[0][1] : found[0][2]]) == true


def test_short_items_match_brute_force():
    rng = random.Random(2)
    items = [(m, dc.plain("".join(rng.choice("abcdefgh") for _ in range(m)))) for m in (3, 5, 8, 11, 12, 15, 19, 20, 21, 22, 23, 24, 30, 39, 40)]
    index = dc.Items(items, 12, 0.05)
    for _ in range(300):
        m, item = rng.choice(items)
        changed = list(item)
        for _ in range(rng.choice([0, 0, 1, 2])):
            changed[rng.randrange(len(changed))] = rng.choice("xyz")
        text = dc.plain(rng.choice(["", "zz", "zz "]) + "".join(changed) + rng.choice(["", "y", " y"]))
        found = {f[0] for f in index.leaks([text])[0]}
        for k, t in items:
            want = bool(re.search(rf"(?<!\w){t}(?!\w)", text)) if k < 12 else distance(t, text) <= dc.edit_budget(k, 0.05)
            assert (k in found) == want, (k, t, text)


def test_many_hits_of_one_gram_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(dc, "_HITS", 50)
    items = [(i, "a" * 40) for i in range(30)] + [(99, "the quick brown fox jumps over it")]
    texts = ["a" * 700, "b" * 50, "see the quick brown fox jumps over it now"]
    found = dc.Items(items, 12, 0.05).leaks(texts)
    assert [[f[0] for f in g] for g in found] == [list(range(30)), [], [99]]


def test_decontamination_of_odd_tables(spark, clashing, empty):
    bench = spark.createDataFrame([(1, "Quick  BROWN fox jumps over"), (2, None), (3, "short"), (4, ""), (5, "quick brown fox jumps over")], "item_id long, text string")
    rows = {(r.doc_id, r.contaminated, r.n_items, tuple(r.item_ids)) for r in dc.report(clashing, bench).collect()}
    assert {r for r in rows if r[1]} == {(i, True, 2, (1, 5)) for i in (1, 2, 5)}
    kept = dc.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {3, 4, None, 6, 7, 8}
    assert dc.report(empty, bench).count() == 0
    assert dc.report(clashing, bench.limit(0)).where("contaminated").count() == 0
    split = dc.find_leaks(clashing.select("doc_id", "text"), bench, block_chars=10)
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in split.collect() if r.leaks}[1] == [1, 5]


def test_items_without_id_come_last_and_long_texts_are_searched_whole(spark):
    items = spark.createDataFrame([(None, "the secret passage about seven green bottles"), (3, "another item with enough letters in it"), (None, "another item with enough letters in it")], "item_id long, text string")
    leak = "xx the secret passage about seven green bottles yy another item with enough letters in it zz"
    far = "filler words " * 90_000 + leak
    docs = spark.createDataFrame([(1, leak), (2, far), (3, "clean")], "doc_id long, text string")
    found = {r.doc_id: r.item_ids for r in dc.report(docs, items).collect()}
    assert found == {1: [3, None, None], 2: [3, None, None], 3: []}
    assert [r.doc_id for r in dc.drop_contaminated(docs, items).collect()] == [3]


def test_of_repeated_rows_one_stays(spark):
    a = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i % 7919}" for i in range(120_000))
    rows = [(1, a)] * 3 + [(2, a + " end")] + [(3, None)] * 2 + [(4, "")] * 2 + [(5, "other words of its own here")] * 2 + [(6, long), (7, long + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id, r.text is not None and len(r.text)) for r in nj.keep_one(docs).collect())
    assert kept == [(1, len(a)), (3, False), (3, False), (4, 0), (4, 0), (5, 27), (6, len(long))]
    clash = docs.selectExpr("*", "1 AS row", "2 AS goes")
    assert nj.keep_one(clash).count() == 7 and nj.keep_one(clash).columns == clash.columns
