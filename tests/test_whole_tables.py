"""Registered queries against brute force on small tables whose rows lie past every prefix of ids."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import pytest

from strataweave.plans import registry

NATIONS = [(n, f"N{n}", n % 2) for n in range(5)]
CUSTOMERS = [(1, 3), (2, 1), (7, 3), (120, 0), (260, 3), (505, 4)]
SUPPLIERS = [(3, 3), (900, 2)]
PARTS = [(1, "almond plum", "B1"), (2, "azure rose", "B1"), (450, "almond plums", "B1"), (460, "azure nose", "B1"), (470, "azure rose", "B2"), (999, "lone thing", "B3")]
ORDERS = [(10, 1), (11, 2), (12, 7), (13, 120), (14, 260), (15, 505), (16, 260)]
LINES = [(10, 1, 3), (10, 450, 900), (11, 2, 3), (12, 450, 900), (13, 460, 3), (14, 1, 900), (14, 470, 3), (15, 470, 900), (16, 470, 3), (16, 2, 900)]
DOCUMENTS = [(1, "red fox runs", "en", "src1"), (2, "blue whale sings\nred sky", "en", "src2"), (310, "the answer is Alpha, beta!", "de", "src9"), (345, "slow green turtle", "de", "src9"), (9000, "\n".join(f"line number {i}" for i in range(25)) + "\nquiet fox ＡＢＣ ガス軸受", "fr", "src3")]
TURNS = [(3, 0, "user", "where is the red fox"), (3, 1, "assistant", "blue"), (3, 2, "user", "blue whale whale"), (25, 1, "user", "green turtle alpha"), (777, 0, "user", "nothing matches here"), (777, 4, "user", "red sky line")]
VECTORS = [(v, [1.0 + v % 3, float(v % 5), float(v % 7) - 2]) for v in (3, 25, 299, 301, 340, 777, 778, 900, 1203)]
ITEMS = [(0, "slow green TURTLE."), (5, "alpha beta"), (41, "whale")]
STARTS = ["customer:1", "customer:2", "nation:3"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "region": ([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string"),
        "nation": (NATIONS, "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(c, f"C{c}", n, "SEGMENT") for c, n in CUSTOMERS], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(s, f"S{s}", n) for s, n in SUPPLIERS], "s_suppkey long, s_name string, s_nationkey int"),
        "part": (PARTS, "p_partkey long, p_name string, p_brand string"),
        "orders": (ORDERS, "o_orderkey long, o_custkey long"),
        "lineitem": (LINES, "l_orderkey long, l_partkey long, l_suppkey long"),
    }
    rows |= {
        "documents": (DOCUMENTS, "doc_id long, text string, lang string, source string"),
        "conversations": (TURNS, "conv_id long, turn long, role string, text string"),
        "benchmark": (ITEMS, "item_id long, text string"),
        "embeddings": (VECTORS, "vec_id long, embedding array<float>"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def run(spark, folder, name):
    return registry.QUERIES[name](spark, folder).collect()


def all_edges():
    buyer = dict(ORDERS)
    uses = Counter((f"customer:{buyer[o]}", "USES", f"part:{p}") for o, p, _ in LINES)
    one = [(f"nation:{n}", "PART_OF", f"region:{r}") for n, _, r in NATIONS]
    one += [(f"{kind}:{i}", "BELONGS_TO_CATEGORY", f"nation:{n}") for kind, rows in (("customer", CUSTOMERS), ("supplier", SUPPLIERS)) for i, n in rows]
    one += {(f"supplier:{s}", "HAS_PART", f"part:{p}") for _, p, s in LINES}
    return uses + Counter(one)


def trails(hops):
    edges = list(all_edges().items())
    both = [(e[0], e[2], e[1], i, n) for i, (e, n) in enumerate(edges)] + [(e[2], e[0], e[1], i, n) for i, (e, n) in enumerate(edges)]
    out, walks = [], [([s], [], [], 0) for s in STARTS]
    for _ in range(hops):
        walks = [([*nodes, b], [*types, kind], [*used, i], total + n) for nodes, types, used, total in walks for a, b, kind, i, n in both if a == nodes[-1] and i not in used]
        out += [w for w in walks if w[0][0] != w[0][-1]]
    return out


@pytest.mark.parametrize("hops", [2, 3])
def test_paths_walk_the_whole_graph(spark, folder, hops):
    want = Counter((" ".join(nodes), " ".join(types), len(types), round(total / len(types), 6)) for nodes, types, _, total in trails(hops))
    assert Counter(map(tuple, run(spark, folder, f"paths_{hops}hop"))) == want


def test_one_hop_reaches_every_neighbour(spark, folder):
    want = Counter((s, kind, b if a == s else a, n) for (a, kind, b), n in all_edges().items() for s in STARTS if s in (a, b))
    assert Counter(map(tuple, run(spark, folder, "paths_1hop"))) == want


def test_path_triples_come_from_the_best_trails(spark, folder):
    best = {}
    for nodes, types, _, total in trails(2):
        best[(">".join([*nodes, "#", *types]), tuple(nodes), tuple(types))] = total / len(types)
    first = {}
    for rank, (_, nodes, types) in enumerate(sorted(best, key=lambda k: (-best[k], k[0]))[:50], 1):
        for at, kind in enumerate(types):
            first.setdefault((nodes[at], kind, nodes[at + 1]), rank * 1000 + at)
    assert {(r.start, r.type, r.end): r.ordinal for r in run(spark, folder, "path_triples")} == first


def test_every_edge_is_labelled_and_told(spark, folder):
    want = Counter(all_edges().keys())
    assert Counter((r.start, r.type, r.end) for r in run(spark, folder, "annotated_triples")) == want
    assert all((r.start_type, r.end_type) == (r.start.split(":")[0], r.end.split(":")[0]) for r in run(spark, folder, "annotated_triples") if r.start not in ("customer:120", "customer:260"))
    assert Counter((r.src, r.type, r.dst) for r in run(spark, folder, "triple_sentences")) == want
    assert Counter(r.text for r in run(spark, folder, "relation_documents")) == Counter(f"{s}、k。{s} {kind} {d}" for s, kind, d in want)


def keyword(k):
    split = lambda text: [w for w in re.split(r"[\W_]+", text.lower()) if w]
    docs = {d: split(text) for d, text, *_ in DOCUMENTS}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for words in docs.values() for w in set(words))
    raw = {w: math.log((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    idf = {w: r if r >= 0 else sum(raw.values()) / len(raw) / 4 for w, r in raw.items()}
    out = {}
    for conv, turn, role, text in TURNS:
        if role == "user":
            scores = {d: sum(idf[w] * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for w in split(text) if w in words) for d, words in docs.items()}
            best = sorted((-round(s, 6), d) for d, s in scores.items() if s > 0)[:k]
            out |= {(f"{conv}:{turn}", d): (n, -s) for n, (s, d) in enumerate(best, 1)}
    return out


def test_keyword_search_answers_every_user_turn(spark, folder):
    want = keyword(10)
    assert {q for q, _ in want} >= {"3:0", "3:2", "25:1", "777:4"}
    got = {(r.question_id, r.id): (r.rank, r.score) for r in run(spark, folder, "bm25_topk")}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


@pytest.mark.parametrize("name", ["rerank_overlap", "context_assembly", "wide_results"])
def test_results_of_every_question_with_hits(spark, folder, name):
    assert {r.question_id for r in run(spark, folder, name)} == {q for q, _ in keyword(10)}


def test_fusion_answers_every_user_turn(spark, folder):
    got = run(spark, folder, "rrf_hybrid")
    hits = {q for q, _ in keyword(10)}
    assert {r.question_id for r in got} == {f"{c}:{n}" for c, n, role, _ in TURNS if role == "user"}
    assert all((r.score_type == "rrf") == (r.question_id in hits) for r in got)


def test_fuzzy_pairs_of_all_parts(spark, folder):
    assert {tuple(r) for r in run(spark, folder, "fuzzy_pairs")} == {("B1", "almond plum", "almond plums", 1), ("B1", "azure nose", "azure rose", 1)}


def test_knn_pairs_of_all_vectors(spark, folder):
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    want = {}
    for a, x in VECTORS:
        near = sorted((-dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)), b) for b, y in VECTORS)[:6]
        want |= {(min(a, b), max(a, b)): -s for s, b in near if b != a and -s >= 0.4}
    got = {(r.a, r.b): r.score for r in run(spark, folder, "knn_pairs")}
    assert got.keys() == want.keys() and any(a >= 300 for a, _ in got)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def baskets():
    buyer, out = dict(ORDERS), {}
    for o, p, _ in LINES:
        out.setdefault(buyer[o], []).append((o, p))
    return out


def test_coverage_of_all_customers(spark, folder):
    rows = [(len({p for o, p in b if o % 2 == 0}), len({p for _, p in b})) for b in baskets().values()]
    want = (len(rows), sum(h == g for h, g in rows) / len(rows), sum(h / g for h, g in rows) / len(rows), sum(h for h, _ in rows) / sum(g for _, g in rows))
    assert tuple(run(spark, folder, "coverage")[0]) == pytest.approx(want, abs=1e-8)


def test_recall_of_all_customers(spark, folder):
    shares = []
    for b in baskets().values():
        gold, found = {p for _, p in b}, {p for o, p in b if o % 3}
        shares.append(len(found) / len(gold))  # fewer than five each
    want = (sum(shares) / len(shares), sum(s == 1 for s in shares) / len(shares))
    assert {r.k: (r.recall, r.full) for r in run(spark, folder, "recall_at_k")} == {k: pytest.approx(want, abs=1e-8) for k in (5, 10, 20)}


def test_traces_of_all_customers(spark, folder):
    want = {(c, p, p % 2 == 0, p % 3 == 0) for c, b in baskets().items() for _, p in b}
    assert {(r.question_id, r.id, r.vector, r.graph) for r in run(spark, folder, "route_trace")} == want


def test_answers_of_all_documents_against_all_items(spark, folder):
    form = lambda text: re.sub(r"[\s,.!]", "", text.lower())
    want = {}
    for d, text, lang, _ in DOCUMENTS:
        gold, own = form(ITEMS[d % 3][1]), want.setdefault(lang, [])
        own.append((form(text) == gold, gold in form(text)))
    want = {lang: (len(x), pytest.approx(sum(e for e, _ in x) / len(x)), pytest.approx(sum(c for _, c in x) / len(x))) for lang, x in want.items()}
    assert {r.lang: (r.n, r.exact, r.contained) for r in run(spark, folder, "answer_matches")} == want


def test_keys_are_of_whole_texts(spark, folder):
    want = {d: " ".join(unicodedata.normalize("NFKC", text).lower().split()) for d, text, *_ in DOCUMENTS}
    assert {r.doc_id: r.norm for r in run(spark, folder, "nfkc_keys")} == want


def test_every_chunk_has_its_page_offset(spark, folder):
    ids = {}
    for _, text, _, source in DOCUMENTS:
        ids.setdefault(source, set()).update(hashlib.sha256(f"{source}\n{line}".encode()).hexdigest() for line in text.split("\n"))
    want = {(c, source, n // 20 * 20) for source, all_ in ids.items() for n, c in enumerate(sorted(all_))}
    got = run(spark, folder, "chunk_page_focus")
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def ranks(rounds):
    ids = [f"{kind}:{r[0]}" for kind, rows in (("region", [(0,), (1,)]), ("nation", NATIONS), ("customer", CUSTOMERS), ("supplier", SUPPLIERS), ("part", PARTS)) for r in rows]
    links = {(s, d) for s, _, d in all_edges()}
    out, rank = Counter(s for s, _ in links), dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        loose = sum(r for i, r in rank.items() if not out[i])
        given = Counter()
        for s, d in links:
            given[d] += rank[s] / out[s]
        rank = {i: 0.15 / len(ids) + 0.85 * (given[i] + loose / len(ids)) for i in ids}
    return rank


@pytest.mark.parametrize("name, rounds, near", [("pagerank_fixed_rounds", 5, 2e-9), ("pagerank", 200, 1e-4)])
def test_ranks_of_the_whole_graph(spark, folder, name, rounds, near):
    got = {r.id: r.pagerank for r in run(spark, folder, name)}
    assert got == {i: pytest.approx(r, abs=near) for i, r in ranks(rounds).items()}


def test_components_of_the_whole_graph(spark, folder):
    got = {r.node: r.component for r in run(spark, folder, "connected_components")}
    assert got == {i: i if i == "part:999" else "customer:1" for i in ranks(0)}
