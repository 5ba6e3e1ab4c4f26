import json

import numpy as np
import pytest

from strataweave.operators import cascade

EDGES = "src string, type string, dst string, extraction_count long, source_chunks array<string>"


def judge():
    """Says yes to names that begin alike; writes nonsense about one pair. Made here, so that workers get it by value."""

    class Judge:
        def complete(self, prompts):
            out = []
            for p in prompts:
                a, b = (next(line for line in p.split("\n") if line.startswith(f"{c}: "))[3:].split(" (")[0] for c in "AB")
                out.append("no idea" if "odd" in a + b else "so: " + json.dumps({"same": a[:2] == b[:2], "reason": p.split("\n")[1]}))
            return out

    return Judge()


def vectors():
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0]

    def near(i, cosine, j):
        return [float(x) for x in cosine * axes[i] + (1 - cosine**2) ** 0.5 * axes[j]]

    return near


@pytest.fixture(scope="module")
def names(spark):
    near = vectors()
    rows = [
        ("Pump", "T", 0.9, near(0, 1, 1)),
        ("pump ", "T", 0.1, None),
        ("valve unit", "T", 0.5, near(1, 1, 2)),
        ("valve unlt", "T", 0.1, near(2, 1, 3)),  # near by letters
        ("pressure tank", "T", 0.5, near(3, 1, 4)),
        ("holding vessel", "T", 0.3, near(3, 0.97, 5)),  # sure by vector
        ("feed line", "T", 0.5, near(4, 1, 5)),
        ("feeding pipe", "T", 0.2, near(4, 0.9, 6)),  # for the judge: yes
        ("drain", "T", 0.2, near(6, 1, 7)),
        ("outlet", "T", 0.1, near(6, 0.9, 8)),  # for the judge: no
        ("motor", "T", 0.4, near(7, 1, 8)),
        ("motive part", "U", 0.3, near(7, 0.99, 9)),  # another label: the judge says yes
        ("odd thing", "T", 0.4, near(9, 1, 10)),
        ("strange item", "T", 0.3, near(9, 0.9, 11)),  # the judge can't be read
        ("version 1", "T", 0.4, near(10, 1, 11)),
        ("version 2", "T", 0.3, near(10, 0.99, 11)),  # other numbers
        ("100円", "T", 0.3, near(11, 1, 0)),
        ("101円", "T", 0.3, near(11, 0.99, 0)),
        ("cooling tower", "T", 0.3, near(5, 1, 0)),
        ("cooling tower roof", "T", 0.3, near(5, 0.99, 1)),  # contained
    ]
    return spark.createDataFrame(rows, "id string, label string, pagerank double, embedding array<double>")


def test_each_stage_decides_what_it_should(spark, names):
    edges = spark.createDataFrame([("feed line", "FEEDS", "Pump", 1, None), ("feeding pipe", "FEEDS", "Pump", 2, None), ("pump ", "HAS", "valve unlt", 1, None)], EDGES)
    linked = cascade.link(names, edges, judge())
    ledger = {(r.a, r.b): (r.stage, r.verdict) for r in linked.ledger.collect()}
    assert ledger[("Pump", "pump ")] == ("normal", "same")
    assert ledger[("valve unit", "valve unlt")] == ("fuzzy", "same")
    assert ledger[("holding vessel", "pressure tank")] == ("vector", "same")
    assert ledger[("feed line", "feeding pipe")] == ("judge", "same")
    assert ledger[("drain", "outlet")] == ("judge", "other")
    assert ledger[("motive part", "motor")] == ("judge", "same")
    assert ledger[("odd thing", "strange item")] == ("judge", "open")
    assert ledger[("version 1", "version 2")][1] == "apart: numbers"
    assert ledger[("100円", "101円")][1] == "apart: numeric"
    assert ledger[("cooling tower", "cooling tower roof")][1] == "apart: contained"
    mapping = {r.old: r.new for r in linked.mapping.collect()}
    assert mapping == {"pump ": "Pump", "valve unlt": "valve unit", "holding vessel": "pressure tank", "feeding pipe": "feed line", "motive part": "motor"}
    report = {r.what: r.n for r in linked.report.collect()}
    assert report["names merged"] == report["clusters"] == 5 and report["names"] == 20 and report["pairs: judge: same"] == 2
    nodes, moved = cascade.merged_graph(names, edges, linked)
    assert nodes.count() == 15 and {(r.src, r.dst, r.extraction_count) for r in moved.collect()} == {("feed line", "Pump", 3), ("Pump", "valve unit", 1)}


def test_without_a_judge_its_pairs_stay_open(spark, names):
    ledger = cascade.link(names, spark.createDataFrame([], EDGES)).ledger
    assert {(r.a, r.b) for r in ledger.where("verdict = 'open'").collect()} == {("feed line", "feeding pipe"), ("drain", "outlet"), ("motive part", "motor"), ("odd thing", "strange item")}


def test_no_chains_no_large_clusters_and_no_two_numbers(spark):
    def run(rows):
        return cascade.link(spark.createDataFrame(rows, "id string, label string, pagerank double"), spark.createDataFrame([], EDGES))

    # each is one letter from the next: the ends are not joined through the middle
    chain = run([("abcdefgh", "T", 0.9), ("abcdxfgh", "T", 0.5), ("abcdxfyh", "T", 0.4), ("abzdxfyh", "T", 0.3), ("qbzdxfyh", "T", 0.2)])
    mapping = {r.old: r.new for r in chain.mapping.collect()}
    assert mapping["abcdxfgh"] == "abcdefgh" and mapping.get("qbzdxfyh") != "abcdefgh"
    crowd = run([(f"{'k' * i}x{'k' * (11 - i)}", "T", float(i)) for i in range(10)])
    assert crowd.mapping.count() == 0 and [r.used for r in crowd.clusters.collect()] == [False]
    one = run([("plan a 12", "T", 0.9), ("plan b 12", "T", 0.5), ("plan a 13", "T", 0.4)])
    assert {r.old: r.new for r in one.mapping.collect()} == {"plan b 12": "plan a 12"}
    assert run([]).mapping.count() == 0
