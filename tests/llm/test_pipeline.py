import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from strataweave.llm import queries, toxicity
from strataweave.llm.common import DOCUMENT_COLUMNS
from strataweave.llm.tokens import byte_bpe_path


def test_stages_keep_columns_and_take_effect(spark, messy, tmp_path):
    extra = [(20, "This passage of the benchmark must never be seen in training data, not even once.", "en", "z", 1), (21, "clean text of its own", "en", "z", 1)]
    docs = messy.unionByName(spark.createDataFrame(extra, messy.schema))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "this passage of the benchmark must never be seen")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == DOCUMENT_COLUMNS, name
            out.write.parquet(f"{folder}/stage{i}")
            rows = spark.read.parquet(f"{folder}/stage{i}")
            kept.append(sorted((r.doc_id or 0) for r in rows.collect()))
    assert kept[0] == sorted((r.doc_id or 0) for r in docs.collect())  # nothing is toxic by these labels
    assert kept[1] == [0, 3, 5, 6, 7, 8, 20, 21]
    assert kept[3] == [0, 3, 5, 6, 7, 8, 21]
    assert {r.doc_id for r in out.collect()} == {None, 3, 5, 6, 7, 8, 21}
    assert corpus_pipeline.run(spark, folder).count() == out.count()


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def corpus():
    """Clean and toxic documents, copies up to white space, near copies and leaks, in random order."""
    rng = random.Random(8)
    common = [f"{a}{b}" for a in ("ral", "mon", "tes", "vin", "cor", "bel") for b in ("o", "an", "ith", "und", "ek", "ar", "is")]
    bad = ["scumbag", "idiotic", "trashface", "worthless"]
    passage = "the committee shall publish its annual findings before the end of winter"

    def prose(n):
        return " ".join(rng.choice(common) for _ in range(n))

    texts = [prose(rng.randint(40, 90)) for _ in range(150)]
    toxic = []
    for _ in range(60):
        words = prose(40).split()
        for _ in range(8):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        toxic.append(" ".join(words))
    copies = [t.replace(" ", "  ", 3) for t in texts[:10]] + texts[10:15]
    near = [t + " zz" for t in texts[20:30]]
    leaks = [f"{prose(10)} {passage.upper()} {prose(10)}" for _ in range(6)]
    rows = [(t, 0) for t in texts + copies + near + leaks + ["", "", None]] + [(t, 1) for t in toxic]
    rng.shuffle(rows)
    return [(i, t, "en", "s", len(t or "")) for i, (t, _) in enumerate(rows)], [(i, 1, y) for i, (_, y) in enumerate(rows)], passage


def one_of_equal(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[ \t-\r]", "", r[1] or "")
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    return sorted(best.values())


def one_of_near(rows):
    grams = {}
    for r in rows:
        w = re.findall(r"\w+", (r[1] or "").lower())
        grams[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(grams)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(r for r in rows if find(r[0]) == r[0])


def test_stages_are_those_of_brute_force(spark, tmp_path):
    rows, labels, passage = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = toxicity.classify(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    predicted = {r.doc_id: r.predicted for r in scores.collect()}
    bad = {i for i, _, y in labels if y}
    expected = [r for r in rows if not predicted[r[0]]]
    assert len(bad - {r[0] for r in expected}) > 0.9 * len(bad) and len({r[0] for r in expected} - bad) > 0.95 * (len(rows) - len(bad))
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (None, one_of_equal, one_of_near, lambda some: [r for r in some if passage not in (r[1] or "").lower()])):
        expected = brute(expected) if brute else expected
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((r[0], r[1]) for r in expected), name
    count = Tokenizer.from_file(byte_bpe_path())
    pieces = corpus_pipeline.run(spark, folder).collect()
    lengths = {r[0]: len(count.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in expected}
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in lengths} == lengths and len({p.doc_id for p in pieces}) == len(lengths)
    assert all(sum(p.length for p in pieces if p.sequence_id == s) <= 1024 for s in {p.sequence_id for p in pieces})
