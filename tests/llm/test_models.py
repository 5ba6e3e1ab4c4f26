import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import boosting, pii, toxicity

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check_pii(docs):
    rows = docs.collect()
    expected = Counter()
    for r in rows:
        spans = base_spans(r.text or "")
        n = Counter(s[3] for s in spans)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        expected[(r.doc_id, *(n[k] for k in BASE), hashlib.sha256(joined.encode()).hexdigest())] += 1
    found = pii.digest(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == expected
    assert all(r.has_pii == (r.spans != "") for r in found)
    texts = {r.doc_id: r.text or "" for r in rows}
    for r in found:
        assert {f"{k}:{a}:{b}" for a, _, b, k in base_spans(texts[r.doc_id])} <= set(r.spans.split(","))


def test_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "x", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "-", "+", "é", "😀", "12", "5500005555555559", "a%", "_b@c.d", "\n", "(at)", "1", "..", "+12", "()"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "1" * 30_000, "a.b" * 9_000 + "@x.y" + ".z" * 9_000, "a" * 60_000, "+1" + "(" * 30_000 + "2", "1 " * 9_000]
    check_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_trees_know_real_cards_by_their_looks(spark):
    """Valid cards are introduced and grouped, other digits are not; the checksum is no feature."""
    rng = random.Random(8)

    def card(good):
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if luhn(d) == good:
                return d

    rows = []
    for i in range(600):
        d = card(i % 2 == 0)
        rows.append((i, f"pay by card {d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]} now" if i % 2 == 0 else f"build{rng.choice('xyz')} {d}{rng.choice(['a', 'b', ' '])}done"))
    trained = pii.train(pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")))
    n, share, recall = trained.measured["card"]
    assert n > 150 and 0.4 < share < 0.7 and recall > 0.9 and trained.thresholds["card"] < 1
    assert trained.thresholds["ip"] == 2.0  # nothing to calibrate on
    assert not {"digits", "checksum", "largest", "length"} & set(pii.FEATURES)


def test_trees_and_thresholds_count_every_candidate(spark):
    """7,000 different cards and a card in 2,000 places: no bound on what trains and calibrates."""
    rows = spark.range(9000).selectExpr("id AS doc_id", "concat('card ', if(id < 7000, cast(4000000000000000 + id * 7 AS string), '4111111111111111'), ' or +49 170 1234567') AS text")
    found = pii.candidates(rows)
    base = found.where("match IS NOT NULL AND base AND kind IN ('card', 'phone')")
    expected = {r.kind: (r.n, r.y) for r in base.where("pmod(xxhash64(match), 5) >= 3").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("int")).alias("y")).collect()}
    measured = pii.train(found).measured
    assert {k: (n, round(n * share)) for k, (n, share, _) in measured.items() if n} == expected
    assert base.count() == 27_000 and sum(n for n, _ in expected.values()) > 6_000


def test_trees_fitted_by_sums_are_those_of_the_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, size=(900, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 4) | (x[:, 2] == 0)).astype(int)
    table = Counter((*r, v) for r, v in zip(map(tuple, x.tolist()), y.tolist()))
    rows = spark.createDataFrame([(a, b, c, n, n * v) for (a, b, c, v), n in table.items()], "a double, b double, c double, n long, y long")
    one, other = boosting.fit(["a", "b", "c"], x, y, rounds=4), boosting.fit_rows(["a", "b", "c"], rows, rounds=4)
    assert one.base == other.base and len(other.trees) == 4
    assert np.allclose(one.margin(x), other.margin(x), atol=1e-3)
    assert boosting.fit_rows(["a"], rows.where("false")).trees == [] and boosting.fit_rows(["a"], rows.where("y = 0")).trees == []


def test_pii_of_odd_tables(spark, messy, clashing, empty):
    assert pii.digest(clashing).count() == messy.count()
    assert pii.digest(empty).count() == 0
    redacted = {r.doc_id: r.text for r in pii.redact(messy).collect()}
    assert redacted[8] == "ünïcödé 日本語 😀 text with <email> and <card>" and redacted[1].startswith("The quick")


def test_trees_score_the_same_as_expressions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    model = boosting.fit(["a", "b", "c"], x, y)
    p = 1 / (1 + np.exp(-model.margin(x)))
    assert ((p > 0.5) == (y > 0)).mean() > 0.95
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double").select(model.probability({c: F.col(c) for c in "abc"}).alias("p")).collect()
    assert np.allclose([r.p for r in rows], p[:50])
    assert boosting.calibrated_threshold(np.array([0.9, 0.8, 0.7]), np.array([1, 1, 0]), 0.99) == 0.8
    assert boosting.calibrated_threshold(np.array([0.9]), np.array([0]), 0.99) == 2.0


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    syllables = ["tha", "on", "er", "ing", "re", "sti", "nd", "wh", "ble", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["rotten", "filthy", "vermin", "wicked"]
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_toxicity(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(5, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.classify(docs, toxicity.train(docs, labels)).collect()
    truth = {i: y for i, _, y in labelled}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    test = [r for r in found if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.9


def test_labels_of_held_out_rows_are_not_used(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled[:200]], "doc_id long, text string")
    labels = lambda flip: spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in labelled[:200]], "doc_id long, toxic int")
    a, b = (toxicity.train(docs, labels(f)) for f in (False, True))
    assert a.dictionaries.toxic == b.dictionaries.toxic and (a.weights == b.weights).all()


def test_dictionaries_train_on_windows_of_one_class_in_several_surroundings(spark):
    rows = [("alpha good beta", 0, False), ("gamma good delta", 0, False), ("alpha bad beta", 1, False), ("gamma bad delta", 1, False), ("same vile words", 1, False), ("same vile words again", 1, False)]
    found = toxicity._windows(spark.createDataFrame(rows, "text string, toxic int, calibrates boolean"), 10)
    around = Counter()  # brute force: different neighbours of each window by class
    for w in {w for t, _, _ in rows for w in t.split()}:
        for y in (0, 1):
            around[w, y] = len({(["", *t.split()][i], [*t.split(), ""][i + 1]) for t, z, _ in rows if z == y for i, v in enumerate(t.split()) if v == w})
    expected = {(w, y, n) for (w, y), n in around.items() if n >= 2 and not around[w, 1 - y]}
    assert set(found) == expected and {w for w, _, _ in found} == {"good", "bad", "words"}


def test_gaps_are_differences_of_compressed_lengths():
    import zstandard

    rng = random.Random(5)
    plain = [("".join(rng.choice("abcdefgh") for _ in range(7)), 9) for _ in range(400)]
    toxic = [("".join(rng.choice("stuvwxyz") for _ in range(7)), 9) for _ in range(400)]
    d = toxicity.train_dictionaries(plain, toxic)
    assert d.trained
    asked = [plain[0][0], toxic[0][0], "other", "other"]
    lengths = []
    for content in (d.ordinary, d.toxic):
        settings = zstandard.ZstdCompressionParameters.from_level(d.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=settings)
        lengths.append([len(one.compress(f" {w} ".encode() + b"\n" * 8)) for w in asked])
    assert d.gaps(asked).tolist() == [a - b for a, b in zip(*lengths)]
    assert np.median(d.gaps([w for w, _ in toxic])) > 2 > -2 > np.median(d.gaps([w for w, _ in plain]))


def test_long_texts_are_scored_whole(labelled):
    d = toxicity.Dictionaries(b"plain words", b" horrid ")
    whole = "plain " * 200_000
    a, b = d.features([whole + " horrid", whole])
    assert a[-1] > b[-1] and [sum(map(len, toxicity.words(t))) for t in (whole, "x" * 900_000, "")] == [200_000, 1, 0]


def test_toxicity_of_odd_tables(spark, messy, clashing, empty, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int"))
    rows = toxicity.classify(clashing, model).collect()
    assert len(rows) == messy.count()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[3] == scores[4] and scores[1] == scores[2]
    kept = toxicity.drop_toxic(clashing, model)
    assert kept.columns == clashing.columns
    assert toxicity.classify(empty, model).count() == 0
    for ys in ([], [0] * 5, [1] * 5):
        labels = spark.createDataFrame(list(enumerate(ys)), "doc_id long, toxic int")
        constant = toxicity.train(docs, labels)
        found = constant.scores(["", "anything at all"])
        assert found[0] == found[1] and (found[0] > 0.5) == (sum(ys) > 0)
