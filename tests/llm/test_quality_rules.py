import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import line_labels as ll
from strataweave.llm import quality_rules as qr


def brute(text):
    """The five counts of a text, one word and one line at a time."""
    text = text or ""
    word = re.compile("[^\\x20\\x09-\\x0D]+")
    words = word.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(bool(word.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def texts(seed, n=150):
    rng = random.Random(seed)
    units = ["a", "b", "ab", "é", "日本", "x#", "|", "<b>", "\x85", "\x1c", "😀", "A.", "7"]
    breaks = [" ", " ", "\n", "\t", "\r\n", "  ", "\x0b", "\n\n", " \n"]
    return ["".join(rng.choice(units[: rng.randint(1, 13)]) + rng.choice(breaks) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " ", "\n", "a"]


def test_counts_are_those_of_brute_force():
    for seed in range(4):
        found = texts(seed)
        m = qr.Measured(found)
        figures = zip(m.n_words.tolist(), m.word_chars.tolist(), m.n_symbols.tolist(), m.n_dup_lines.tolist(), m.n_repeat_words.tolist())
        assert list(figures) == [brute(t) for t in found]
        assert m.lengths.tolist() == [sum(bool(re.search("[^\\x20\\x09-\\x0D]", line)) for line in t.split("\n")) for t in found]
        assert m.lengths.sum() == len(m.features) == len(m.words)


def test_features_do_not_depend_on_the_texts_beside():
    found = texts(7, 30)
    whole = qr.Measured(found)
    alone = [qr.Measured([t]) for t in found]
    assert (whole.features == np.concatenate([m.features for m in alone])).all()
    assert len(qr.Measured([]).n_words) == 0


def random_field(rng, n):
    return ll.Field.unpack(rng.normal(size=n + 8))


def score(field, x, y):
    out = sum(float(x[i] @ field.weights) for i in range(len(y)) if y[i]) + field.first[y[0]] + field.final[y[-1]]
    return out + sum(field.trans[a, b] for a, b in zip(y, y[1:]))


def test_decoding_and_probabilities_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    for _ in range(20):
        field = random_field(rng, 3)
        lengths = rng.integers(0, 6, size=5)
        x = rng.normal(size=(lengths.sum(), 3))
        chains = ll.Chains(lengths)
        total, p, pairs = field.forward_backward(x, chains)
        labels, at = field.decode(x, lengths), 0
        expected_total, expected_pairs, expected_p = 0.0, np.zeros((2, 2)), np.zeros(len(x))
        for n in lengths:
            if n:
                part = x[at : at + n]
                scores = {y: score(field, part, y) for y in itertools.product((0, 1), repeat=int(n))}
                z = math.log(sum(map(math.exp, scores.values())))
                expected_total += z
                assert tuple(labels[at : at + n]) == max(scores, key=scores.get)
                for y, s in scores.items():
                    w = math.exp(s - z)
                    expected_p[at : at + n] += w * np.array(y)
                    for a, b in zip(y, y[1:]):
                        expected_pairs[a, b] += w
            at += n
        assert total == pytest.approx(expected_total)
        placed = np.zeros(len(x))
        placed[chains.line] = p[:, 1]
        assert placed == pytest.approx(expected_p)
        assert pairs == pytest.approx(expected_pairs)


def test_slope_and_fit():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 7, 4])
    x, y = rng.normal(size=(15, 4)), rng.integers(0, 2, 15)
    chains, theta = ll.Chains(lengths), rng.normal(size=12)
    value, slope = ll.likelihood(theta, x, y, lengths, chains, 0.5)
    for i in range(12):
        step = np.zeros(12)
        step[i] = 1e-5
        high, low = (ll.likelihood(theta + s, x, y, lengths, chains, 0.5)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((high - low) / 2e-5, abs=1e-4)
    fitted = ll.fit(x, y, lengths, 0.5)
    assert ll.likelihood(fitted, x, y, lengths, chains, 0.5)[0] < min(value, ll.likelihood(np.zeros(12), x, y, lengths, chains, 0.5)[0])
    assert np.abs(ll.likelihood(fitted, x, y, lengths, chains, 0.5)[1]).max() < 0.01
    assert len(ll.Field.unpack(fitted).decode(x[:0], np.array([], int))) == 0


def corpus(n=240):
    rng = random.Random(3)
    words = "the river bends slowly past old mills where people once ground their corn and talked about weather prices roads".split()

    def good():
        return " ".join(rng.choice(words) for _ in range(rng.randint(8, 25))).capitalize() + "."

    def bad():
        return " | ".join(rng.choice(words).upper() + "$$$" for _ in range(rng.randint(4, 12)))

    rows, labels = [], []
    for i in range(n):
        poor = i % 3 == 0
        lines = [good() for _ in range(rng.randint(1, 3))] + [bad() for _ in range(rng.randint(8, 12))] if poor else [good() for _ in range(rng.randint(2, 8))]
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, 0 if poor else 1))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, qr.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))


def test_lines_of_mixed_documents_are_told_apart(spark, trained):
    docs, rules = trained
    from strataweave.llm.toxicity import held_out

    found = {r.doc_id: r for r in qr.judge(docs, rules).where(held_out(F.col("doc_id"))).collect()}
    assert len(found) > 30
    assert all(r.kept == (i % 3 != 0) for i, r in found.items())
    assert any(0 < r.content_share < 0.5 for r in found.values())  # the good lines of poor documents are content


def test_messy_clashing_and_empty_tables(spark, trained, messy, clashing, empty):
    _, rules = trained
    expected = sorted((r.doc_id is None, r.doc_id or 0, brute(r.text)) for r in messy.collect())
    for docs in (messy, clashing.selectExpr("*", "1 AS n_words", "true AS kept", "2 AS content_share", "3 AS _row")):
        found = qr.judge(docs, rules).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in found) == expected
        for r in found:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and r.content_share >= rules.least)
        kept = qr.keep_good(docs, rules)
        assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert qr.judge(empty, rules).count() == 0


def test_labels_of_one_kind_and_no_labels_keep_what_the_fixed_rules_keep(spark, messy, empty):
    for labels in (spark.createDataFrame([(1, 1), (5, 1), (None, 0), (2, None)], "doc_id long, quality int"), empty.selectExpr("doc_id", "1 AS quality")):
        rules = qr.train(messy, labels)
        assert all(r.kept != r.base_failed for r in qr.judge(messy, rules).collect())


def test_long_texts_slices_and_batches_change_nothing(spark, trained, monkeypatch):
    _, rules = trained
    long = "\n".join(f"Line {i % 5000} of a long text that goes on and on." for i in range(150_000))
    rows = [(i, t) for i, t in enumerate([long, *texts(11, 40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    before = sorted(qr.judge(docs, rules).collect())
    monkeypatch.setattr(qr, "_SLICE", 100)
    assert sorted(qr.judge(docs, rules).collect()) == before
    r = before[0]
    assert (r.n_words, r.n_dup_lines) == (len(long.split()), 145_000) and r.base_failed
