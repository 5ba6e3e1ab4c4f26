import random
import re
from collections import Counter

import pytest

from strataweave.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words=3, least=2, share=50, top=2000):
    """``{(lang, rank): (phrase, a, l, r, n, score)}`` of pairs (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for k in range(1, words + 1):
                for i in range(len(found) - k + 1):
                    f[lang, tuple(found[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for lang in n:
        kept = []
        for (spoken, p), a in candidates.items():
            if spoken != lang:
                continue
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(o == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), b in candidates.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({(r["lang"], r["rank"]) for r in rows}) == len(rows)
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "über", "ÜBER", "a", "x\x00y", "né e", "日本", "b\x1cb", "\x85"]
    breaks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", "!? "]
    return [("".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("words, least, share, top", [(2, 2, 50, 2000), (3, 3, 50, 40), (3, 2, 80, 2000), (4, 2, 30, 2000)])
def test_same_as_brute_force(spark, words, least, share, top):
    rows = corpus(words)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert as_dict(co.collocations(docs, words, least, share, top)) == brute(rows, words, least, share, top)


def test_full_bit_arrays_and_small_slices_change_nothing(spark, monkeypatch):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(co, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(co, "BITS", 1)
    monkeypatch.setattr(co, "_SLICE", 50)
    monkeypatch.setattr(co, "_ROWS", 7)
    assert as_dict(co.collocations(docs, 3, 2)) == brute(rows, 3, 2)


def test_messy_clashing_and_empty_tables(messy, clashing, empty):
    rows = [(r.text, r.lang) for r in messy.collect()]
    expected = brute(rows, 3, 2)
    assert expected
    assert as_dict(co.collocations(messy, 3, 2)) == expected
    clash = clashing.selectExpr("*", "'p' AS phrase", "1 AS n", "2 AS a", "3 AS `rank`", "4 AS place")
    assert as_dict(co.collocations(clash, 3, 2)) == expected
    assert co.collocations(empty, 3, 2).count() == 0


def test_a_long_text_is_counted_whole(spark):
    text = ("to be or not, " * 400_000) + "at the end at the end"
    found = as_dict(co.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), 3, 2))
    assert found == brute([(text, "en")], 3, 2)


def test_scores_beyond_64_bits(spark):
    huge = 3_000_000_000
    tables = [
        spark.createDataFrame([("en", "a", 4 * huge), ("en", "b", 5 * huge)], "lang string, phrase string, n long"),
        spark.createDataFrame([("en", "a b", 3 * huge)], "lang string, phrase string, n long"),
    ]
    row = co.scored(tables, 10).collect()[0]
    assert row.score == 1000000 * (3 * huge) ** 2 // (4 * huge * 5 * huge)
