import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strataweave.llm import alignment as al
from strataweave.llm.tokens import byte_bpe_path

A = Tokenizer.from_file(byte_bpe_path())
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=al.piece_path())
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def decoded(piece_id):
    piece = B.id_to_piece(piece_id)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(piece_id) else piece.replace("▁", " ").encode()


SIGNS = {}
rest = 0
for byte in range(256):
    if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
        SIGNS[chr(byte)] = byte
    else:
        SIGNS[chr(256 + rest)] = byte
        rest += 1


def groups_of(text):
    """The groups of a text, token by token, from the two libraries and whole texts."""
    whole = (" " + (text or "")).encode()
    a = [(i, bytes(SIGNS[c] for c in A.id_to_token(i))) for i in A.encode(" " + (text or ""), add_special_tokens=False).ids]
    b = [(i, decoded(i)) for i in B.encode(text or "")]
    if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    out, i, j, done_a, done_b, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if done_a <= done_b:
            done_a += len(a[i][1])
            left.append(a[i][0])
            i += 1
        else:
            done_b += len(b[j][1])
            right.append(b[j][0])
            j += 1
        if done_a == done_b:
            out.append((left, right))
            left, right = [], []
    return out


def brute(texts):
    every = [groups_of(t) for t in texts]
    counts = Counter(pair for groups in every for pair in {(x, y) for left, right in groups for x in left for y in right})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups in every:
        links = [(x, y) for left, right in groups for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((sum(len(left) for left, _ in groups), sum(len(right) for _, right in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    units = ["the", "Hello", "tokenization", "naïve", "日本語", "😀", "...", "it's", "<|endoftext|>", "<s>", "<0x0A>", "</s>", "12345", "a", "é́", "\x1c", " ", "ﬁ", "'", "'s", "\x85", "　"]
    breaks = [" ", " ", " ", "  ", "\n", "\t", "", "\r\n", "\xa0"]
    found = ["".join(rng.choice(units) + rng.choice(breaks) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return [*found, " lead", "  two", "trail ", " ", "\n", "x▁y", "a\x00b", "▁", " '", "a 's b", "don 't"]


def result(df):
    return [(r.doc_id, *(r[c] for c in NAMES)) for r in df.collect()]


@pytest.mark.parametrize("block, most_rows", [(1000, 1 << 20), (al.BLOCK, 0)])
def test_same_as_whole_texts_token_by_token(spark, block, most_rows):
    found = texts(block) * 2
    rows = list(enumerate(found))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = result(al.align(docs, byte_bpe_path(), al.piece_path(), block=block, most_rows=most_rows))
    assert sorted(got) == [(i, *figures) for i, figures in enumerate(brute(found))]
    assert sum(r[1] == 0 for r in got) == 4  # the texts with a sign that the pieces take for a space


def test_stretches_are_joined_once_for_all_rounds(spark, monkeypatch):
    """What the blocks are told is read from a table by every round, which is dropped at the end."""
    plans, trip = [], al.first_trip

    def noted(parts, told, *rest):
        plans.append(told._jdf.queryExecution().optimizedPlan().toString())
        return trip(parts, told, *rest)

    monkeypatch.setattr(al, "first_trip", noted)
    found = texts(3)
    got = result(al.align(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string"), byte_bpe_path(), al.piece_path(), block=300))
    assert sorted(got) == [(i, *figures) for i, figures in enumerate(brute(found))]
    assert len(plans) == al.ROUNDS and not any("Join" in p for p in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("told_", "stretches_"))]


def test_messy_clashing_and_empty_tables(messy, clashing, empty):
    rows = messy.collect()
    expected = sorted(((r.doc_id is None, r.doc_id or 0), figures) for r, figures in zip(rows, brute([r.text for r in rows])))
    for docs in (messy, clashing.selectExpr("*", "1 AS block", "2 AS part", "3 AS k", "4 AS a", "5 AS sid")):
        got = result(al.align(docs, byte_bpe_path(), al.piece_path()))
        assert sorted(((r[0] is None, r[0] or 0), r[1:]) for r in got) == expected
    assert al.align(empty, byte_bpe_path(), al.piece_path()).count() == 0


def test_long_texts_with_and_without_spaces(spark):
    found = ["word and more words, " * 30_000, "日本" * 20_000, "x" * 50_000, "short"]
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = result(al.align(docs, byte_bpe_path(), al.piece_path(), block=10_000))
    assert sorted(got) == [(i, *figures) for i, figures in enumerate(brute(found))]


def test_texts_stay_whole_where_a_vocabulary_could_go_on_over_a_space(spark, monkeypatch):
    coder = al.Coder(byte_bpe_path(), al.piece_path())
    assert coder.cuts and coder.stretches("a bc  d\n e ") == ["a", "bc  d\n e "]
    coder.cuts = False
    assert coder.stretches("a bc  d") == ["a bc  d"] and coder.stretches("") == []


def test_a_block_holds_the_pairs_of_different_groups_once():
    """What a block keeps in memory is a number for each group of a stretch; pairs are those of the different groups."""
    groups = ["1,2|3;4|5,6", None, "4|5,6;4|5,6"] * 1000
    table = al.Told(len(groups), list(range(len(groups))), pa.chunked_array([pa.array(groups)]))
    pair = [1 << 32 | 3, 2 << 32 | 3, 4 << 32 | 5, 4 << 32 | 6]
    assert sorted(table.pairs.tolist()) == pair and len(table.ids) == 4000
    figures, pairs, often = table.figures_of(np.array([0, 2, 3, 3], np.int32))
    assert figures == [11, 13, 8, 16]
    assert dict(zip(pairs.tolist(), often.tolist())) == dict(zip(pair, [3, 3, 5, 5]))


def test_blocks_keep_numbers_of_stretches_instead_of_texts(spark):
    found = ["alpha beta beta", None, "", "gamma  alpha ", "beta"]
    rows = al.blocks(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").coalesce(1), byte_bpe_path(), al.piece_path()).collect()
    words = {r.k: r.stretch for r in rows if r.stretch is not None}
    numbers = [(i, ks.tolist()) for i, ks in al._unpacked(pa.chunked_array([pa.array([r.payload for r in rows if r.payload], pa.binary())]))]
    assert numbers == [(0, [0, 1, 1]), (1, []), (2, []), (3, [2]), (4, [1])]
    assert words == {0: "alpha", 1: "beta", 2: "gamma  alpha "}


def test_equal_stretches_across_batches_and_blocks(spark):
    """A stretch whose rows go on in the next batches is encoded once, with all its blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        found = texts(5, 20) + ["the the same", "the"] * 10
        docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").coalesce(2)
        got = result(al.align(docs, byte_bpe_path(), al.piece_path(), block=10))
        assert sorted(got) == [(i, *figures) for i, figures in enumerate(brute(found))]
        uses = spark.createDataFrame([(b, k, w) for b in range(8) for k, w in enumerate(["a", "the"])], "block long, k int, stretch string")
        coded = al.encode_stretches(uses, byte_bpe_path(), al.piece_path()).collect()
        assert sorted(sorted(zip(r.blocks, r.ks)) for r in coded) == [[(b, k) for b in range(8)] for k in (0, 1)] and len({r.key for r in coded}) == 2
    finally:
        spark.conf.set(name, before)
