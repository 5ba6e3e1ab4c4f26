import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataweave.llm import packing, token_counts, token_files
from strataweave.llm.tokens import BatchEncoder, byte_bpe_path


@pytest.fixture(scope="module")
def coder():
    return BatchEncoder(byte_bpe_path())


LIBRARY = Tokenizer.from_file(byte_bpe_path())


def one_by_one(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def as_lists(coder, texts):
    ids, starts = coder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]


def test_batches_encode_like_single_texts(coder):
    rng = random.Random(0)
    signs = " '  \n\t's tredvlmLL'reéß1²9!?.-日本 　<|endoftext|>😀́\x00\x1c\x85 ١"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", " ", "a" * 5000]
    assert as_lists(coder, texts) == one_by_one(texts)


def test_added_tokens_long_texts_and_texts_of_equal_polynomial_hash(coder):
    thue_morse, swap = "a", str.maketrans("ab", "ba")
    while len(thue_morse) < 2048:
        thue_morse += thue_morse.translate(swap)
    texts = ["<|endoftext|> hi", "x<|endoftext|>\n<|endoftext|>", "<|endoftext", thue_morse[:1024], thue_morse[:1024].translate(swap), thue_morse, thue_morse.translate(swap)]
    texts += ["word and more words " * 60_000, "x" * 20_000 + " <|endoftext|> " + "and on " * 90_000]
    assert as_lists(coder, texts) == one_by_one(texts)


def test_small_pieces_and_a_small_memory_change_nothing():
    small = BatchEncoder(byte_bpe_path(), words=20, piece=50)
    texts = ["it's we'll they're 100% of the time " * 20, "", "no\n\n\nspace", "y" * 300]
    assert as_lists(small, texts) == one_by_one(texts)


def test_histogram_answers_every_limit(spark, coder, messy, clashing, empty):
    sums = token_counts.suffix_sums(token_counts.length_histogram(clashing, byte_bpe_path())).cache()
    lengths = sorted(len(i) for i in one_by_one([r.text for r in messy.collect()]))
    assert {r.n_tokens: r.n_docs for r in sums.collect()} == Counter(lengths)
    for r in sums.collect():
        assert r.tokens_truncated == sum(min(n, r.n_tokens) for n in lengths)
        assert (r.docs_within, r.docs_beyond) == (sum(n <= r.n_tokens for n in lengths), sum(n > r.n_tokens for n in lengths))
        assert r.tokens_total == sum(lengths)
    for limit in (0, 3, 17, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(n, limit) for n in lengths)
    assert token_counts.length_quantile(sums, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(empty, byte_bpe_path())).count() == 0


def test_the_level_rule_minimises_the_sum_of_squares():
    rng = random.Random(1)
    for _ in range(300):
        bins = packing.SumOfSquares(12)
        for h in range(1, 12):
            bins.counts[h] = rng.choice([0, 0, 1, 2, 5])
        size = rng.randint(1, 12)

        def cost(level):
            n = bins.counts.copy()
            if level:
                n[level] -= 1
            n[level + size] += 1
            return int((n[1:12] ** 2).sum())

        possible = [0] + [h for h in range(1, 13 - size) if bins.counts[h]]
        assert cost(bins.level_for(size)) == min(map(cost, possible))


def test_packing_places_each_id_once(spark, coder, messy, clashing, empty):
    pieces = packing.pack(clashing.repartition(2), byte_bpe_path(), 256).collect()
    ids = Counter()
    for r, coded in zip(messy.collect(), one_by_one([r.text for r in messy.collect()])):
        whole = np.array([*coded, 0], np.uint32)
        ids[r.doc_id] += len(whole)
        for p in pieces:
            if p.doc_id == r.doc_id and p.doc_tokens == len(whole):
                assert p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes())
    assert sum(p.length for p in pieces) == sum(ids.values())
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 256
    assert sum(n < 256 for n in fill.values()) <= 2
    assert packing.pack(empty, byte_bpe_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_bit_packing_round_trip(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (token_files.unpack_bits(data, bits, len(ids)) == ids).all()


def test_any_doc_id_comes_back_from_token_files(spark):
    rows = [(-1, "one"), (None, "two"), (0, "three"), (-5, "four"), (7, "b"), (7, "a"), (7, "a"), (None, None)]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), byte_bpe_path()).collect())
    assert [g[1] for g in got] == [None, None, -5, -1, 0, 7, 7, 7]
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), byte_bpe_path()).collect()
    assert sorted((p.doc_id is not None, p.doc_id or 0) for p in pieces) == sorted((r[0] is not None, r[0] or 0) for r in rows)


def test_token_files_round_trip_and_random_access(spark, coder, messy, clashing, empty, tmp_path):
    files = token_files.write_token_files(clashing, f"file://{tmp_path}/out", byte_bpe_path(), block=100)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files).collect())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.doc_id, c) for r, c in zip(messy.collect(), one_by_one([r.text for r in messy.collect()])))
    expected, start = [], 0
    for _, doc_id, coded in rows:
        whole = np.array([*coded, 0], np.uint32)
        expected.append((start, doc_id, len(whole), zlib.crc32(whole.tobytes())))
        start += len(whole)
    assert [g[1:] for g in got] == [e[1:] for e in expected] and [g[0] for g in got] == [e[0] for e in expected]
    path = max(files.collect(), key=lambda r: r.n_ids).path
    file = token_files.TokenFile(path)
    everything = np.concatenate(list(file.blocks()))
    for begin, n in ((0, 1), (99, 3), (250, 400), (file.n_ids - 5, 5), (7, 0)):
        assert (file.read(begin, n) == everything[begin : begin + n]).all()
    assert token_files.round_trip(empty, byte_bpe_path()).count() == 0
