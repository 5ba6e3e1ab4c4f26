import hashlib
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np

import strataweave.llm.induced as induced
from strataweave.llm import suffix_dedup


def starts(segments, depth):
    counts = Counter(s[i : i + depth] for s in segments for i in range(len(s) - depth + 1))
    return [[i for i in range(len(s) - depth + 1) if counts[s[i : i + depth]] > 1] for s in segments]


def test_induced_sorting_matches_brute_force(monkeypatch):
    rng = random.Random(0)
    for trial in range(300):
        # small blocks, queues and base cases: several levels of recursion, runs on disk, keys larger than a block
        monkeypatch.setattr(induced, "BLOCK", rng.choice([3, 7, 1 << 16]))
        monkeypatch.setattr(induced, "HELD", rng.choice([5, 20, 1 << 18]))
        monkeypatch.setattr(induced, "FEW", rng.choice([2, 8, 1 << 16]))
        alphabet = rng.choice([b"ab", b"abc", b"\x00\xffab", bytes(range(256)), b"a"])
        depth = rng.choice([1, 2, 3, 5, 8, 20])
        segments = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.6:
            shared = bytes(rng.choice(alphabet) for _ in range(40))
            segments = [s[:10] + shared[rng.randint(0, 5) :] + s[10:] for s in segments]
        assert [r.tolist() for r in induced.repeated_starts(segments, depth)] == starts(segments, depth)


def test_a_shard_larger_than_memory_is_sorted_on_disk(tmp_path):
    """A process that may take 40 MB more than it has sorts 4 MB of text, which in memory would need ten arrays of 8 bytes a position."""
    script = f"""
import random, resource, sys
sys.path.insert(0, {str(tmp_path.parent)!r}); sys.path.insert(0, {os.getcwd()!r})
import strataweave.llm.induced as induced
induced.BLOCK, induced.HELD, induced.FEW = 1 << 14, 1 << 16, 1 << 15
rng = random.Random(1)
folder = {str(tmp_path)!r}
shard, passage = induced.Shard(folder), rng.randbytes(700)
for i in range(4000):
    shard.add(rng.randbytes(1000) if i % 100 else rng.randbytes(150) + passage + rng.randbytes(150))
data = int(next(l for l in open('/proc/self/status') if l.startswith('VmData')).split()[1]) * 1024
resource.setrlimit(resource.RLIMIT_DATA, (data + (40 << 20),) * 2)
found = {{}}
for owner, at in shard.repeated(400):
    for o, a in zip(owner.tolist(), at.tolist()):
        found.setdefault(o, []).append(a)
assert sorted(found) == list(range(0, 4000, 100)), len(found)
assert all(set(range(150, 451)) <= set(f) <= set(range(148, 453)) for f in found.values())  # a neighbouring byte may agree by chance
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300)


def test_queues_spill_to_disk_in_order(tmp_path):
    rng = random.Random(4)
    queue, expected, at = induced.TupleQueue(str(tmp_path), "q", held=10), [], 0
    for _ in range(40):
        keys = sorted(rng.randint(0, 9) for _ in range(rng.randint(1, 6)))
        expected += [(k, at + i) for i, k in enumerate(keys)]
        queue.push((np.array(keys, np.uint32), np.arange(at, at + len(keys)), np.zeros(len(keys), np.uint16)))
        at += len(keys)
    found = []
    assert queue.on_disk
    while (low := queue.least()) >= 0:
        high = queue.bound(7)
        block = queue.peek(high) if high > low else queue.take(low, 3)
        if high > low:
            queue.drop(high)
        found += zip(block[0].tolist(), block[1].tolist())
    assert found == sorted(expected)


def brute(rows, length):
    repeated = starts([t for _, t in rows], length)
    out = Counter()
    for (doc_id, t), at in zip(rows, repeated):
        gone = bytearray(len(t))
        for i in at:
            gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out[(doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())] += 1
    return out


def check(docs, length, **options):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    found = suffix_dedup.digest(docs, length, shard_bytes=2_000, **options).collect()
    assert all(r.repeats == (r.n_removed > 0) for r in found)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute(rows, length)


def test_removal_matches_brute_force(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = [(i if i % 7 else None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(100)]
    rows += [(5, None), (6, ""), (7, "a" * 3000), (7, "a" * 3000), (8, "a line that repeats itself\n" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, 20)
    check(docs, 20, together=1)


def test_a_common_passage_is_parted_by_offset(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(110))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) + passage + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, 90, together=2)
    check(docs, 90, together=1)  # one offset, parted by the strings' hashes


def test_of_a_common_passage_only_different_pieces_are_sorted(spark, monkeypatch):
    """A passage in 60 different surroundings and two that differ only at its ends: what stands alone or is equal is not moved."""
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = letters(200)
    rows = [(i, letters(rng.randint(40, 90)) + passage + letters(rng.randint(40, 90))) for i in range(60)]
    rows += [(60, rows[0][1][:-20] + letters(20)), (61, letters(20) + rows[0][1][20:]), (62, passage * 2)]
    moved = []

    def noted(segments, *rest, sort=suffix_dedup._sorted):
        moved.append(segments.selectExpr("sum(length(bytes))").first()[0] or 0)
        return sort(segments, *rest)

    monkeypatch.setattr(suffix_dedup, "_sorted", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for together in (1, 2, 20):
        check(docs, 90, together=together)
    assert max(moved) < sum(len(t) for _, t in rows)


def test_removal_of_odd_tables(spark, clashing, empty):
    check(clashing.where("length(text) < 20000 OR text IS NULL"), 30)
    assert suffix_dedup.digest(empty).count() == 0


def test_runs_are_cut_to_what_another_run_may_share(spark, monkeypatch):
    """A gram that two texts share, but no string: nothing is moved. Strings that end inside a run: less than the runs is moved."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    segments = []

    def noted(rows, *rest, sort=suffix_dedup._sorted):
        segments.append([len(r.bytes) for r in rows.select("bytes").collect()])
        return sort(rows, *rest)

    monkeypatch.setattr(suffix_dedup, "_sorted", noted)
    gram, passage = letters(90), letters(150)
    for rows in ([(i, letters(100) + gram + letters(100)) for i in range(4)], [(i, letters(100) + passage + letters(100)) for i in range(2)]):
        check(spark.createDataFrame(rows, "doc_id long, text string"), 120)
    assert segments[0] == []
    # a run has at most 57 strings; of the two at each end of the passage only the ranges that reach into it stay
    assert segments[1] and sum(segments[1]) < 2 * 350


def test_runs_of_one_symbol_take_few_steps(tmp_path, monkeypatch):
    pushed = []
    monkeypatch.setattr(induced.TupleQueue, "push", lambda self, block, push=induced.TupleQueue.push: (pushed.append(len(block[0])), push(self, block)))
    segments = [b"x" + b"a" * 900 + b"y", b"b" + b"a" * 700 + b"0"]
    assert [r.tolist() for r in induced.repeated_starts(segments, 400)] == starts(segments, 400)
    assert len(pushed) < 200
