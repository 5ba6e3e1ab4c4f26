import hashlib
import re
import zlib
from collections import Counter, defaultdict

from strataweave.llm import exact_dedup, sharding


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop(spark):
    keys = [*range(300), -1, -5, 2**62, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(k, str(k)) for k in keys], "doc_id long, text string")
    rows = sharding.assign_shards(docs, 16, rows_per_cell=4).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {k: (jump(k, 16), jump(k, 17)) for k in keys}
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    for shard in range(16):
        by_key = sorted(((r.doc_id, r.slot) for r in rows if r.shard == shard))
        assert [slot for _, slot in by_key] == list(range(len(by_key)))  # many cells, one order


def test_sharding_of_odd_rows(spark, messy, clashing, empty):
    rows = sharding.assign_shards(clashing, 16).collect()
    texts = [r.text for r in messy.collect()]
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sharding.assign_shards(empty, 16).count() == 0


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = Counter()
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out[(rows[m[3]][0], rows[best[3]][0], len(members), m[3] == best[3], hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_exact_duplicates_match_brute_force(spark, clashing, empty):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    found = exact_dedup.exact_duplicates(clashing)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()) == brute(rows)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_a_joined_filter_changes_nothing(spark):
    rows = [(i, f"text {i % 70}" + " " * (i % 3)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_duplicates(docs, most_words=1).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == brute(rows)


def test_filters_grow_with_what_they_hold(spark):
    keys = spark.range(40_000).selectExpr("id % 30000 AS key")
    known = exact_dedup.repeated_filter(keys)
    assert known.words == 1 << (10_000 * exact_dedup.BITS // 64).bit_length()
    alarms = exact_dedup.with_alarm(keys.distinct(), keys["key"], known).selectExpr("sum(int(alarm AND key < 10000))", "sum(int(alarm AND key >= 10000))").head()
    assert alarms[0] == 10_000 and alarms[1] < 1_000


def test_large_groups_join_without_loss(spark):
    rows = [(i, "same" if i < 1500 else f"t{i}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == brute(rows)


def test_keep_one_keeps_whole_rows(spark, messy, clashing):
    kept = exact_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = Counter(k[0] for k in brute([(r.doc_id, r.text) for r in messy.collect()]).elements() if k[3])
    assert Counter(r.doc_id for r in kept.collect()) == ids
