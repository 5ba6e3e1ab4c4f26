"""Removal of long repeated byte strings, wherever they repeat.

A string of ``length`` bytes has a *minimizer*, the least hash of its 64-byte
substrings. Equal strings have equal minimizers, so each text is cut into runs
of strings that share one, and the runs are dealt into shards by it: what can be
equal meets in one shard. Runs whose minimizer occurs once in the corpus (in other
runs and in themselves) cannot repeat and are dropped before they move (a Bloom
filter, then exact counts). Runs of equal bytes are counted, not moved: all their strings repeat. Of
different runs of one minimizer those strings are left out that no other run can have: the strings of a
range of offsets before the minimizer all cover the same bytes there, which have a small hash for each of
:data:`_RANGES` ranges, and a run is cut to the ranges whose hash it shares. What is left is sorted by external induced sorting
(:mod:`.induced`), shard by shard, with queues on the task's disk: a shard may be
far larger than a task's memory. A minimizer with very many runs is parted by how
far a string starts before it, which is the same for equal strings. The bytes that
all strings of a part's piece have in common are equal, too, if any two are, so
their hash parts it further. Pieces that stand alone there are not moved, nor are
equal pieces: all their strings repeat, so one of them is sorted with the others.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, partitions, text_or_empty, written
from .exact_dedup import join_groups, member_filter, repeated_filter, with_alarm
from .induced import Shard

_BASE = 0x9E3779B97F4A7C15
_GRAM = 64
_RUN = 4096  # strings in a run at most
_SLICE = 1 << 20
_RANGES = 8  # of offsets, with a byte for each in ``near``
#: Bytes of segments that a task sorts at a time; more, if one part of a minimizer has more.
SHARD_BYTES = 1 << 20
#: Different runs of one minimizer that stay together; more are parted by offset.
TOGETHER = 500


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
    return up, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _sums(raw: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[0][: len(raw)], dtype=np.uint64)])


def _gram_hashes(raw: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on."""
    sums, n = _sums(raw, powers), len(raw) - gram + 1
    return _mixed((sums[gram:] - sums[:n]) * powers[1][:n])


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def offset_parts(data: bytes, minimizer: int, length: int, width: int, powers: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """A run cut by how far its strings start before their first minimizer: ``part, from, to`` (strings) and its place.

    Equal strings start equally far before it, so they fall into equal parts.
    """
    gram = min(_GRAM, length)
    strings = np.arange(len(data) - length + 1)
    at = np.flatnonzero(_gram_hashes(np.frombuffer(data, np.uint8), gram, powers).view(np.int64) == minimizer)
    place = np.searchsorted(at, strings)
    part = (at[place] - strings) // width
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])))
    return list(zip(part[first].tolist(), first.tolist(), np.append(first[1:], len(strings)).tolist(), at[place[first]].tolist()))


def _range_width(length: int) -> int:
    """Offsets in each of the ranges."""
    return -(-(length - min(_GRAM, length) + 1) // _RANGES)


def _near(sums: np.ndarray, at: np.ndarray, reach: np.ndarray, strings: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A byte for each range of offsets before the minimizer at ``at``: of the bytes that its strings have in common, 0 where a run has none.

    A run's first string starts ``reach`` before the minimizer. Equal strings
    start equally far before it, so they have equal bytes here.
    """
    width = _range_width(length)
    near = np.zeros(len(at), np.uint64)
    for k in range(_RANGES):
        has = (reach >= k * width) & (reach - strings + 1 < (k + 1) * width)
        begin = at[has] - k * width
        hashes = _mixed((sums[begin + (length - width + 1)] - sums[begin]) * powers[1][begin])
        near[has] |= (hashes >> np.uint64(56) | np.uint64(128)) << np.uint64(8 * k)
    return near.view(np.int64)


def minimizer_runs(data: bytes, ends: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs of strings of ``length`` bytes with one minimizer: ``minimizer, start, strings, inner, near, reach``.

    ``ends`` has where the texts in ``data`` end; no string runs across an end.
    ``inner`` tells whether the minimizer occurs in the run more than once; if
    not, the first string starts ``reach`` before it (``near``: :func:`_near`).
    """
    raw = np.frombuffer(data, np.uint8)
    gram = min(_GRAM, length)
    if len(raw) < length:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = _sums(raw, powers)
    hashes = _mixed((sums[gram:] - sums[: len(raw) - gram + 1]) * powers[1][: len(raw) - gram + 1])
    least = _least(hashes, length - gram + 1)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    valid = owner[: len(least)] == owner[length - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), len(least))
    stop = stop[np.searchsorted(stop, start, side="right")]
    pieces = -(-(stop - start) // _RUN)
    first = np.repeat(start, pieces) + _RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    minimizer, strings = np.repeat(least[start], pieces), np.minimum(_RUN, np.repeat(stop, pieces) - first)
    last = first + strings + length - gram
    places = [np.flatnonzero(hashes[a:b] == m) for a, b, m in zip(first.tolist(), last.tolist(), minimizer)]
    inner = np.fromiter((len(p) > 1 for p in places), bool, len(first))
    reach = np.fromiter((p[0] for p in places), np.int64, len(first))
    near, once = np.zeros(len(first), np.int64), ~inner
    near[once] = _near(sums, first[once] + reach[once], reach[once], strings[once], length, powers)
    return minimizer.view(np.int64), first, strings, inner, near, reach


def _text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """``key, minimizer, content, start, strings, inner, near, reach`` for all texts (columns ``key, text``)."""
    schema = pa.schema([("key", pa.binary()), ("minimizer", pa.int64()), ("content", pa.binary()), ("start", pa.int64()), ("strings", pa.int64()), ("inner", pa.bool_()), ("near", pa.int64()), ("reach", pa.int32())])

    def runs_of(keys: list[bytes], texts: list[bytes], powers: tuple) -> pa.RecordBatch:
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        minimizer, start, strings, inner, near, reach = minimizer_runs(data, ends, length, powers)
        owner = np.searchsorted(ends, start, side="right")
        view = memoryview(data)
        content = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), (start + strings + length - 1).tolist())]
        begins = ends - [len(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in owner.tolist()], pa.binary()), pa.array(minimizer), pa.array(content, pa.binary()), pa.array(start - begins[owner] if len(start) else start, pa.int64()), pa.array(strings, pa.int64()), pa.array(inner, pa.bool_()), pa.array(near), pa.array(reach.astype(np.int32))], schema=schema
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(_SLICE + 4096)
        for batch in batches:
            keys, texts, size = [], [], 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py().encode()
                if len(text) < length:
                    continue
                if texts and size + len(text) > _SLICE:
                    yield runs_of(keys, texts, powers)
                    keys, texts, size = [], [], 0
                if len(text) > len(powers[0]):
                    powers = _powers(len(text))
                keys.append(batch.column(0)[k].as_py())
                texts.append(text)
                size += len(text)
            if texts:
                yield runs_of(keys, texts, powers)

    return docs.transform(bounded).mapInArrow(work, "key binary, minimizer long, content binary, start long, strings long, inner boolean, near long, reach int")


def _listed(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Each text with a list of its runs."""
    listed = runs.groupBy("key").agg(F.collect_list(F.struct(*(c for c in runs.columns if c != "key"))).alias("runs"))
    return texts.join(listed, "key").select("key", "text", "runs").transform(bounded)


def _pieces(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``key, minimizer, part, piece, content, skip, start, strings``: runs cut by offset, without their bytes.

    ``piece`` is a digest of a piece's bytes, ``skip`` its first string in the
    run. Where two pieces of a range of ``width`` offsets have an equal string,
    the bytes that strings of all these offsets cover are equal; their hash is in
    ``part``. Strings of one piece start differently far before the minimizer, so
    none of them are equal.
    """
    schema = pa.schema([("key", pa.binary()), ("minimizer", pa.int64()), ("part", pa.int64()), ("piece", pa.binary()), ("content", pa.binary()), ("skip", pa.int64()), ("start", pa.int64()), ("strings", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(2 * _RUN)
        for batch in batches:
            for k in range(batch.num_rows):
                key, data, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py().encode(), []
                for r in batch.column(2)[k].as_py():
                    run, width = data[r["start"] : r["start"] + r["strings"] + length - 1], r["width"]
                    for p, a, b, at in offset_parts(run, r["minimizer"], length, width, powers):
                        first = at - p * width
                        common = xxhash.xxh3_64_intdigest(run[first : first + length - width + 1])
                        piece = xxhash.xxh3_128_digest(run[a : b + length - 1])
                        rows.append((key, r["minimizer"], p << 48 | common >> 16, piece, r["content"], a, r["start"] + a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _listed(texts, runs).mapInArrow(work, "key binary, minimizer long, part long, piece binary, content binary, skip long, start long, strings long")


def _segments(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``minimizer, part, content, bytes, skip`` of the wanted runs and pieces, cut from their texts."""
    schema = pa.schema([("minimizer", pa.int64()), ("part", pa.int64()), ("content", pa.binary()), ("bytes", pa.binary()), ("skip", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py().encode()
                rows = [(r["minimizer"], r["part"], r["content"], data[r["start"] : r["start"] + r["strings"] + length - 1], r["skip"]) for r in batch.column(2)[k].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _listed(texts, wanted).mapInArrow(work, "minimizer long, part long, content binary, bytes binary, skip long")


def _sorted(segments: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``content, from, to``: ranges of strings of a run or piece that repeat in its shard, counted with the ``skip`` before a segment."""
    schema = pa.schema([("content", pa.binary()), ("from", pa.int64()), ("to", pa.int64())])

    def ranges(shard: Shard, labels: list[bytes], skips: list[int]) -> Iterator[pa.RecordBatch]:
        skipped = np.array(skips, np.int64)
        for owner, at in shard.repeated(length):
            at = at + skipped[owner]
            new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
            last = np.append(new[1:], len(at)) - 1
            yield pa.RecordBatch.from_arrays([pa.array([labels[k] for k in owner[new].tolist()], pa.binary()), pa.array(at[new], pa.int64()), pa.array(at[last] + 1, pa.int64())], schema=schema)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
        """Rows, sorted by minimizer and part, in shards that end where a part ends."""
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)))
        waiting = next(rows, None)

        def shard() -> Iterator[tuple]:
            nonlocal waiting
            size = 0
            while waiting:
                now, waiting = waiting, next(rows, None)
                size += len(now[3])
                yield now
                if waiting and size >= shard_bytes and waiting[:2] != now[:2]:
                    return

        while waiting:
            yield shard()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shards(batches):
            with tempfile.TemporaryDirectory(prefix="induced-") as folder:
                shard, labels, skips = Shard(folder), [], []
                for _, _, name, piece, skip in rows:
                    shard.add(piece)
                    labels.append(name)
                    skips.append(skip)
                yield from ranges(shard, labels, skips)

    return segments.repartition(partitions(segments.sparkSession), "minimizer", "part").sortWithinPartitions("minimizer", "part").transform(bounded).mapInArrow(work, "content binary, from long, to long")


def _without(texts: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """``key, n_removed, n_spans, kept, removed`` (spans ``start, end`` in bytes) of the texts with repeats."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data, merged = batch.column(1)[k].as_py().encode(), []
                for r in sorted((r["start"], r["end"]) for r in batch.column(2)[k].as_py()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((batch.column(0)[k].as_py(), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    listed = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(listed, "key").select("key", "text", "spans").transform(bounded).mapInArrow(work, "key binary, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")


def _of_common(texts: DataFrame, common: DataFrame, others: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``content, from, to`` of the runs of common minimizers, which are cut into pieces, and of other runs."""
    pieces = written(_pieces(texts, common, length), "repeat-pieces")
    # equal pieces have equal minimizers and parts
    same = pieces.groupBy("minimizer", "part", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "strings", "content", "skip")).alias("place"))
    same = written(same, "repeat-same")
    shared = same.groupBy("minimizer", "part").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("minimizer", "part")
    name = F.concat(F.lit("piece").cast("binary"), F.col("piece"))
    moved = same.join(shared, ["minimizer", "part"]).select("place.key", "minimizer", "part", name.alias("content"), "place.start", "place.strings", F.lit(0).cast("long").alias("skip"))
    found = written(_sorted(_segments(texts, others.unionByName(moved), length), length, shard_bytes), "repeat-ranges")
    single = same.where("n = 1").select(name.alias("name"), "place.content", "place.skip")
    of_single = found.withColumnRenamed("content", "name").join(single, "name").select("content", (F.col("from") + F.col("skip")).alias("from"), (F.col("to") + F.col("skip")).alias("to"))
    equal = join_groups(pieces.select("piece", "content", "skip", "strings"), same.where("n > 1").select("piece", "n"), "piece", "n", pieces.count())
    of_equal = equal.select("content", F.col("skip").alias("from"), (F.col("skip") + F.col("strings")).alias("to"))
    return found.where(F.length("content") == 16).unionByName(of_single).unionByName(of_equal)


def _cut_to_shared(runs: DataFrame, length: int) -> DataFrame:
    """Runs (``key, minimizer, content, start, strings, near, reach, several``) cut to the ranges of offsets that another run of their minimizer may share.

    Runs that share none go; those of a minimizer that occurs in some run more than
    once (``several``) stay whole. ``skip`` is how many strings were cut off in front.
    """
    width = _range_width(length)
    byte = lambda k: F.shiftrightunsigned("near", 8 * k).bitwiseAND(255)
    cells = runs.where("NOT several").select("minimizer", "content", F.posexplode(F.array(*(byte(k) for k in range(_RANGES)))).alias("range", "byte")).where("byte > 0")
    shared = cells.groupBy("minimizer", "range", "byte").agg(F.collect_list("content").alias("contents")).where("size(contents) > 1")
    kept = shared.select("range", F.explode("contents").alias("content")).groupBy("content").agg(F.min("range").alias("low"), F.max("range").alias("high"))
    first = F.greatest(F.lit(0), F.col("reach") - (F.col("high") + 1) * width + 1).cast("long")
    last = F.least(F.col("strings"), F.col("reach") - F.col("low") * width + 1).cast("long")
    cut = runs.where("NOT several").join(kept, "content").select("key", "minimizer", "content", "start", first.alias("skip"), last.alias("last"))
    cut = cut.select("key", "minimizer", "content", (F.col("start") + F.col("skip")).alias("start"), (F.col("last") - F.col("skip")).alias("strings"), "skip")
    return cut.unionByName(runs.where("several").select("key", "minimizer", "content", "start", "strings", F.lit(0).cast("long").alias("skip")))


def repeated_bytes(docs: DataFrame, length: int = 400, text: str = "text", shard_bytes: int = SHARD_BYTES, together: int = TOGETHER) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats, removed``.

    Removed are the bytes covered by a string of ``length`` bytes that also
    starts anywhere else in the table, overlaps and the same text included, as
    the texts are, not as they are after other removals. ``removed`` lists the
    maximal runs by byte, the end exclusive (null: none), and ``repeats`` tells
    whether there are any. Null texts are empty; texts shorter than ``length``
    lose nothing, long ones are cut into runs and compared whole. Repeated rows count as different
    documents, so they lose everything that is long enough. Other columns are
    not read; an empty table gives no rows.
    """
    texts = docs.select(text_or_empty(text).alias("text")).select(_text_key(F.col("text")).alias("key"), "text")
    slim = written(
        docs.select("doc_id", text_or_empty(text).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _text_key(F.col("text")).alias("key"), F.sha2("text", 256).alias("sha")),
        "repeat-digests",
    )
    runs = written(_runs(texts, length), "repeat-runs")
    filters = repeated_filter(runs.select(F.col("minimizer").alias("key")))
    runs = written(with_alarm(runs, F.col("minimizer"), filters).where("alarm OR inner").drop("alarm"), "repeat-candidates")
    # a minimizer's runs by content, with one place of each
    kinds = runs.groupBy("minimizer", "content").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), F.min(F.struct("key", "start", "strings", "near", "reach")).alias("place"))
    kinds = written(kinds, "repeat-kinds")
    alone = F.col("n") == 1
    varied = kinds.groupBy("minimizer").agg(F.count(F.lit(1)).alias("kinds"), F.max("inner").alias("several"), F.max(F.col("inner") & alone).alias("inner"), F.max(alone).alias("open"))
    # where all runs are equal to others, all strings are known to repeat
    varied = varied.where("open AND (kinds > 1 OR inner)").select("minimizer", "kinds", "several")
    offsets = length - min(_GRAM, length) + 1
    width = F.least(F.lit(offsets), F.ceil(F.lit(offsets * together) / F.col("kinds"))).cast("int")
    wanted = written(kinds.join(varied, "minimizer").select("minimizer", "content", "place.*", "several", width.alias("width")), "repeat-wanted")
    runs_of = written(_cut_to_shared(wanted.where(F.col("width") == offsets), length), "repeat-cut").withColumn("part", F.lit(0).cast("long"))
    common = wanted.where(F.col("width") < offsets).select("key", "minimizer", "content", "start", "strings", "width")
    keys = runs_of.select("key").unionByName(common.select("key"))
    once = texts.transform(lambda t: with_alarm(t, F.col("key"), member_filter(keys)).where("alarm")).groupBy("key").agg(F.first("text").alias("text"))
    if common.isEmpty():
        found = written(_sorted(_segments(once, runs_of, length), length, shard_bytes), "repeat-ranges")
    else:
        found = _of_common(once, common, runs_of, length, shard_bytes)
    whole = kinds.where("n > 1").select("content", F.lit(0).cast("long").alias("from"), F.col("place.strings").alias("to"), "n")
    ranges = whole.unionByName(found.join(kinds.where("n = 1").select("content", "n"), "content").select("content", "from", "to", "n"))
    table = written(ranges.groupBy("content", "n").agg(F.collect_list(F.struct("from", "to")).alias("ranges")), "repeat-table")
    places = runs.select("key", "content", "start").distinct()
    spans = join_groups(places, table, "content", "n", runs.count()).select("key", "start", F.explode("ranges").alias("r"))
    spans = written(spans.select("key", (F.col("start") + F.col("r.from")).alias("start"), (F.col("start") + F.col("r.to") + (length - 1)).alias("end")), "repeat-spans")
    again = with_alarm(texts, F.col("key"), member_filter(spans.select("key"))).where("alarm").groupBy("key").agg(F.first("text").alias("text"))
    changed = written(_without(again, spans, length), "repeat-changed")
    asked = with_alarm(slim, F.col("key"), member_filter(changed.select("key")))
    none = F.lit(0).cast("long")
    kind = "array<struct<start:long,end:long>>"
    clean = asked.where("NOT alarm").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(False).alias("repeats"), F.lit(None).cast(kind).alias("removed"))
    rows = asked.where("alarm").drop("alarm")
    groups = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).join(changed, "key", "left"), "repeat-groups")
    rest = join_groups(rows, groups, "key", "copies", slim.count())
    rest = rest.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), (F.coalesce("n_removed", none) > 0).alias("repeats"), "removed")
    return clean.unionByName(rest)


def digest(docs: DataFrame, length: int = 400, **options) -> DataFrame:
    """The columns of :func:`repeated_bytes` without the spans."""
    return repeated_bytes(docs, length, **options).drop("removed")
