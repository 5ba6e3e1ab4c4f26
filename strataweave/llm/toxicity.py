"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic text and one on
windows of ordinary text. A window is a word with a space on either side. Windows
that both classes have are left out before training, and so are those seen in few
different surroundings, which teach the words of one text and its copies. Every
window of a text is compressed with either dictionary; the gap is how many bytes
shorter it is with the toxic one. A document's score is a logistic function of
its windows' gaps, fitted on labelled documents that the dictionaries have not
seen, so that the threshold is a calibrated probability. The same documents
decide in how many surroundings a window has to be seen.

Windows are counted and texts are scored on the executors. The driver gets a
bounded sample of windows and a few numbers of each calibration document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, text_or_empty, written

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[\W_]")
#: Characters of a text worked on at a time.
_PIECE = 250_000
#: A match is only looked for where eight bytes follow.
_PAD = b"\n" * 8
#: Windows whose gaps are remembered.
_REMEMBERED = 400_000
#: At most so many labelled documents are used to train; a documented bound.
SAMPLE = 10_000
#: At most so many different windows of a class go into its dictionary; a documented bound.
WINDOWS = 40_000
#: In how many surroundings a window has to be seen; calibration chooses one.
SURROUNDINGS = (2, 3, 4, 6, 9)
N_FEATURES = 10


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing only."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, a piece of it at a time."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = cut.start() if cut else len(text)
        yield _WORD.findall(text[at:end].lower())
        at = end


@dataclass
class Dictionaries:
    """The two dictionaries; trained ones, or plain text where there was too little to train on."""

    ordinary: bytes
    toxic: bytes
    trained: bool = False
    level: int = 6

    def __post_init__(self) -> None:
        self._compressors = None
        self._known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_compressors": None, "_known": {}}

    def _lengths(self, windows: list[str]) -> Iterator[np.ndarray]:
        if self._compressors is None:
            kind = zstandard.DICT_TYPE_FULLDICT if self.trained else zstandard.DICT_TYPE_RAWCONTENT
            settings = zstandard.ZstdCompressionParameters.from_level(self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._compressors = []
            for content in (self.ordinary, self.toxic):
                dictionary = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=kind)
                dictionary.precompute_compress(compression_params=settings)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))
        parts = [b" " + w.encode() + b" " + _PAD for w in windows]
        for compressor in self._compressors:
            out = compressor.multi_compress_to_buffer(parts, threads=1)
            yield np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))

    def gaps(self, windows: list[str]) -> np.ndarray:
        """Compressed length with the ordinary less that with the toxic dictionary, for each window."""
        known = self._known
        new = [w for w in set(windows) if w not in known]
        if new:
            a, b = self._lengths(new)
            known.update(zip(new, (a - b).tolist()))
        found = np.fromiter(map(known.__getitem__, windows), np.int64, len(windows))
        if len(known) > _REMEMBERED:
            known.clear()
        return found

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: the largest gap, windows with a clear gap, what they have above it, both by size, the same the other way, its size."""
        rows = np.zeros((len(texts), N_FEATURES))
        for row, text in zip(rows, texts):
            most = clear = above = against = n = 0
            for piece in words(text):
                if piece:
                    gaps = self.gaps(piece)
                    most = max(most, int(gaps.max()))
                    clear += int(np.count_nonzero(gaps >= 3))
                    above += int(np.maximum(gaps - 2, 0).sum())
                    against += int(np.count_nonzero(gaps <= -3))
                    n += len(piece)
            size = max(n, 1)
            row[:] = most, min(most, 6), math.log1p(clear), math.log1p(above), clear / math.sqrt(size), above / math.sqrt(size), clear / size, math.log1p(against), against / size, math.log1p(n)
        return rows


def train_dictionaries(ordinary: list[tuple[str, int]], toxic: list[tuple[str, int]], size: int = 8_192, segment: int = 64, grams: int = 6) -> Dictionaries:
    """A dictionary of each class from its windows and how often each counts."""
    samples = []
    for rows in (ordinary, toxic):
        found = [b" " + w.encode() + b" " for w, n in sorted(rows) for _ in range(min(n, 64))]
        np.random.default_rng(0).shuffle(found)
        samples.append(found)
    try:
        content = [zstandard.train_dictionary(size, s, k=segment, d=grams).as_bytes() for s in samples]
        return Dictionaries(*content, trained=True)
    except zstandard.ZstdError:  # too little text of a class
        return Dictionaries(*(b"".join(dict.fromkeys(s))[-size:] for s in samples))


@dataclass
class Model:
    dictionaries: Dictionaries
    weights: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        x = (self.dictionaries.features(texts) - self.means) / self.scales
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 100) -> np.ndarray:
    """Weights (first: constant) by Newton's method with a ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(model: Model, x: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(model.weights[0] + (x - model.means) / model.scales @ model.weights[1:], -30, 30)
    return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))) if len(y) else 0.0


def calibrate(dictionaries: Dictionaries, x: np.ndarray, y: np.ndarray) -> Model:
    """The logistic function; with labels of one kind only, the share of that kind."""
    means, scales = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    if 0 < y.sum() < len(y):
        return Model(dictionaries, _logistic((x - means) / scales, y), means, scales)
    weights = np.zeros(N_FEATURES + 1)
    weights[0] = math.log((y.sum() + 1e-9) / (len(y) - y.sum() + 1e-9)) if len(y) else -20.0
    return Model(dictionaries, np.clip(weights, -20, 20), means, scales)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic, calibrates``: one row for each of at most ``sample`` labelled documents, equal texts once."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", text_or_empty().alias("text"))
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    once = once.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return once.select("text", "toxic", (F.pmod(F.xxhash64("text"), F.lit(5)) >= 3).alias("calibrates"))


def _surroundings(rows: DataFrame) -> DataFrame:
    """``window, toxic, around``: each window with a hash of the windows beside it."""
    schema = pa.schema([("window", pa.string()), ("toxic", pa.int32()), ("around", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                for piece in words(text.as_py()):
                    seen = sorted({(b, xxh3_64_intdigest(f"{a} {c}") >> 1) for a, b, c in zip(["", *piece], piece, [*piece[1:], ""])})
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([toxic] * len(seen), pa.int32()), pa.array([h for _, h in seen], pa.int64())], schema=schema)

    return rows.select("text", "toxic").transform(bounded).mapInArrow(work, "window string, toxic int, around long")


def _windows(rows: DataFrame, most: int) -> list[tuple[str, int, int]]:
    """``window, toxic, surroundings`` of the windows of one class alone, at most ``most`` of each class: those seen most widely."""
    counted = _surroundings(rows).distinct().groupBy("window").agg(*(F.count(F.when(F.col("toxic") == y, 1)).alias(f"n{y}") for y in (0, 1)))
    alone = counted.where(f"(n0 = 0 AND n1 >= {min(SURROUNDINGS)}) OR (n1 = 0 AND n0 >= {min(SURROUNDINGS)})")
    alone = alone.select("window", (F.col("n1") > 0).cast("int").alias("toxic"), (F.col("n0") + F.col("n1")).cast("int").alias("n"))
    tops = [alone.where(f"toxic = {y}").orderBy(F.desc("n"), "window").limit(most).collect() for y in (0, 1)]
    return [(r.window, r.toxic, r.n) for top in tops for r in top]


def _measured(rows: DataFrame, candidates: list[Dictionaries]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the calibration documents with each of the candidates, and their labels."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = np.concatenate([d.features(texts) for d in shared.value], axis=1) if texts else np.zeros((0, N_FEATURES * len(shared.value)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    found = rows.where("calibrates").select("text", "toxic").transform(bounded).mapInArrow(work, "toxic int, x array<double>").collect()
    found.sort()
    x = np.array([r.x for r in found], float).reshape(len(found), len(candidates), N_FEATURES)
    return x, np.array([r.toxic for r in found], float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Model:
    """Fits on at most ``sample`` labelled documents, chosen by a hash of doc_id, that are not held out.

    Three of five, by a hash of the text, make the dictionaries, the others
    calibrate. Of a doc_id with several rows or labels one text and the highest
    label are used; rows without label or doc_id are not; null texts are empty,
    long ones are read whole, piece by piece. With labels of one kind only, every
    score is nearly the share of that kind.
    """
    rows = written(_sampled(docs, labels, sample), "toxic-sample")
    found = _windows(rows.where("NOT calibrates"), windows)
    candidates = []
    for least in SURROUNDINGS:
        kept = {y: [(w, n) for w, t, n in found if t == y and n >= least] for y in (0, 1)}
        if kept[1] or not candidates:
            candidates.append(train_dictionaries(kept[0], kept[1]))
    x, y = _measured(rows, candidates)
    # half of the documents weigh the candidates that the other half has calibrated, and the other way round
    halves = [np.arange(len(y)) % 2 == h for h in (0, 1)]
    losses = [sum(_loss(calibrate(d, x[a, k], y[a]), x[~a, k], y[~a]) for a in halves) for k, d in enumerate(candidates)]
    best = int(np.argmin(losses))
    return calibrate(candidates[best], x[:, best], y)


def with_scores(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with one more column, the score of its whole text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != name]
    result = docs.select(*others, F.lit(0.0).alias(name)).schema
    column = others.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([t.as_py() or "" for t in batch.column(column)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*others, name])

    return docs.select(*others).transform(bounded).mapInArrow(work, result)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score. Null and empty texts have the score
    of a text without windows; very long ones are read whole, piece by piece.
    Equal texts have equal scores, so repeated rows do too. Other columns are not
    read. An empty table gives no rows. A missing doc_id is not held out.
    """
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score less than the threshold, with the same columns (see :func:`classify`)."""
    name = free_name(docs, "score")
    return with_scores(docs, model, name).where(F.col(name) < threshold).select(*docs.columns)
