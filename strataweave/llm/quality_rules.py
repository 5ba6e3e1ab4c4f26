"""Quality rules: fixed counts of a text, and the share of its words that lie in content lines.

Whether a line is content or boilerplate is decided by Viterbi decoding of the
chain of a text's lines (:mod:`line_labels`). The field is trained on labelled
documents. A good document's lines are all content. Of a poor document only some
lines are boilerplate, and which is not told: training begins with all of them,
each line by itself, and then takes, a few times over, those that the field
itself marks, and of a document where it marks none the line that it doubts most.
From the second time on the lines are chains. The least share of
content with which a document is kept is the one that parts the labelled
documents best.

Lines are measured with numpy over all texts of a slice at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, slices, text_or_empty, written
from .line_labels import BOILERPLATE, Chains, Field, fit
from .toxicity import held_out

_SLICE = 3_000_000
#: At most so many labelled documents train the field, of at most so many lines each; documented bounds.
SAMPLE, SAMPLE_LINES = 4_000, 2_000
#: How often the lines of poor documents are marked anew.
ROUNDS = 3
#: The fixed rules: fewest words, and the greatest percentage of words in repeated windows of five words.
MIN_WORDS, WINDOW, MAX_REPEATED = 10, 5, 20
SYMBOLS = "#*$%&|<>"
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
UPPER, LOWER, DIGIT, SYMBOL, STOP, COMMA, MARK, BLANK, UNKNOWN = range(9)
_KINDS = np.full(0x110000, UNKNOWN, np.uint8)


def _kinds(points: np.ndarray) -> np.ndarray:
    found = _KINDS[points]
    if (new := found == UNKNOWN).any():
        for p in np.unique(points[new]).tolist():
            _KINDS[p] = _kind(chr(p))
        found = _KINDS[points]
    return found


def _kind(c: str) -> int:
    if c in SYMBOLS:
        return SYMBOL
    if c in ".!?":
        return STOP
    if c in ",;:":
        return COMMA
    group = unicodedata.category(c)
    return UPPER if group in ("Lu", "Lt") else LOWER if group[0] in "LM" else DIGIT if group[0] == "N" else BLANK if c.isspace() else MARK


#: Bounds of the bins that a line's figures fall into.
BINS = {
    "words": (2, 5, 10, 20, 50, 100),
    "letters of a word": (2.5, 3.5, 4.5, 5.5, 7, 9),
    "symbols": (0.005, 0.02, 0.05, 0.1, 0.2),
    "upper case": (0.001, 0.05, 0.15, 0.4, 0.8),
    "digits": (0.001, 0.03, 0.1, 0.3),
    "stops": (0.005, 0.015, 0.03, 0.06, 0.12),
    "commas": (0.002, 0.01, 0.03, 0.08),
    "other marks": (0.005, 0.02, 0.06),
    "same word twice": (0.01, 0.1, 0.4),
    "repeated windows": (0.01, 0.2, 0.6),
}
FLAGS = ("constant", "equal to an earlier line", "ends as a sentence", "begins in upper case", "first", "last")
N_FEATURES = len(FLAGS) + sum(len(b) for b in BINS.values())


class Measured:
    """The figures of some texts and of their lines that have a word."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        joined = "\n".join([*texts, ""]) if n else ""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = _kinds(points)
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
        line_ends = np.flatnonzero(points == 10)
        line_begins = np.concatenate([[0], line_ends + 1])[:-1]
        doc_of_line = np.repeat(np.arange(n), [t.count("\n") + 1 for t in texts])
        line_of_word = np.searchsorted(line_ends, begins)
        doc_of_word = doc_of_line[line_of_word]
        words = np.empty(len(begins), object)
        words[:] = _WORD.findall(joined)
        code = pd.factorize(words)[0].astype(np.int64)
        repeated = self._repeated(code, doc_of_word)
        again = self._equal_lines(texts)
        per_line = np.bincount(line_of_word, minlength=len(line_ends))

        self.n_words = np.bincount(doc_of_word, minlength=n)
        self.word_chars = np.bincount(doc_of_word, weights=ends - begins, minlength=n).astype(np.int64)
        self.n_symbols = np.bincount(doc_of_line, weights=np.add.reduceat(kinds == SYMBOL, line_begins, dtype=np.int64), minlength=n).astype(np.int64) if n else self.n_words
        self.n_dup_lines = np.bincount(doc_of_line[again & (per_line > 0)], minlength=n)
        self.n_repeat_words = np.bincount(doc_of_word[repeated], minlength=n)

        lines = np.flatnonzero(per_line)
        #: Of each line with a word: its text, its words, its features.
        self.doc = doc_of_line[lines]
        self.words = per_line[lines]
        #: Of each text: how many such lines it has.
        self.lengths = np.bincount(self.doc, minlength=n)
        self.features = np.zeros((len(lines), N_FEATURES), np.float32)
        if not len(lines):
            return

        def total(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask, line_begins, dtype=np.int64)[lines]

        def of_words(mask: np.ndarray) -> np.ndarray:
            return np.bincount(line_of_word[mask], minlength=len(line_ends))[lines] / self.words

        signs = total(~blank)
        letters = total(kinds == UPPER) + total(kinds == LOWER)
        twice = np.concatenate([[False], (code[1:] == code[:-1]) & (line_of_word[1:] == line_of_word[:-1])])
        figures = {
            "words": self.words,
            "letters of a word": letters / self.words,
            "symbols": total(kinds == SYMBOL) / signs,
            "upper case": total(kinds == UPPER) / np.maximum(letters, 1),
            "digits": total(kinds == DIGIT) / signs,
            "stops": total(kinds == STOP) / signs,
            "commas": total(kinds == COMMA) / signs,
            "other marks": total(kinds == MARK) / signs,
            "same word twice": of_words(twice),
            "repeated windows": of_words(repeated),
        }
        first_word = np.searchsorted(line_of_word, lines)
        last_word = np.searchsorted(line_of_word, lines, "right") - 1
        same = np.concatenate([[False], self.doc[1:] == self.doc[:-1]])
        flags = [np.ones(len(lines)), again[lines], kinds[ends[last_word] - 1] == STOP, kinds[begins[first_word]] == UPPER, ~same, np.concatenate([~same[1:], [True]])]
        at = 0
        for column in flags:
            self.features[:, at] = column
            at += 1
        for name, bounds in BINS.items():
            for bound in bounds:
                self.features[:, at] = figures[name] >= bound
                at += 1

    @staticmethod
    def _repeated(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which words lie in a window of five that its text has twice or more."""
        covered = np.zeros(len(code) + 1, np.int64)
        at = np.arange(max(0, len(code) - WINDOW + 1))
        at = at[doc[at] == doc[at + WINDOW - 1]]
        if len(at):
            # number the windows exactly: pairs, pairs of pairs, and so on, each text by itself
            _, key = np.unique(doc[at] * (code.max() + 1) + code[at], return_inverse=True)
            for k in range(1, WINDOW):
                _, key = np.unique(key * (code.max() + 1) + code[at + k], return_inverse=True)
            often = at[np.bincount(key)[key] > 1]
            np.add.at(covered, often, 1)
            np.add.at(covered, often + WINDOW, -1)
        return np.cumsum(covered)[:-1] > 0

    @staticmethod
    def _equal_lines(texts: list[str]) -> np.ndarray:
        """Which lines are equal to an earlier one of their text."""
        out: list[bool] = []
        for text in texts:
            seen: set[str] = set()
            for line in text.split("\n"):
                out.append(line in seen)
                seen.add(line)
        return np.array(out, bool)


@dataclass
class Rules:
    """A trained field and the least share of words in content lines with which a text is kept."""

    field: Field
    least: float

    def shares(self, found: Measured) -> np.ndarray:
        """The share of each text's words that lie in content lines (without words: 0)."""
        content = self.field.decode(found.features, found.lengths) != BOILERPLATE
        kept = np.bincount(found.doc[content], weights=found.words[content], minlength=len(found.lengths))
        return kept / np.maximum(found.n_words, 1)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, quality``: one row for each of at most ``sample`` labelled documents that are not held out, equal texts once."""
    usable = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    return once.groupBy("text").agg(F.max("quality").alias("quality"))


def _sample_features(rows: DataFrame, most_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and words of the sample's lines, lines and label of each of its texts, measured on the executors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, 0, _SLICE):
                found = Measured(texts)
                ends = np.cumsum(found.lengths)
                for i, (end, n) in enumerate(zip(ends, found.lengths)):
                    if 0 < n <= most_lines:
                        part = slice(end - n, end)
                        bits = np.packbits(found.features[part].astype(bool), axis=1)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(1).slice(at + i, 1), pa.array([bits.tobytes()], pa.binary()), pa.array([found.words[part].astype("<i8").tobytes()], pa.binary())],
                            ["quality", "bits", "words"],
                        )

    found = sorted(rows.transform(bounded).mapInArrow(work, "quality int, bits binary, words binary").collect())
    width = -(-N_FEATURES // 8)
    bits = np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(-1, width)
    x = np.unpackbits(bits, axis=1)[:, :N_FEATURES].astype(np.float32)
    return x, np.frombuffer(b"".join(r.words for r in found), "<i8"), np.array([len(r.bits) // width for r in found], np.int64), np.array([r.quality for r in found], np.int64)


def _mark(field: Field, x: np.ndarray, parts: np.ndarray, lengths: np.ndarray, poor: np.ndarray) -> np.ndarray:
    """Labels of lines: boilerplate in poor documents where the field says so, or where it doubts most.

    ``parts`` are the lengths of the chains, ``lengths`` those of the documents.
    """
    chains = Chains(parts)
    _, p, _ = field.forward_backward(x, chains)
    doubt = np.zeros(len(x))
    doubt[chains.line] = p[:, BOILERPLATE]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    y = (field.decode(x, parts) == BOILERPLATE) & poor[doc]
    order = np.lexsort((doubt, doc))
    most = order[np.cumsum(lengths) - 1]
    none = np.bincount(doc[y], minlength=len(lengths)) == 0
    y[most[none & poor]] = True
    return y.astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = SAMPLE_LINES) -> Rules:
    """Fits the field and the least share on labelled documents (``doc_id, quality`` 0 or 1).

    At most ``sample`` documents, chosen by a hash of doc_id, none held out, none
    of over ``most_lines`` lines with words. Of a doc_id with several rows or
    labels one text and the higher label are used; rows without label or doc_id
    are not. With labels of one kind only, every line is content.
    """
    x, words, lengths, quality = _sample_features(written(_sampled(docs, labels, sample), "quality-sample"), most_lines)
    if len(set(quality.tolist())) < 2:
        return Rules(Field.unpack(np.zeros(N_FEATURES + 8)), 0.0)
    poor = quality == 0
    y = np.repeat(poor, lengths).astype(np.int64)
    parts = np.ones(len(x), np.int64)
    theta = fit(x, y, parts)
    for _ in range(ROUNDS):
        y, parts = _mark(Field.unpack(theta), x, parts, lengths, poor), lengths
        theta = fit(x, y, parts)
    field = Field.unpack(theta)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    content = field.decode(x, lengths) != BOILERPLATE
    shares = np.bincount(doc[content], weights=words[content], minlength=len(lengths)) / np.bincount(doc, weights=words)
    return Rules(field, _least_share(shares, poor))


def _least_share(shares: np.ndarray, poor: np.ndarray) -> float:
    """The share from which on documents are kept, where good ones kept and poor ones left out (each as a share of theirs) add up highest."""
    values = np.unique(shares)
    cuts = np.concatenate([[0.0], (values[1:] + values[:-1]) / 2])
    gains = [(shares[~poor] >= c).mean() + (shares[poor] < c).mean() for c in cuts]
    return float(cuts[int(np.argmax(gains))])


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double"


def with_measures(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``_RESULT`` behind its own, whose names give way to these."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    added = docs.sparkSession.createDataFrame([], _RESULT).schema
    others = [c for c in docs.columns if c not in added.names]
    column = others.index(text)
    schema = docs.select(*others).schema
    for f in added:
        schema = schema.add(f)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, column, _SLICE):
                m = Measured(texts)
                figures = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words]
                own = batch.slice(at, len(texts)).columns
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(f.astype(np.int64)) for f in figures), pa.array(shared.value.shares(m))], names=[*others, *added.names])

    return docs.select(*others).transform(bounded).mapInArrow(work, schema)


def _failed(df: DataFrame):
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, ``content_share``, ``base_failed`` and ``kept``.

    Words are what is between spaces and the signs 9 to 13, lines what is between
    line feeds. ``n_dup_lines`` counts lines with a word that equal an earlier
    line, ``n_repeat_words`` words that lie in a window of five words which the
    text has twice or more. ``kept`` is False if the fixed rules fail, else
    whether the share of words in content lines is large enough.

    Null and empty texts have no words and fail. Long texts are measured whole.
    Equal texts and repeated rows have equal results; doc_id may be missing or
    repeated. Other columns are not read; an empty table gives no rows.
    """
    found = with_measures(docs.select("doc_id", F.col(text).alias("text")), rules)
    failed = _failed(found)
    return found.drop("text").withColumns({"base_failed": failed, "kept": ~failed & (F.col("content_share") >= rules.least)})


def keep_good(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with the same columns."""
    name = free_name(docs, "_row")
    found = with_measures(docs.select(F.struct(*docs.columns).alias(name), F.col(text).alias("text")), rules)
    return found.where(~_failed(found) & (F.col("content_share") >= rules.least)).select(f"{name}.*")
