"""Words of a text without spaces: the cheapest way through a lattice of dictionary words.

Every word of a table that occurs at some place is an edge of the lattice; so is
a run of letters of one kind, and a single letter, at a higher price, where the
table may lack a word. A word has a cost, and two kinds of words beside each other
may have one too. The path of least cost gives the tokens, in normal form,
without stop words. A path of as little cost has fewer words, or else longer last
ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Particles, auxiliaries and words of mere form, as they stand and in normal form.
STOP_WORDS = "の は が を に で と も か な へ や て だ た れ ば ず ぬ ん する いる ある なる 為る 居る 有る 成る れる られる 下さる こと ため もの よう ところ これ それ あれ この その あの さ し せ".split()
#: Words of a table at most: it is sent to every task (about 200 bytes a word).
MOST_WORDS = 1_000_000
#: What a word that the table lacks costs, and each of its letters. A word of the table costs less.
UNKNOWN, LETTER = 10_000, 1_500


def _kind(c: str) -> str:
    if c.isspace():
        return " "
    name = unicodedata.name(c, "")
    for script in ("HIRAGANA", "KATAKANA", "CJK"):
        if name.startswith(script) or c in "々〆ー" and script == ("KATAKANA" if c == "ー" else "CJK"):
            return script
    return "digit" if c.isnumeric() else "letter" if c.isalpha() or unicodedata.category(c).startswith("M") else "sign"


class Lattice:
    """Words ``surface, cost, kind, normal`` and the costs of neighbouring kinds."""

    def __init__(self, words: Iterable[tuple[str, int, str, str | None]], joins: dict[tuple[str, str], int] | None = None):
        self.words: dict[str, list[tuple[int, str, str]]] = {}
        self.longest: dict[str, int] = {}
        for surface, cost, kind, normal in words:
            key = plain(surface)
            if key:
                self.words.setdefault(key, []).append((cost, kind, normal if normal is not None else key))
                self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))
        self.joins = joins or {}

    def edges(self, text: str, begin: int, run_end: int) -> Iterable[tuple[int, int, str, str]]:
        """``end, cost, kind, normal`` of the words that begin at a place; the run of its kind of letters ends at ``run_end``."""
        for end in range(begin + 1, min(len(text), begin + self.longest.get(text[begin], 0)) + 1):
            for cost, kind, normal in self.words.get(text[begin:end], ()):
                yield end, cost, kind, normal
        for end in {begin + 1, run_end}:
            yield end, UNKNOWN + LETTER * (end - begin), "unknown", text[begin:end]

    def path(self, text: str) -> list[tuple[str, str]]:
        """``surface, normal`` of the words on the best path through a text without white space."""
        kinds = [_kind(c) for c in text]
        run_end = list(range(1, len(text) + 1))
        for i in range(len(text) - 2, -1, -1):
            if kinds[i] == kinds[i + 1]:
                run_end[i] = run_end[i + 1]
        # for each place the best way there by the kind of the last word: cost, words, where it began, the kind before, its normal form
        best: list[dict[str, tuple]] = [{} for _ in range(len(text) + 1)]
        best[0][""] = (0, 0, 0, "", "")
        for begin in range(len(text)):
            if not best[begin]:
                continue
            for end, cost, kind, normal in self.edges(text, begin, run_end[begin]):
                way = min((c + cost + self.joins.get((before, kind), 0), n + 1, begin, before, normal) for before, (c, n, *_) in best[begin].items())
                if kind not in best[end] or way < best[end][kind]:
                    best[end][kind] = way
        out, at = [], len(text)
        kind = min(best[at], key=lambda k: best[at][k]) if text else ""
        while at:
            _, _, begin, before, normal = best[at][kind]
            out.append((text[begin:at], normal))
            at, kind = begin, before
        return out[::-1]

    def tokens(self, text: str | None, stop: frozenset[str], least: int) -> list[str]:
        found = []
        for part in plain(text or "").split():
            for surface, normal in self.path(part):
                kept = normal.strip()
                if len(kept) >= max(least, 1) and kept not in stop and surface not in stop and any(_kind(c) != "sign" for c in kept):
                    found.append(kept)
        return found


def plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def lexicon(words: DataFrame) -> DataFrame:
    """``surface, cost, kind, normal`` from ``word, n``: the rarer a word, the dearer (100 times the negative logarithm of its share)."""
    total = words.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).select(F.col("word").alias("surface"), F.round(-100 * F.log(F.col("n") / F.col("total"))).cast("int").alias("cost"), F.lit("word").alias("kind"), F.lit(None).cast("string").alias("normal"))  # one row


def tokenizer(words: DataFrame, joins: dict[tuple[str, str], int] | None = None, stop_words: Iterable[str] = STOP_WORDS, least: int = 1, most: int = MOST_WORDS) -> Callable[[Column], Column]:
    """A function from a text to its tokens (``array<string>``), to be given to a keyword index or wherever texts are tokenised.

    ``words`` has ``surface, cost, kind, normal`` (null: the surface in plain
    form). The table is sent to the tasks; one of more than ``most`` rows is an
    error. Null and empty texts have no tokens.
    """
    held = words.select("surface", "cost", "kind", "normal").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"the table has more than {most} words")
    shared = words.sparkSession.sparkContext.broadcast([tuple(r) for r in held])
    stop = frozenset(stop_words)
    built: list[Lattice] = []

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Lattice(shared.value, joins))
        return pa.array([built[0].tokens(t, stop, least) for t in texts.to_pylist()], pa.list_(pa.string()))

    return split
